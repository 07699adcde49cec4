"""Notes, the order of anchors, and exported symbols on small tables."""

from pyspark.sql import functions as F

from orrery.functions.text import slug
from orrery.operators import anchors, documents, notes


def test_notes_say_what_they_are(spark):
    rows = [
        ("a.md", "markdown", "docs_page", "intro\n## Not top\n# Top  \nmore\n\nlast"), ("README.md", "markdown", "readme", "##Not a heading\n \n## Only\n"), ("n.txt", "text", "text_note", "One\n---\n\nTwo\n==\n"), ("x.rst", "rst", "docs_page", None),
        ("p/package.json", "json", "manifest", '{"name": "p", "scripts": {"go": "x"}}'), ("q/package.json", "json", "manifest", "{broken"), ("long.txt", "text", "text_note", "word " * 200),
    ]
    got = {r.path: (r.title, r.headings, r.summary) for r in notes.described(spark.createDataFrame(rows, "path string, language string, kind string, text string")).collect()}
    assert got["a.md"] == ("Top", ["Not top", "Top"], "intro")
    assert got["README.md"] == ("README", ["Only"], "README contains sections: Only.")
    assert got["n.txt"] == ("n.txt", ["One", "Two"], "One ---") and got["x.rst"] == ("x.rst", [], "x.rst is available as guidance-only orientation material.")
    assert got["p/package.json"] == ("p", [], "package.json describes package metadata and signals:  go ") and got["q/package.json"][2] == "{broken" and len(got["long.txt"][2]) == 360


def test_reading_says_how_many_there_are(spark):
    items = spark.createDataFrame([(f"p{i}", "readme", f"t{i}", 9 - i) for i in range(7)], "path string, kind string, title string, priority int")
    rows = notes.reading(items, "it").orderBy("place").collect()
    assert [r.path for r in rows] == ["p6", "p5", "p4", "p3", "p2"] and {r.notes for r in rows} == {7} and rows[0].summary == "it has 5 high-priority orientation files available as guidance-only context."
    assert [(r.place, r.summary) for r in notes.reading(items.limit(0), "it").collect()] == [(None, "it has no orientation inventory yet.")]


def test_anchors_stand_in_order(spark):
    rows = [("webhook", "a", 1, "x"), ("http_route", "b", 2, "x"), ("http_route", "a", 9, "x"), ("other", "a", 1, "x"), ("auth_boundary", "a", 1, "y"), ("auth_boundary", "a", 1, "x")]
    got = anchors.ordered(spark.createDataFrame(rows, "kind string, path string, line int, label string")).orderBy("place").collect()
    assert [(r.place, r.kind, r.path, r.label) for r in got] == [(1, "http_route", "a", "x"), (2, "http_route", "b", "x"), (3, "webhook", "a", "x"), (4, "auth_boundary", "a", "x"), (5, "auth_boundary", "a", "y"), (6, "other", "a", "x")]


def test_exported_symbols_of_public_files(spark):
    rows = [("src/index.ts", "typescript", True), ("src/index.js", "go", True), ("src/a.py", "python", True), ("tests/a.ts", "typescript", True), ("src/b.ts", "typescript", False), ("x\\docs\\b.ts", "typescript", True)]
    df = spark.createDataFrame([(p, x, "class", f"q{i}", 1, 2, e) for i, (p, x, e) in enumerate(rows)], "path string, language string, kind string, qualified_name string, start_line int, end_line int, exported boolean")
    assert sorted(r.label for r in anchors.exported_anchors(df).collect()) == ["q0", "q1"]


def test_names_of_nodes(spark):
    df = spark.createDataFrame([("  API Client & Co!",), ("Config/ENV",), ("---",), ("Plain é",)], "x string")
    assert [(r[0], r[1]) for r in df.select(slug(F.col("x")), documents.node_kind(F.col("x"))).collect()] == [("api-client-co", "external_boundary"), ("config-env", "cross_cutting"), ("", "component"), ("plain", "component")]


def test_lines_are_read_once_for_all_rules_and_patterns_come_last(spark, tmp_path):
    from orrery.plans.notes import LINES

    texts = [t for line in LINES for t in (line, line.upper(), f"x {line}", line.replace("e", "é"))] + ["@celery.task", "new  Worker", "crontab", "sqs", "axios.get (", "register_plugin", "İ auth", None]
    rows = [(f"{'plugin' if i % 2 else 'src'}/f{i // 3}", "production", i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "path string, role string, line long, text string").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    found = anchors.line_anchors(lines)
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("FileScan") == 1
    low = F.lower("text")
    for r in anchors.RULES:
        assert not lines.filter(F.col("text").rlike(r.pattern) & ~anchors._holds(low, r.needs)).take(1)
        assert not r.beside or r.first and not lines.filter(F.col("text").rlike(r.beside) & ~anchors._holds(low, r.beside_needs)).take(1)
    # a rule's second condition on another line of the file, or in its path, and none
    rows = [("a", "production", 1, "register(x)"), ("a", "production", 2, "the registry"), ("plugin/b", "production", 1, "register(x)"), ("c", "production", 1, "register(x)"), ("d", "docs", 1, "the registry")]
    got = anchors.line_anchors(spark.createDataFrame(rows, "path string, role string, line long, text string")).filter("kind = 'plugin_registry'").collect()
    assert sorted((r.path, r.line) for r in got) == [("a", 1), ("plugin/b", 1)]
