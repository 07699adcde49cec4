"""Reads, tools and the store of runs on small tables."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import documents, graph, sources, store, tools


@pytest.fixture(scope="module")
def corpus(spark):
    text = {"a.py": "import x\ndef go():\n    return x\n\nclass Box:\n    pass", "b.md": "# Top\nwords\nNext\n----\nmore", "c.bin": "nothing here"}
    language = {"a.py": "python", "b.md": "markdown", "c.bin": "unknown"}
    files = spark.createDataFrame([(p, language[p], "docs" if p == "b.md" else "production", t) for p, t in text.items()], "path string, language string, role string, text string")
    lines = spark.createDataFrame([(p, language[p], "docs" if p == "b.md" else "production", i, x) for p, t in text.items() for i, x in enumerate(t.split("\n"), 1)], "path string, language string, role string, line long, text string")
    symbols = spark.createDataFrame([("1", "a.py", "go", "a.go"), ("2", "a.py", "Box", "a.Box")], "id string, path string, name string, qualified_name string")
    anchors = spark.createDataFrame([("worker", "a.py")], "kind string, path string")
    return tools.Corpus(files, lines, symbols, anchors, files.limit(1))


def test_ranges(spark, corpus):
    asked = spark.createDataFrame([(1, "a.py", 2, 3), (2, "a.py", 5, 99), (3, "a.py", 0, 1), (4, "a.py", 3, 2), (5, "a.py", 7, 9), (6, "no", 1, 1)], "request int, path string, start_line long, end_line long")
    got = {r.request: (r.text, r.end_line, r.error) for r in sources.read_ranges(corpus.lines, asked).collect()}
    assert got[1] == ("def go():\n    return x", 3, None) and got[2] == ("class Box:\n    pass", 6, None)
    assert [got[i][2] for i in (3, 4, 5, 6)] == ["start_line must be >= 1", "end_line must be >= start_line", "start_line is beyond end of file", "no such file"]


def test_outline(corpus):
    got = sorted((r.path, r.start_line, r.end_line, r.label, r.kind) for r in sources.outline(corpus.lines).collect())
    assert got == [("a.py", 2, 4, "go", "symbol"), ("a.py", 5, 6, "Box", "symbol"), ("b.md", 1, 2, "Top", "section"), ("b.md", 3, 5, "Next", "section"), ("c.bin", 1, 1, "c.bin", "file")]


def test_paths(spark):
    cases = {"a/./b": "a/b", "../x": None, "/abs": None, "a/../b": "b", "a/../../b": None, "a\\b": "a/b", "": None, "a/b/..": "a", "../a/../..": None}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.q for r in df.select("p", sources.normalized_path(F.col("p")).alias("q")).collect()} == cases


def test_tools(corpus):
    run = lambda tool, **args: tools.run_tool(corpus, tool, args).collect()
    assert {r.path for r in run("grep", query="x", context_lines=0)} == {"a.py", "b.md"} and [r.text for r in run("grep", q="go", context_lines=1)] == ["import x\ndef go():\n    return x"]
    assert run("search_code", query="words", role="production") == [] and run("search_code", query="go", path="b.md") == []
    assert [r.path for r in run("search_files", query="md")] == ["b.md"]
    assert run("read", path="a.py", start_line=1, end_line=1)[0].text == "import x" and run("open_file", path="c.bin")[0].text == "nothing here"
    assert [(r.start_line, r.end_line) for r in run("expand_region", path="a.py", start_line=3, end_line=3, lines=1)] == [(2, 4)]
    assert len(run("outline", path="a.py")) == 2 and run("find_definition", name="Box")[0].id == "2" and len(run("list_symbols", path="a.py")) == 2
    assert len(run("list_anchors", kind="worker")) == 1 and run("list_anchors", kind="other") == [] and len(run("list_orientation")) == 1
    assert {r.path for r in run("find_references", name="x", path="a.py")} == {"a.py"}
    assert tools.clamped("7", 1, 0, 5) == 5 and tools.clamped(None, 3, 0, 5) == 3
    with pytest.raises(ValueError):
        run("unknown")


def test_runs_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "runs")
    schema = "run_id string, id string, v int"
    store.write_runs(spark.createDataFrame([("a", "1", 1), ("a", "2", 1), ("b", "1", 1), ("b", "1", 1)], schema), path)
    store.write_runs(spark.createDataFrame([("a", "9", 2)], schema), path)
    assert sorted((r.run_id, r.id, r.v) for r in store.read_runs(spark, path).collect()) == [("a", "9", 2), ("b", "1", 1)]
    assert [r.id for r in store.read_runs(spark, path, "b").collect()] == ["1"]


def test_nearest_collapsed_ancestor(spark):
    up = spark.createDataFrame([("n", "n", 0), ("n", "p", 1), ("n", "g", 2), ("m", "m", 0), ("m", "g", 1)], "node string, ancestor string, distance int")
    shut = spark.createDataFrame([("p",), ("g",), ("m",)], "node string")
    assert {tuple(r) for r in graph.representatives(up, shut).collect()} == {("n", "p"), ("m", "m")}


def test_labels(spark):
    df = spark.createDataFrame([("Two words", "d"), ("One", "d"), ("Two words", " "), (None, "d"), ("Two words", "x" * 1201)], "l string, d string")
    assert [r[0] for r in df.select(documents.valid_label(F.col("l"), F.col("d"))).collect()] == [True, False, False, False, False]
