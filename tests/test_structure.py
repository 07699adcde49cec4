"""Matching, trees of directories, views of graphs, the word index and the store against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from orrery.lineage import durable
from orrery.operators import documents, graph, hierarchy, matching, postings, store, views
from orrery.plans import corpus


def test_contained_equals_plain_search(spark):
    rng = random.Random(2)
    letters = "abé$. 🙂ß_-"
    word = lambda n: "".join(rng.choices(letters, k=n))
    texts = [(i, word(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "ABÉ$" * 4), (103, "ab" * 20_000 + "é$é")]
    patterns = [(i, word(rng.randint(0, 6))) for i in range(80)] + [(200, None), (201, "É$É"), (202, "abab"), (203, "abab"), (204, "a" * 500)]
    got = matching.contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(patterns, "pattern_id int, pattern string")).collect()
    want = {(i, j) for i, t in texts if t for j, p in patterns if p and p.lower() in t.lower()}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    none = spark.createDataFrame([], "pattern_id int, pattern string")
    assert matching.contained(spark.createDataFrame(texts, "id int, text string"), none).count() == 0


def _broadcast(df):
    """What a plan broadcasts, as text: for each exchange the lines below it."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    depth = lambda line: len(re.match(r"[ :+\-]*", line)[0])
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for x in lines[i + 1 :]:
                if depth(x) <= depth(line):
                    break
                below.append(x)
            yield "\n".join(below)


def test_runs_of_texts_are_never_broadcast(spark, tmp_path):
    spark.range(200).selectExpr("id", "concat('some text of ', id) AS text").write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    found = matching.contained(texts, texts.selectExpr("id % 7 AS pattern_id", "concat('of ', id % 7) AS pattern").distinct())
    assert not [b for b in _broadcast(found) if "Generate" in b]
    assert found.count() == sum(f"of {i}".startswith(f"of {p}") for i in range(200) for p in range(7))


def test_mentions_leave_out_the_symbol_itself(spark):
    texts = spark.createDataFrame([(1, "Load the ConfigStore, $bar and naïve_name"), (2, "nothing"), (3, None)], "source int, text string")
    names = spark.createDataFrame([(1, "store", 9), (2, "Store", 8), (4, "$BAR", 3), (5, "NAÏVE_name", 4), (6, "ab", 1), (7, "load", 2), (8, None, 0)], "symbol int, name string, place int")
    assert sorted((r.source, r.symbol, r["rank"]) for r in documents.mentions(texts, names).collect()) == [(1, 2, 4), (1, 4, 2), (1, 5, 3), (1, 7, 1)]
    assert [r.symbol for r in documents.mentions(texts, names, most=2).orderBy("rank").collect()] == [7, 4]


def test_claims_and_regions_of_components(spark):
    claims = spark.createDataFrame([(1, "the webApi client"), (2, "x"), (3, ""), (4, None)], "claim int, text string")
    cited = spark.createDataFrame([(2, "src/HTTP.py"), (3, ""), (4, None), (4, "none.py")], "claim int, path string")
    components = spark.createDataFrame([("c", "Api", "Api of x/src/http.py"), ("d", "zz", "zz"), ("e", "x", "x")], "component string, label string, text string")
    assert sorted(tuple(r) for r in documents.claims_of_components(claims, cited, components).collect()) == [("c", 1), ("c", 2), ("e", 2)]
    parts = spark.createDataFrame([("a", "Request tokenizer", []), ("b", "Sync things", ["LIB/x.PY"])], "component string, text string, paths array<string>")
    regions = spark.createDataFrame([(1, "lib/_tokenizer_.py"), (2, "lib/x.py"), (3, "zz/session.go"), (4, "_.py"), (5, "a/request.v2.ts")], "region int, path string")
    assert sorted(tuple(r) for r in documents.regions_by_keyword(parts, regions).collect()) == [("a", 1), ("a", 5), ("b", 2), ("b", 3)]


def grown(paths, levels=6):
    """The tree as its rule tells it: label, level, parent's label, kind, members, samples."""
    out = []

    def split(prefix, items):
        at = len(prefix) + 1 if prefix else 0
        direct, sub = [], {}
        for p in items:
            rest = p[at:]
            sub.setdefault(rest.split("/")[0], []).append(p) if "/" in rest else direct.append(p)
        return direct, sub

    def folded(prefix, items, depth):
        direct, sub = split(prefix, items)
        while not direct and len(sub) == 1 and depth < levels:
            (name, items), depth = next(iter(sub.items())), depth + 1
            prefix = f"{prefix}/{name}" if prefix else name
            direct, sub = split(prefix, items)
        return prefix, direct, sub, depth

    def bucket(prefix, direct, level, parent):
        out.append((f"{prefix} (direct files)" if prefix else "Repository root files", level, parent, "files", len(direct), sorted(direct)[:5]))

    def node(prefix, items, level, parent):
        prefix, direct, sub, level = folded(prefix, items, level)
        branch = len(sub) + bool(direct) >= 2 and level < levels
        out.append((prefix, level, parent, "region" if branch else "section", len(items), sorted(items)[:5]))
        if branch:
            if direct:
                bucket(prefix, direct, level + 1, prefix)
            for name, below in sub.items():
                node(f"{prefix}/{name}", below, level + 1, prefix)

    prefix, direct, sub, _ = folded("", paths, 0)
    if len(sub) + bool(direct) < 2:
        return []
    if direct:
        bucket(prefix, direct, 1, None)
    for name, below in sub.items():
        node(f"{prefix}/{name}" if prefix else name, below, 1, None)
    return out


@pytest.mark.parametrize("seed", [1, 3])
def test_directory_tree_equals_recursion(spark, seed):
    rng = random.Random(seed)
    start = ["", "src/app/", "a/b/c/d/e/f/", "a/b/c/d/e/f/g/"][seed]
    paths = sorted({start + "".join(rng.choices(["p/", "q/", "only/one/", "p/q/"], k=rng.randint(0, 6))) + f"f{rng.randint(0, 30)}.py" for _ in range(120)} | {start + "x/y/z/" * 4 + "deep.py"})
    df = spark.createDataFrame([(p, "module") for p in paths], "path string, kind string")
    rows = hierarchy.tree(df).collect()
    label = {r.id: r.label for r in rows}
    got = sorted((r.label, r.level, label.get(r.parent), r.kind, r.members, r.samples) for r in rows)
    assert got == sorted(grown(paths)) and len(label) == len(rows) and bool(rows) == (seed < 3)
    if seed == 3:
        assert hierarchy.tree(df.limit(0)).count() == 0
        mixed = df.limit(9).withColumn("path", F.regexp_replace("path", "^a/b/c/d/e/f/g/", "")).withColumn("kind", F.when(F.rand(1) < 0.5, "service").otherwise("module"))
        assert hierarchy.tree(mixed).count() == 0


def test_samples_repeat_no_path_that_is_not_among_the_first(spark):
    paths = [f"a/{'/'.join('bcdefghijklmno'[: i % 15])}/f{i:03}" for i in range(300)]
    df = hierarchy._samples(spark.createDataFrame([(p,) for p in paths], "path string"), 6, 5)
    got = {(r.prefix, r.bucket): r.samples for r in df.collect()}
    want = {}
    for p in sorted(paths):
        parts = p.split("/")
        for n in range(min(len(parts) - 1, 12) + 1):
            for bucket in {False, n == len(parts) - 1}:
                want.setdefault(("/".join(parts[:n]), bucket), []).append(p)
    assert got == {k: v[:5] for k, v in want.items()}
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "RangePartitioning" not in plan and plan.count("WindowGroupLimit") == 4 and plan.rindex("WindowGroupLimit") > plan.index("Generate")


def test_map_is_grouped_or_flat(spark):
    paths = spark.createDataFrame([("a/x.py", "module"), ("b/y.py", "module")], "path string, kind string")
    components = spark.createDataFrame([("1", "a/x.py"), ("2", "b/y.py")], "id string, label string")
    said = spark.createDataFrame([("1", "2", "Reads  From", True), ("1", "9", "x", True), ("2", "1", " ", False)], "source string, target string, label string, verified boolean")
    nodes = hierarchy.shown_nodes(hierarchy.tree(paths), components, "root", "all")
    assert sorted((r.label, r.level, r.children) for r in nodes.collect()) == [("a", 1, 1), ("all", 0, 2), ("b", 1, 1)]
    assert {(r.source, r.kind) for r in hierarchy.shown_edges(nodes, said, "root").collect()} == {("root", "contains")}
    flat = hierarchy.shown_nodes(hierarchy.tree(paths.limit(1)), components, "root", "all")
    assert sorted((r.label, r.level, r.children) for r in flat.collect()) == [("a/x.py", 1, 0), ("all", 0, 2), ("b/y.py", 1, 0)]
    assert sorted((r.source, r.target, r.kind, r.confidence) for r in hierarchy.shown_edges(flat, said, "root").collect()) == [("1", "2", "reads_from", 0.8), ("2", "1", "dependency", 0.45)]


def reach(edges, v):
    seen, todo = set(), [v]
    while todo:
        for a, b in edges:
            if a == todo[-1] and b not in seen:
                seen.add(b)
                todo.insert(0, b)
        todo.pop()
    return seen


def test_components_and_layers(spark):
    edges = {(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (7, 1), (8, 8), (7, 6)}
    df = spark.createDataFrame(sorted(edges), "a int, b int")
    nodes = {v for e in edges for v in e}
    of = {v: reach(edges, v) for v in nodes}
    component = {v: min([v] + [w for w in of[v] if v in of[w]]) for v in nodes}
    of = durable(views.strong_components(df))
    assert {tuple(r) for r in of.collect()} == set(component.items())
    up = {(component[a], component[b]) for a, b in edges if component[a] != component[b]}
    depth = {}

    def longest(c):
        if c not in depth:
            depth[c] = max([longest(a) + 1 for a, b in up if b == c], default=0)
        return depth[c]

    placed = durable(views.layers(df, of))
    assert {(r.node, r.layer) for r in placed.collect()} == {(v, longest(component[v])) for v in nodes}
    assert sum(r.edges for r in views.layer_edges(df, placed).collect()) == len(edges)
    assert views.strong_components(df.limit(0)).count() == 0


def test_walks(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")], "a string, b string")
    start = spark.createDataFrame([("a",), (None,)], "node string")
    rows = lambda df: sorted((r.node, r.depth) for r in df.collect())
    assert rows(views.traverse(edges, start, "out", 1)) == [("a", 0), ("b", 1)] and rows(views.traverse(edges, start, "out", -1)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(views.traverse(edges, start, "in", -1)) == [("a", 0), ("b", 2), ("c", 1), ("x", 1)] and rows(views.traverse(edges, start, "both", 1)) == [("a", 0), ("b", 1), ("c", 1), ("x", 1)]
    got = sorted(("".join(r.path), r.depth, r.closes) for r in views.call_flow(edges, start, -1).collect())
    assert got == [("a", 0, False), ("ab", 1, False), ("abc", 2, False), ("abca", 3, True), ("abcd", 3, False)]
    nodes, inside = views.dependency_view(edges, start, 1)
    assert rows(nodes) == [("a", 0), ("b", 1), ("c", 1), ("x", 1)] and sorted(tuple(r) for r in inside.collect()) == [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("x", "a", 1)]
    monkeypatch.setattr(views, "CUT", 2)
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "a int, b int")
    assert rows(views.traverse(chain, spark.createDataFrame([(0,)], "node int"), "out", -1)) == [(i, i) for i in range(6)]


def test_word_index_answers_as_a_scan(spark, tmp_path):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(["Mit", "the", "license", "x-ray", "zebra.", "apache", "é"], k=rng.randint(0, 14)))) for i in range(60)] + [(99, None), (None, "mit"), (98, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    path = str(tmp_path / "index")
    postings.write(postings.index(df), path)
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in texts if i is not None}
    flat = {i: f" {' '.join(w)} " for i, w in words.items()}

    def ask(every=(), some=(), none=(), phrases=()):
        terms = sorted({w for x in (*every, *some, *none, *phrases) for w in postings.words_in_order(x)})
        found = postings.search(postings.read(spark, path, terms), list(every), list(some), list(none), list(phrases))
        got = sorted(r.id for r in found.collect())
        want = sorted(i for i, w in words.items() if all(x.lower() in w for x in every) and (not some or any(x in w for x in some)) and not any(x in w for x in none) and all(f" {' '.join(postings.words_in_order(p))} " in flat[i] for p in phrases))
        assert got == want
        return got

    assert ask(["the"]) and ask(["The", "license"], ["apache", "mit"], ["zebra"]) is not None and ask(phrases=["the Mit"]) and ask(["x"], phrases=["x-ray", "ray the"]) is not None
    assert ask(phrases=["the the"]) is not None and postings.search(postings.index(df)).count() == 0 and ask(["unknown"]) == []
    asked = spark.createDataFrame([(1, ["the", "mit"]), (2, ["mit", "mit"]), (3, []), (4, ["the", "mit"]), (5, ["no", "mit"])], "q int, words array<string>")
    got = {(r.q, r.id) for r in postings.phrases(postings.index(df), asked).collect()}
    assert got == {(q, i) for q, p in ((1, " the mit "), (4, " the mit "), (2, " mit mit ")) for i in flat if p in flat[i]}
    shown = postings.snippets(df, postings.search(postings.index(df), ["license"]), "license", 3).collect()
    assert shown and all("lic" in r.snippet.lower() for r in shown)


def test_index_moves_no_word_and_merges_texts_of_one_id(spark):
    texts = spark.createDataFrame([(1, "a B a"), (2, None), (None, "b"), (3, ""), (4, "é-A9 x_b")], "id long, text string")
    one = postings.index(texts)
    assert sorted((r.term, r.id, r.positions) for r in one.collect()) == [("a", 1, [0, 2]), ("a9", 4, [0]), ("b", 1, [1]), ("b", 4, [2]), ("x", 4, [1])]
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    several = postings.index(texts.unionByName(spark.createDataFrame([(1, "b a")], "id long, text string")))
    assert sorted((r.term, r.id, r.positions) for r in several.filter("id = 1").collect()) == [("a", 1, [0, 1, 2]), ("b", 1, [0, 1])]


def test_last_writer_wins_and_half_runs_are_not_seen(spark, tmp_path):
    schema = "run_id string, id string, seq int, v string"
    kept = spark.createDataFrame([("a", "1", 1, "first"), ("a", "1", 2, "last"), ("a", "2", 1, "x"), (None, "1", 1, "n")], schema)
    new = spark.createDataFrame([("a", "2", 9, "new"), ("a", "1", 1, "old"), (None, "1", 2, "m")], schema)
    assert sorted((r.run_id or "", r.id, r.v) for r in store.upserted(kept, new, ["run_id", "id"], "seq").collect()) == [("", "1", "m"), ("a", "1", "last"), ("a", "2", "new")]
    path = str(tmp_path / "runs")
    store.write_runs(kept.filter("run_id is not null"), path, "seq")
    assert sorted((r.id, r.v) for r in store.read_runs(spark, path).collect()) == [("1", "last"), ("2", "x")]
    # rows without a commit are those of a job that was lost
    new.filter("run_id = 'a'").write.partitionBy("run_id").parquet(f"{path}/rows/generation=lost")
    assert sorted((r.id, r.v) for r in store.read_runs(spark, path, "a").collect()) == [("1", "last"), ("2", "x")]
    store.write_runs(new.filter("run_id = 'a'"), path, "seq")
    store.write_runs(spark.createDataFrame([("b", "1", 1, "b")], schema), path)
    assert sorted((r.run_id, r.id, r.v) for r in store.read_runs(spark, path).collect()) == [("a", "1", "old"), ("a", "2", "new"), ("b", "1", "b")]


def _counted(monkeypatch, module):
    """Numbers of rows that a module writes down."""
    sizes = []

    def counting(df):
        out = durable(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(module, "durable", counting)
    return sizes


def test_layers_look_for_cycles_only_below_their_beginnings(spark, monkeypatch):
    asked, found = [], views.strong_components

    def seen(edges):
        asked.append(edges.count())
        return found(edges)

    monkeypatch.setattr(views, "strong_components", seen)
    tree = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (1, 3), (9, 9), (8, None)], "a int, b int")
    assert {tuple(r) for r in views.layers(tree).collect()} == {(1, 1, 0), (2, 2, 1), (3, 3, 2), (9, 9, 0), (8, 8, 0)} and not asked
    # a cycle below a chain, with another way in from further down, and what it leads to
    pairs = [(i, i + 1) for i in range(40)] + [(40, 41), (41, 40), (50, 41), (41, 60), (40, 61), (60, 61), (3, 61)]
    got = {r.node: (r.component, r.layer) for r in views.layers(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {i: (i, i) for i in range(40)} | {40: (40, 40), 41: (40, 40), 50: (50, 0), 60: (60, 41), 61: (61, 42)} and asked == [5]
    assert views.layers(tree.limit(0)).count() == 0


def test_walks_do_not_write_edges_again(spark, monkeypatch):
    edges = durable(spark.range(300).selectExpr("id AS a", "id + 1 AS b"))
    start = spark.createDataFrame([(290,)], "node long")
    for module, walk in ((views, lambda: views.traverse(edges, start, "both", 2, written=True)), (graph, lambda: graph.hops(edges, start, 2, written=True))):
        sizes = _counted(monkeypatch, module)
        assert sorted(r.node for r in walk().collect()) == [288, 289, 290, 291, 292] and max(sizes) <= 2
        assert walk().join(walk(), "node").count() == 5


def test_relations_are_grouped_where_the_join_has_put_them(spark):
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = corpus.relations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "Aggregate" in plan and plan.count("Exchange hashpartitioning") == 2
