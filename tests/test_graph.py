import itertools
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import graph


def joined(pairs, a, b):
    seen, todo = {a}, [a]
    while todo:
        v = todo.pop()
        for x, y in pairs:
            for w in ((y,) if x == v else (x,) if y == v else ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
    return b in seen


@pytest.mark.parametrize("seed", range(20))
def test_bridges_by_definition(seed):
    rng = random.Random(seed)
    pairs = [p for p in itertools.combinations(range(9), 2) if rng.random() < 0.25]
    bridges, parts = graph.bridges_and_parts(pairs, list(range(9)))
    assert bridges == {p for p in pairs if not joined([q for q in pairs if q != p], *p)}
    left = [p for p in pairs if p not in bridges]
    assert all(joined(left, min(p), v) for p in parts for v in p) and sorted(v for p in parts for v in p) == list(range(9))


def test_long_chain_needs_no_recursion():
    bridges, parts = graph.bridges_and_parts([(i, i + 1) for i in range(20_000)], list(range(20_001)))
    assert len(bridges) == 20_000 and len(parts) == 20_001


def test_violations(spark):
    rows = [("a", "calls", "resolved", "t", None, None), ("b", "calls", "resolved", None, None, None), ("c", "calls", "partial", "t", "r", 1.5), ("d", "odd", "unresolved", None, "r", None), ("e", "calls", "unresolved", None, None, None)]
    df = spark.createDataFrame(rows, "id string, kind string, status string, target string, target_reference string, confidence double")
    assert {r.id for r in graph.violations(df).collect()} == {"b", "c", "d", "e"}


def test_connected_parts_shrink_to_their_smallest_node(spark, monkeypatch):
    import random

    from orrery.operators import graph

    rng, sizes = random.Random(4), []

    def watched(df, real=graph.durable):
        out = real(df)
        if out.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "durable", watched)
    edges = [(7 * i + j, 7 * i + j + 1) for i in range(20) for j in range(6)] + [(300 - i, 299 - i) for i in range(40)] + [(rng.randint(400, 440), rng.randint(400, 440)) for _ in range(30)] + [(500, 500), (501, None), (None, 502)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = graph.connected(spark.createDataFrame(edges, "a int, b int")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, root(x)) for x in parent)
    assert max(sizes) < len(edges) / 2
    assert graph.connected(spark.createDataFrame([], "a int, b int")).count() == 0


def test_parts_within_are_those_of_all_edges(spark):
    rng = random.Random(7)
    edges = [(p, rng.randint(0, 30), rng.randint(0, 30)) for p in range(40) for _ in range(rng.randint(1, 25))] + [(50, i, i + 1) for i in range(300, 0, -1)] + [(51, 4, 4), (52, None, 1), (52, 2, 3)]
    near = {}

    def root(x):
        while near.setdefault(x, x) != x:
            x = near[x]
        return x

    for p, a, b in edges:
        if a is not None and b is not None and a != b:
            near[root((p, a))] = root((p, b))
    got = graph.parts_within(spark.createDataFrame(edges, "part int, a int, b int")).collect()
    assert sum(r.parts for r in got) == len({root(x) for x in list(near)})
    assert sum(r.parts for r in graph.parts_within(spark.createDataFrame([], "part int, a int, b int")).collect()) == 0


def test_statistics_are_the_same_in_parts_and_write_sums_alone(spark, monkeypatch):
    from orrery.operators import views
    from orrery.plans import structure

    nodes = [(p, i, "class" if i % 3 else "function", "python" if i % 2 else None, None if i == 3 else i % 4 == 0) for p in range(30) for i in range(8)]
    edges = [(p, i, (i * 5 + p) % 9, "calls" if i % 2 else None) for p in range(30) for i in range(6)] + [(1, None, 2, "calls")]
    name = F.concat_ws(":", "part", "id")
    n = spark.createDataFrame(nodes, "part int, id int, type string, language string, parsed boolean")
    e = spark.createDataFrame(edges, "part int, a int, b int, kind string")
    whole = views.statistics(n.select(name.alias("id"), "type", "language", "parsed"), e.select(*[F.when(F.col(x).isNotNull(), F.concat_ws(":", "part", x)).alias(x) for x in "ab"], "kind"))
    assert sorted(map(str, views.statistics(n, e, name=name).collect())) == sorted(map(str, whole.collect()))
    empty = views.statistics(n.filter("false"), e.filter("false"), name=name).collect()
    assert sorted((r.figure, r.value) for r in empty) == sorted((f, 0.0) for f in ("total_nodes", "total_edges", "parsed_count", "inferred_count", "avg_in_degree", "avg_out_degree", "connected_component_count"))

    written = []

    def watched(df, real=views.durable):
        out = real(df)
        written.append(out.count())
        return out

    for module in (graph, views, structure):
        monkeypatch.setattr(module, "durable", watched)
    assert structure.graph_statistics(spark, "/root/testdata/sf0.001").count() > 10
    assert sum(written) < 100
