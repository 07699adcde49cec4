"""The module graph over all resolved relations, against plain Python."""

import duckdb
import pytest

from orrery.plans import catalog


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def plain(request):
    """Pairs of each leaf group, from all relations, all modules, and the folder of the tables."""
    d = f"/root/testdata/{request.param}"
    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    pairs = c.sql(f"{catalog.GRAPH} SELECT DISTINCT sg, least(sm, tm), greatest(sm, tm) FROM edges WHERE status = 'resolved' AND sg = tg AND sm <> tm").fetchall()
    return pairs, c.sql(f"WITH {catalog.MODULES} SELECT leaf, module FROM mods").fetchall(), d


def near(pairs):
    out = {}
    for _, a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def depths(links, start):
    out, todo = {start: 0}, [start]
    for v in todo:
        for w in links.get(v, ()):
            if w not in out:
                out[w] = out[v] + 1
                todo.append(w)
    return out


def clusters(pairs):
    """(bridges, smallest member of each module's cluster), by definition."""
    bridges = {p for p in pairs if p[2] not in depths(near([q for q in pairs if q[0] == p[0] and q != p]), p[1])}
    links = near([p for p in pairs if p not in bridges])
    return bridges, {v: min(depths(links, v)) for v in links}


def rows(spark, name, d):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, d).collect())


def test_pairs(spark, plain):
    assert rows(spark, "affinity_pairs", plain[2]) == sorted(plain[0])


def test_degrees_components_and_reach(spark, plain):
    links = near(plain[0])
    assert rows(spark, "graph_degrees", plain[2]) == sorted((v, len(w)) for v, w in links.items())
    assert rows(spark, "connected_components", plain[2]) == sorted((v, min(depths(links, v))) for v in links)
    assert rows(spark, "traverse", plain[2]) == (sorted((v, n) for v, n in depths(links, min(links)).items() if n <= 4) if links else [])


def test_bridges_and_residuals(spark, plain):
    pairs, modules, d = plain
    bridges, of = clusters(pairs)
    got = [tuple(r) for r in catalog.QUERIES["bridge_separated_clusters"](spark, d).select("group_id", "a", "b", "bridge", "cluster").collect()]
    assert sorted(got, key=repr) == sorted(((*p, p in bridges, None if p in bridges else of[p[1]]) for p in pairs), key=repr)
    links = near(pairs)

    def reason(g, m):
        if sum(x == g for x, _ in modules) < 3:
            return "region_too_small"
        if not any(p[0] == g for p in pairs):
            return "no_internal_resolved_relation"
        if not any(of.get(x) for k, x in modules if k == g):
            return "no_useful_non_bridge_relation_core"
        return "only_bridge_connected_or_below_minimum_core" if m in links else "no_internal_resolved_relation"

    assert rows(spark, "cluster_residuals", d) == sorted((g, m, reason(g, m)) for g, m in modules if m not in of)


def test_modules_are_parsed_by_many_tasks(spark):
    from orrery.plans import modules

    assert modules._files(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_replies_are_read_without_another_join(spark):
    from orrery.plans import proofs

    replies = proofs._replies(spark, "/root/testdata/sf0.001")[0]
    assert "Exchange" not in replies._jdf.queryExecution().executedPlan().toString()
