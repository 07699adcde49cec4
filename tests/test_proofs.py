"""Claims over paths, replies of proposers, and overlapping lines against plain Python."""

import json
import random

from pyspark.sql import functions as F

from orrery.operators import claims, evidence, graph, spans

RELATIONS = "id string, source string, target string, target_reference string, kind string, status string, line long, path string, run_id string"


def relations(spark, rows):
    return spark.createDataFrame([(i, a, b, None, k, s, n, "p", r) for i, a, b, k, s, n, r in rows], RELATIONS)


ROWS = [
    ("r3", "a", "b", "calls", "resolved", 1, "run"), ("r1", "a", "b", "calls", "resolved", 2, "run"), ("r2", "b", "c", "calls", "resolved", 3, "run"), ("r4", "c", "d", "calls", "partial", 4, "run"),
    ("r5", "d", "e", "calls", "resolved", 5, "run"), ("r6", "c", "d", "calls", "resolved", 6, "other"), ("r7", "a", "c", "inherits", "resolved", 7, "run"),
]


def test_paths_are_proved_up_to_their_first_gap(spark):
    r = relations(spark, ROWS)
    asked = [("x", "direct_relation", "calls", ["a", "b"], None), ("y", "direct_relation", "calls", ["a", "c"], None), ("z", "reachability", "calls", ["a", "b", "c"], None), ("w", "reachability", "calls", ["a", "b", "c", "d", "e"], None),
             ("v", "reachability", "calls", ["a", "c"], ["r1", "r4"]), ("u", "reachability", "calls", ["a", "c"], []), ("t", "reachability", "calls", ["a", "c"], ["r6"]), ("s", "reachability", "calls", ["a", "c"], ["none"])]
    df = spark.createDataFrame(asked, "claim string, proposition string, kind string, path array<string>, refuted array<string>")
    got = {x.claim: x for x in claims.claims(df, r).collect()}
    assert {k: (x.support_status, list(x.chain)) for k, x in got.items()} == {
        "x": ("supported", ["r1"]), "y": ("insufficient_evidence", []), "z": ("supported", ["r1", "r2"]), "w": ("insufficient_evidence", ["r1", "r2"]),
        "v": ("contradicted", ["r1", "r4"]), "u": ("rejected", []), "t": ("rejected", []), "s": ("rejected", []),
    }
    assert got["w"].reasoning == "no resolved 'calls' relation found for hop 'c' -> 'd'; 2/4 preceding hop(s) were matched before this gap" and got["x"].reasoning == ""
    assert got["z"].statement == "a reaches c through a call path." and got["y"].statement == "a calls c." and got["z"].claim_id != got["y"].claim_id
    assert got["v"].statement == "a reaches c through a call path." and got["v"].reasoning.startswith("caller-asserted")
    regions = spark.createDataFrame([("g", "p", 3, 3), ("h", "p", 2, 9)], "region_id string, path string, start_line long, end_line long")
    chain = claims.chains(claims.claims(df, r).filter("claim = 'z'"), r, regions)
    assert [(x.hop, x.relation, x.source, x.target, x.region) for x in chain.orderBy("hop").collect()] == [(0, "r1", "a", "b", None), (1, "r2", "b", "c", "g")]


def test_replies_are_read_item_by_item(spark):
    p = lambda kind, a, rel, b, path=None: {"proposition": {"kind": kind, "subject_entity_id": a, "relation_kind": rel, "object_entity_id": b, "path_entity_ids": path}}
    items = [
        p("direct_relation", "a", "calls", "b"), p("reachability", "a", "calls", "c", ["a", "b", "c"]), p("direct_relation", "a", "calls", "b", ["a"]), p("reachability", "a", "calls", "c", ["a"]),
        p("reachability", "a", "calls", "c", ["a", "b"]), p("maybe", "a", "calls", "b"), p("direct_relation", "a", "eats", "b"), p("direct_relation", "", "calls", "b"), "text", 5, None, {"x": 1}, {"proposition": "a"}, p("direct_relation", "a", "calls", "zz"),
        p("direct_relation", "a", "calls", "b", []),
    ]
    replies = spark.createDataFrame([("a", json.dumps({"proposals": items})), ("b", "not json"), ("c", None), ("d", '{"proposals": 4}'), ("e", '{"proposals": []}'), ("f", "[]")], "target string, text string")
    good, bad = claims.parsed_proposals(replies.withColumnRenamed("target", "reply"))
    assert sorted((x.reply, x.item, x.path) for x in good.collect()) == [("a", 0, ["a", "b"]), ("a", 1, ["a", "b", "c"]), ("a", 13, ["a", "zz"]), ("a", 14, ["a", "b"])]
    left = bad.collect()
    assert {x.item for x in left if x.reply == "a"} == {2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12} and {x.reply for x in left if x.item is None} == {"b", "c", "d", "f"}
    symbols = spark.createDataFrame([("a", "m"), ("q", "m"), ("z", None)], "id string, parent string")
    made, out = claims.verified_targets(replies, relations(spark, ROWS), symbols)
    assert sorted((x.target, x.item, x.support_status) for x in made.collect()) == [("a", 0, "supported"), ("a", 1, "supported"), ("a", 14, "supported")]
    assert [(x.target, x.item) for x in out.filter("reason = 'entity that was not shown'").collect()] == [("a", 13)]


def test_neighbourhood_has_parent_and_siblings(spark):
    symbols = spark.createDataFrame([("a", "m"), ("q", "m"), ("z", None), ("b", None)], "id string, parent string")
    targets = spark.createDataFrame([("a",), ("z",)], "target string")
    entities, shown = claims.bounded(relations(spark, ROWS), symbols, targets, 2)
    assert sorted((x.target, x.entity) for x in entities.collect()) == [("a", e) for e in ("a", "b", "c", "d", "m", "q")] + [("z", "z")]
    assert sorted(x.id for x in shown.collect()) == ["r1", "r2", "r3", "r4", "r6", "r7"]


def test_overlaps_equal_plain_comparison(spark):
    rng = random.Random(5)
    row = lambda i: (i, rng.choice(["p", "q", None]), a := rng.randint(-40, 900), a + rng.choice([-2, 0, 1, 5, 70, 500]))  # noqa: E731,F821
    left, right = [row(i) for i in range(90)], [row(i) for i in range(90)]
    a = spark.createDataFrame(left, "x int, path string, a1 int, a2 int")
    b = spark.createDataFrame(right, "y int, path string, b1 int, b2 int")
    got = [(r.x, r.y) for r in spans.overlaps(a, b, ["path"]).select("x", "y").collect()]
    want = {(i, j) for i, p, s, e in left for j, q, t, f in right if p is not None and p == q and s <= e and t <= f and max(s, t) <= min(e, f)}
    assert len(got) == len(want) and set(got) == want
    inner = graph.innermost(b.select("path", F.col("y").alias("id"), F.col("b1").alias("start_line"), F.col("b2").alias("end_line")), spark.createDataFrame([("p", 1, 100), ("q", 2, 5000)], "path string, point int, line int")).collect()
    holds = [(f - t, j) for j, q, t, f in right if q == "p" and t <= 100 <= f]
    assert [(r.point, r.span) for r in inner] == ([(1, min(holds)[1])] if holds else [])


def test_evidence_is_compared_by_kind_and_ends(spark):
    schema = "claim int, hop int, file string, kind string, relation string, source string, target string, symbol string, start_line int, end_line int"
    fact = evidence.fact(*[F.col(c) for c in ("kind", "relation", "source", "target", "symbol")]).alias("fact")
    side = lambda rows: spark.createDataFrame(rows, schema).select("claim", "hop", "file", fact, "start_line", "end_line")
    truth = side([(1, 0, "f", "relationship", "calls", "a", "b", None, 3, 4), (1, 1, "f", "source_span", None, None, None, None, 9, 9), (1, 2, "f", "source_span", None, None, None, "s", 9, 9)])
    said = side([(1, 0, "f", "relationship", "calls", "a", "b", "any", 4, 6), (1, 1, "f", "relationship", "calls", "a", "c", None, 3, 4), (1, 2, "f", "source_span", "x", None, None, None, 8, 20), (1, 3, "g", "source_span", None, None, None, "s", 9, 9)])
    assert sorted(tuple(r) for r in evidence.matched_evidence(said, truth).collect()) == [(1, 0, 0), (1, 1, 2)]
    assert [r.value for r in evidence.evidence_scores(said, truth).collect()] == [0.5, 0.666667]
