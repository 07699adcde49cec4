"""Slices, lists and keys by hand: caps, ties, missing rows and empty tables."""

from pyspark.sql import functions as F

from orrery.operators import lenses


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_a_slice_shows_five_files_of_twenty_regions_and_counts_all(spark):
    regions = [(1, f"r{f}_{i}", f"f{f}", i, i + 1, f * 100 + i) for f in range(7) for i in range(30 if f == 0 else 1)]
    df = spark.createDataFrame(regions, "node long, region string, path string, start_line long, end_line long, place long")
    nodes = spark.createDataFrame([(1, "verified"), (2, "candidate")], "node long, status string")
    got = lenses.slices(df, nodes)
    assert rows(got.groupBy("path", "tab", "role", "summary").count(), "path", "tab", "role", "summary", "count") == [
        ("f0", 1, "primary", "30 highlighted source region(s).", 20),
        *[(f"f{f}", f + 1, "supporting", "1 highlighted source region(s).", 1) for f in range(1, 5)],
    ]
    assert rows(lenses.slice_heads(df, nodes), "node", "status", "primary_span", "strength") == [(1, "verified", "r0_0", 1.0), (2, "insufficient", None, 0.0)]
    assert lenses.slices(df.limit(0), nodes).count() == 0


def test_facts_name_twenty_children_and_how_many_more(spark):
    symbols = [("p", None, "class", "P", "m.P", "m.py", 1, 99, "")] + [(f"c{i}", "p", "method", f"c{i}", f"m.P.c{i}", "m.py", i, i, "c()") for i in range(23)]
    df = spark.createDataFrame(symbols, "id string, parent string, kind string, name string, qualified_name string, path string, start_line long, end_line long, signature string")
    facts = dict(rows(lenses.symbol_facts(df), "id", "facts"))
    assert facts["p"].splitlines()[5:8] == ["signature: P", "contains:", "  - method c0 (lines 0-0)"]
    assert facts["p"].endswith("  - method c19 (lines 19-19)\n  - ... and 3 more")
    assert facts["c3"].splitlines()[-2:] == ["signature: c()", "declared inside: class m.P"]


def test_regions_of_claims_meet_by_terms_of_three_letters(spark):
    children = spark.createDataFrame([("a", "Retry of IO", ["src/net/pool.py"]), ("b", "IO", [])], "child string, label string, paths array<string>")
    claims = spark.createDataFrame([(1, "It will RETRY"), (2, "io only"), (3, None)], "claim long, text string")
    citations = spark.createDataFrame([(1, "r1", "x.go"), (2, "r2", "lib/pool.go"), (3, None, "x.go")], "claim long, region string, path string")
    assert rows(lenses.claim_regions(children, claims, citations), "child", "region") == [("a", "r1"), ("a", "r2")]


def test_a_key_goes_by_rows_and_not_by_their_order(spark):
    items = [("x", f"i{i}") for i in range(50)]
    key = lambda data, mode="no_model": rows(lenses.input_keys(spark.createDataFrame(data, "run string, item string"), "m", mode), "key")
    assert key(items) == key(items[::-1])
    assert len({str(k) for k in (key(items), key(items[1:]), key(items + items[:1]), key(items, "live_model"))}) == 4


def test_nothing_matched(spark):
    q = spark.createDataFrame([(1,), (2,)], "question long")
    areas = spark.createDataFrame([(2, "store", 1), (2, "api", 0)], "question long, label string, place long")
    none = spark.createDataFrame([], "question long, text string, place long")
    got = dict((r[0], r[1:]) for r in rows(lenses.answers(q, areas, none), "question", "answer", "confidence"))
    assert got == {1: (lenses.NO_ANSWER, 0.35), 2: ("Based on the System Overview, the relevant architecture areas are: api, store.", 0.35)}
    assert rows(lenses.coverage(q, spark.createDataFrame([], "question long, evidence long, confidence double")), "question", "lens_count", "evidence_count", "confidence") == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    assert rows(lenses.bullets(q.select(F.col("question").alias("group")), none.withColumnRenamed("question", "group"), "(none)", 3), "group", "body") == [(1, "(none)"), (2, "(none)")]
