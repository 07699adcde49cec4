"""Every document is a candidate, whatever its id."""

import pytest

from orrery.operators import evidence
from orrery.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("claims"))
    docs = [(7, "a" * 700), (8, "a" * 300), (14, "a" * 700), (21, "a" * 10), (28, "a" * 300), (None, "a" * 700)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    labels = [(7, 1, 0), (14, 0, 1), (21, 0, 1), (35, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_metrics(spark, folder):
    got = {r.metric: (r.numerator, r.denominator) for r in QUERIES["claim_metrics"](spark, folder).collect()}
    assert got == {"claim_support_precision": (1, 2), "claim_support_recall": (1, 1), "unsupported_claim_acceptance_rate": (1, 2), "correct_abstention_rate": (1, 2)}


def test_confusion(spark, folder):
    got = {tuple(r) for r in QUERIES["claim_confusion"](spark, folder).collect()}
    assert got == {("supported", "supported", 1), ("contradicted", "supported", 1), ("contradicted", "contradicted", 1), ("insufficient", "abstained", 1)}


def test_novel(spark, folder):
    got = {tuple(r) for r in QUERIES["novel_claims"](spark, folder).collect()}
    assert got == {(8, "insufficient"), (28, "insufficient"), (None, "supported")}


def test_narrative(spark):
    rows = [("t", 1, "supported", "A calls B."), ("t", 3, "contradicted", "A calls D."), ("t", 2, "insufficient_evidence", "A calls C."), ("t", 0, "supported", "A inherits from E."), ("u", 0, "insufficient_evidence", "U calls V.")]
    df = spark.createDataFrame(rows, "target string, position int, status string, statement string")
    got = {r.target: (r.claims, r.text) for r in evidence.narrative(df).collect()}
    assert got["t"][0] == 4 and got["t"][1].split("\n\n") == [
        "What could be established:\n- A inherits from E.\n- A calls B.",
        "What could not be established:\n- There was not sufficient deterministic evidence to establish that A calls C.",
        "What the evidence contradicts:\n- There is evidence that contradicts the claim that A calls D.",
    ]
    assert got["u"] == (1, "What could not be established:\n- There was not sufficient deterministic evidence to establish that U calls V.")


def test_support_of_claims_without_citations(spark):
    checked = spark.createDataFrame([(1, "file_range", True), (2, "guess", False)], "claim long, kind string, valid boolean")
    claims = spark.createDataFrame([(1, "verified"), (2, "verified"), (3, "verified")], "claim long, requested string")
    assert {r.claim: r.support for r in evidence.support(checked, claims).collect()} == {1: "verified", 2: "unsupported", 3: "not_inspected"}


def test_statements(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("direct_relation", "inherits"), ("reachability", "calls"), ("other", "calls")], "p string, k string")
    assert [r[0] for r in df.select(evidence.statement(F.col("p"), F.col("k"), F.lit("A"), F.lit("B"))).collect()] == ["A inherits from B.", "A reaches B through a call path.", None]


def test_sections_hold_what_a_narrative_says(spark):
    from orrery.operators import evidence

    rows = [("t", 2, "supported", "a calls b."), ("t", 1, "supported", "a calls c."), ("t", 1, "insufficient_evidence", "a calls d.."), ("t", 1, "contradicted", "a calls e"), ("t", 3, "unknown", "x"), ("u", 1, "contradicted", "z.")]
    df = spark.createDataFrame(rows, "target string, position int, status string, statement string")
    told = {}
    for r in evidence.sections(df).orderBy("target", "section", "position").collect():
        told.setdefault(r.target, {}).setdefault(r.title, []).append(r.line)
    text = {r.target: r.text for r in evidence.narrative(df).collect()}
    assert text == {k: "\n\n".join("\n".join([t, *lines]) for t, lines in v.items()) for k, v in told.items()}
