"""Claims, citations and how well they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import stable_id
from orrery.operators import spans


#: Kinds of citation.
CITED = ["source_region", "semantic_anchor", "parsed_symbol", "orientation_item", "file_range"]


def checked_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """citations (claim, citation, kind, ref, path, start_line, end_line, content_hash) with valid and reason.

    sources: (kind, ref, source_path, first_line, last_line, source_hash), one row for each of a kind. A reference must exist.
    Regions and file ranges must be cited by their own path, inside their lines and with their own hash, where a citation
    gives one; anchors, symbols and notes need only exist.
    """
    df = citations.join(sources.select("kind", "ref", "source_path", "first_line", "last_line", "source_hash", F.lit(True).alias("found")), ["kind", "ref"], "left")
    ranged = F.col("kind").isin("source_region", "file_range")
    a, b = F.col("start_line"), F.col("end_line")
    reason = (
        F.when(~F.col("kind").isin(CITED), "unsupported_kind")
        .when(F.col("ref").isNull(), "no_reference")
        .when(F.col("found").isNull(), "missing")
        .when(~ranged, "ok")
        .when((F.col("kind") == "file_range") & (a.isNull() | b.isNull()), "no_lines")
        .when(F.col("path") != F.col("source_path"), "other_path")
        .when(a < F.col("first_line"), "bad_start")
        .when(b > F.col("last_line"), "beyond_end")
        .when(b < a, "bad_end")
        .when(F.col("content_hash") != F.col("source_hash"), "other_hash")
        .otherwise("ok")
    )
    return df.select("claim", "citation", "kind", reason.alias("reason"), (reason == "ok").alias("valid"))


def support(checked: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim, citations, verified, support) of claims (claim, requested): sources verify, notes only orient, a bad citation spoils both.

    A claim without citations is not inspected. What no citation decides has the status that was asked for, but is never
    verified by asking.
    """
    real = F.col("valid") & (F.col("kind") != "orientation_item")
    notes = F.col("valid") & (F.col("kind") == "orientation_item")
    df = checked.groupBy("claim").agg(F.count(F.lit(1)).alias("citations"), F.count_if(real).alias("verified"), F.count_if(notes).alias("notes"), F.count_if(~F.col("valid")).alias("bad"))
    df = claims.join(df, "claim", "left").na.fill(0, ["citations", "verified", "notes", "bad"])
    status = (
        F.when(F.col("citations") == 0, "not_inspected")
        .when((F.col("bad") > 0) & (F.col("verified") > 0), "uncertain")
        .when((F.col("bad") > 0) & (F.col("notes") > 0), "orientation_only")
        .when(F.col("bad") > 0, "unsupported")
        .when(F.col("verified") > 0, "verified")
        .when(F.col("notes") > 0, "orientation_only")
        .when(F.col("requested") == "verified", "uncertain")
        .otherwise(F.col("requested"))
    )
    return df.select("claim", "citations", "verified", status.alias("support"))


def verified_relations(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """claims (claim, source, kind, target) with verdict and the smallest id of a resolved relation that states them."""
    known = relations.filter("status = 'resolved'").groupBy("source", "kind", "target").agg(F.min("id").alias("evidence"))
    df = claims.join(known, ["source", "kind", "target"], "left")
    return df.select("claim", F.when(F.col("evidence").isNotNull(), "supported").otherwise("insufficient").alias("verdict"), "evidence")


def fact(kind: Column, relation: Column, source: Column, target: Column, symbol: Column) -> Column:
    """What a piece of evidence is about: a relationship's kind and ends, or a span's symbol. Nulls are values here."""
    text = lambda *cs: F.array(*[c.cast("string") for c in cs])
    return F.struct(kind.alias("kind"), F.when(kind == "relationship", text(relation, source, target)).otherwise(text(symbol)).alias("ends"))


def matched_evidence(candidate: DataFrame, truth: DataFrame) -> DataFrame:
    """(claim, hop, c_hop): hops of the truth, and the candidate's pieces of the same claim, file and fact whose lines overlap them.

    Both sides are (claim, hop, file, fact, start_line, end_line), fact as by fact().
    """
    c = candidate.select("claim", "file", "fact", F.col("hop").alias("c_hop"), F.col("start_line").alias("b1"), F.col("end_line").alias("b2"))
    t = truth.select("claim", "file", "fact", "hop", F.col("start_line").alias("a1"), F.col("end_line").alias("a2"))
    return spans.overlaps(t, c, ["claim", "file", "fact"]).select("claim", "hop", "c_hop").distinct()


def scores(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """metric, value, numerator, denominator over truth (claim, expected) and candidates (claim, actual).

    A claim that is not attempted is missed. Values are null where nothing can be counted.
    """
    df = truth.join(candidates, "claim", "left")
    yes, said = F.col("expected") == "supported", F.coalesce(F.col("actual") == "supported", F.lit(False))
    other = ~yes & F.col("actual").isNotNull()
    parts = {
        "claim_support_precision": (yes & said, said),
        "claim_support_recall": (yes & said, yes),
        "unsupported_claim_acceptance_rate": (~yes & said, other),
        "correct_abstention_rate": (other & (F.col("actual") == F.col("expected")), other),
    }
    got = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"{m}_{i}") for m, pair in parts.items() for i, c in enumerate(pair)])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_0").alias("numerator"), F.col(f"{m}_1").alias("denominator")) for m in parts]))
    out = got.select(rows.alias("r")).select("r.*")
    return out.select("metric", F.round(F.try_divide("numerator", "denominator"), 6).alias("value"), "numerator", "denominator")


def confusion(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    return truth.join(candidates, "claim", "left").groupBy("expected", F.coalesce("actual", F.lit("abstained")).alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def novel(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    return candidates.join(truth.select("claim"), "claim", "left_anti")


#: Statuses of claims in the order of their sections, what heads a section, and what is put before a statement.
SECTIONS = [
    ("supported", "What could be established:", ""),
    ("insufficient_evidence", "What could not be established:", "There was not sufficient deterministic evidence to establish that "),
    ("contradicted", "What the evidence contradicts:", "There is evidence that contradicts the claim that "),
]


def sections(claims: DataFrame) -> DataFrame:
    """(target, section, title, position, line) from claims (target, position, status, statement): a row for each statement, as it is put in its section.

    What a target's text is made of, without bringing it together: a target with any number of claims is many rows. Sections
    are numbered in their order; in one of them lines go by position.
    """
    status = F.col("status")
    order, title, before = (F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in values]) for values in zip(*[((k, i), (k, t), (k, b)) for i, (k, t, b) in enumerate(SECTIONS)]))
    bare = F.when(before == "", F.col("statement")).otherwise(F.concat(F.regexp_replace("statement", r"\.+$", ""), F.lit(".")))
    df = claims.filter(status.isin([k for k, _, _ in SECTIONS]))
    return df.select("target", order.alias("section"), title.alias("title"), "position", F.concat(F.lit("- "), before, bare).alias("line"))


def narrative(claims: DataFrame) -> DataFrame:
    """(target, claims, text) from claims (target, position, status, statement): sections by status, each statement in its place.

    Every statement stays, and nothing is said that is not in one. A target's claims are one text, so one row: this is for the
    few targets that are shown, and sections() is what grows with claims.
    """
    row = F.struct("position", "statement")
    by = [F.sort_array(F.collect_list(F.when(F.col("status") == k, row))).alias(k) for k, _, _ in SECTIONS]
    df = claims.groupBy("target").agg(F.count(F.lit(1)).alias("claims"), *by)

    def section(status: str, title: str, before: str) -> Column:
        bare = (lambda x: F.regexp_replace(x["statement"], r"\.+$", "")) if before else (lambda x: x["statement"])
        lines = F.transform(status, lambda x: F.concat(F.lit(f"- {before}"), bare(x), F.lit("." if before else "")))
        return F.when(F.size(status) > 0, F.concat(F.lit(f"{title}\n"), F.array_join(lines, "\n")))

    return df.select("target", "claims", F.concat_ws("\n\n", *[section(*x) for x in SECTIONS]).alias("text"))


#: How a relation is spoken of.
VERBS = {"calls": "calls", "contains": "contains", "imports": "imports", "inherits": "inherits from"}
NOUNS = {"calls": "call", "contains": "containment", "imports": "import", "inherits": "inheritance"}
#: Propositions that may be put forward.
SHAPES = [("direct_relation", "calls"), ("direct_relation", "inherits"), ("reachability", "calls")]
#: What a grounded claim's status means for the claim.
GROUNDED = {"verified": "supported", "inferred": "supported", "orientation_only": "insufficient_evidence", "uncertain": "insufficient_evidence", "unsupported": "insufficient_evidence", "not_inspected": "insufficient_evidence"}
#: How sure a status is.
CONFIDENCE = {"verified": 1.0, "inferred": 0.65, "orientation_only": 0.65, "uncertain": 0.35}


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def statement(proposition: Column, kind: Column, subject: Column, target: Column) -> Column:
    """The one sentence that a proposition is rendered as."""
    direct = F.concat(subject, F.lit(" "), F.coalesce(_lookup(VERBS, kind), kind), F.lit(" "), target, F.lit("."))
    reach = F.concat(subject, F.lit(" reaches "), target, F.lit(" through a "), F.coalesce(_lookup(NOUNS, kind), kind), F.lit(" path."))
    return F.when(proposition == "direct_relation", direct).when(proposition == "reachability", reach)


def proposition_claims(propositions: DataFrame, relations: DataFrame, run_id: str = "run") -> DataFrame:
    """claim_id, statement, support_status, epistemic_type, evidence of direct propositions (source, kind, target).

    Only a resolved relation of just these ends and kind supports one; its wording is no part of a claim's id.
    """
    df = verified_relations(propositions.withColumn("claim", F.concat_ws(">", "source", "kind", "target")), relations)
    df = propositions.withColumn("claim", F.concat_ws(">", "source", "kind", "target")).join(df, "claim")
    key = F.concat_ws("|", F.lit("direct_relation"), "source", "kind", "target", F.lit(""))
    status = F.when(F.col("verdict") == "supported", "supported").otherwise("insufficient_evidence")
    return df.select(
        stable_id("claim", F.lit(run_id), F.lit("observed"), key).alias("claim_id"), "source", "kind", "target",
        statement(F.lit("direct_relation"), F.col("kind"), F.col("source"), F.col("target")).alias("statement"),
        status.alias("support_status"), F.lit("observed").alias("epistemic_type"), "evidence",
    )


def relation_evidence(relations: DataFrame, regions: DataFrame) -> DataFrame:
    """relation_id, source_entity_id, target_entity_id, relation_kind, resolution_status, region_id: relations as evidence.

    regions: (region_id, path, start_line, end_line). A relation's own span is looked up by its exact lines.
    """
    spans = regions.select("region_id", "path", F.col("start_line").alias("line"), F.col("end_line").alias("end"))
    df = relations.join(spans.filter("line = end").drop("end"), ["path", "line"], "left")
    return df.select(F.col("id").alias("relation_id"), F.col("source").alias("source_entity_id"), F.coalesce("target", "target_reference").alias("target_entity_id"), F.col("kind").alias("relation_kind"), F.col("status").alias("resolution_status"), "region_id")


def projected(grounded: DataFrame) -> DataFrame:
    """claim, support_status, epistemic_type from grounded claims (claim, support, evidence: how many citations gave a region).

    Without evidence no claim is supported; only one that a single piece verifies is observed.
    """
    status = F.when(F.col("evidence") == 0, "insufficient_evidence").otherwise(F.coalesce(_lookup(GROUNDED, F.col("support")), F.lit("insufficient_evidence")))
    kind = F.when((F.col("support") == "verified") & (F.col("evidence") == 1), "observed").otherwise("inferred")
    return grounded.select("claim", status.alias("support_status"), kind.alias("epistemic_type"))


def validated_proposals(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """proposals (proposal, proposition, kind, entities) with allowed, unknown (entities that evidence (entity) lacks) and valid."""
    allowed = F.lit(False)
    for p, k in SHAPES:
        allowed = allowed | ((F.col("proposition") == p) & (F.col("kind") == k))
    used = proposals.select("proposal", F.explode(F.array_distinct("entities")).alias("entity"))
    unknown = used.join(evidence.select("entity").distinct(), "entity", "left_anti").groupBy("proposal").agg(F.sort_array(F.collect_list("entity")).alias("unknown"))
    df = proposals.join(unknown, "proposal", "left").withColumn("unknown", F.coalesce("unknown", F.array().cast("array<string>"))).withColumn("allowed", allowed)
    return df.withColumn("valid", F.col("allowed") & (F.size("unknown") == 0))


def evidence_scores(candidate: DataFrame, truth: DataFrame) -> DataFrame:
    """evidence_correctness (pooled) and evidence_completeness (mean over claims of the share of hops that are matched).

    candidate, truth: rows as of matched_evidence(), of claims whose verdict is right.
    """
    both = matched_evidence(candidate, truth)
    right = both.select("claim", "c_hop").distinct().select(F.lit(1).alias("hit"), F.lit(0).alias("asked"))
    asked = candidate.join(truth.select("claim").distinct(), "claim", "left_semi").select(F.lit(0).alias("hit"), F.lit(1).alias("asked"))
    correct = right.unionByName(asked).agg(F.round(F.try_divide(F.sum("hit"), F.sum("asked")), 6).alias("value"))
    correct = correct.select(F.lit("evidence_correctness").alias("metric"), "value")
    per = truth.join(candidate.select("claim").distinct(), "claim", "left_semi").groupBy("claim").agg(F.count(F.lit(1)).alias("hops"))
    found = both.select("claim", "hop").distinct().groupBy("claim").agg(F.count(F.lit(1)).alias("found"))
    share = F.coalesce("found", F.lit(0)) / F.col("hops")
    complete = per.join(found, "claim", "left").agg(F.round(F.avg(share), 6).alias("value"))
    return correct.unionByName(complete.select(F.lit("evidence_completeness").alias("metric"), "value"))


def totals(grounded: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: verified and downgraded claims of grounded (support), citations that failed, and the mean confidence of a claim."""
    failed = checked.filter("not valid").select(F.lit(None).cast("string").alias("support"), F.lit(1).alias("failed"))
    df = grounded.select("support", F.lit(0).alias("failed")).unionByName(failed)
    s = F.col("support")
    sure = F.when(s.isNotNull(), F.coalesce(_lookup(CONFIDENCE, s), F.lit(0.0)))
    return df.agg(F.count_if(s == "verified").alias("verified"), F.count_if(~s.isin("verified", "inferred")).alias("downgraded"), F.sum("failed").alias("failures"), F.round(F.avg(sure), 6).alias("confidence"))


def span_audit(spans: DataFrame, symbols: DataFrame) -> DataFrame:
    """Spans (id, symbol, path, line) that do not lie inside their own symbol (symbol, path, start_line, end_line): none should."""
    s = symbols.select("symbol", F.col("path").alias("own_path"), "start_line", "end_line")
    df = spans.join(s, "symbol", "left")
    inside = (F.col("path") == F.col("own_path")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    return df.filter(~F.coalesce(inside, F.lit(False))).select("id", "symbol", "path", "line")
