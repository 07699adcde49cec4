"""Claims made from propositions: what relations prove, hop by hop, and the evidence that a claim then carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import stable_id
from orrery.operators import evidence, graph

#: Kinds of propositions and of relations that may be put forward, and the words of verdicts.
PROPOSITIONS = ["direct_relation", "reachability"]
RELATIONS = ["contains", "imports", "calls", "inherits"]
ASSERTED = "caller-asserted contradiction (see assert_contradicted=True); not adapter-detected"
NO_EVIDENCE = "cannot assert support_status='contradicted' with zero evidence items"


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def verified(propositions: DataFrame, relations: DataFrame) -> DataFrame:
    """claim, hops, matched, supported, reason, chain of propositions (claim, proposition, kind, path) against relations.

    path is the array of entities from the subject to the object, two of them for a direct relation. A hop holds by a resolved
    relation of just its ends and kind, the one of smallest id; chain has the ids of the hops before the first gap, in order.
    A direct relation is not proved by a way over other entities, and a path with one gap is not supported at all.
    """
    steps = propositions.select("claim", "proposition", "kind", F.posexplode("path").alias("at", "source"))
    steps = steps.withColumn("target", F.lead("source").over(Window.partitionBy("claim").orderBy("at"))).filter("target is not null")
    known = graph.resolved(relations).groupBy("source", "target", "kind").agg(F.min("id").alias("relation"))
    hop = F.struct("at", "source", "target", "relation")
    df = steps.join(known, ["source", "target", "kind"], "left").groupBy("claim", "proposition", "kind").agg(F.sort_array(F.collect_list(hop)).alias("hops"), F.min(F.when(F.col("relation").isNull(), F.struct("at", "source", "target"))).alias("gap"))
    n = F.size("hops")
    matched = F.coalesce(F.col("gap.at"), n)
    kind, gap = _quoted(F.col("kind")), (_quoted(F.col("gap.source")), _quoted(F.col("gap.target")))
    ends = (_quoted(F.element_at("hops", 1)["source"]), _quoted(F.element_at("hops", 1)["target"]))
    direct = F.when(matched == n, F.concat(F.lit("found a resolved "), kind, F.lit(" relation directly connecting "), ends[0], F.lit(" to "), ends[1])).otherwise(
        F.concat(F.lit("no resolved "), kind, F.lit(" relation directly connects "), ends[0], F.lit(" to "), ends[1], F.lit(" (a multi-hop path, or a partial/unresolved relation, does not satisfy a direct_relation proposition)"))
    )
    way = F.when(matched == n, F.concat(F.lit("all "), n, F.lit(" hop(s) in the path are resolved and connected in order"))).otherwise(
        F.concat(F.lit("no resolved "), kind, F.lit(" relation found for hop "), gap[0], F.lit(" -> "), gap[1], F.lit("; "), matched, F.lit("/"), n, F.lit(" preceding hop(s) were matched before this gap"))
    )
    chain = F.transform(F.slice("hops", F.lit(1), matched), lambda h: h["relation"])
    return df.select("claim", n.alias("hops"), matched.alias("matched"), (matched == n).alias("supported"), F.when(F.col("proposition") == "direct_relation", direct).otherwise(way).alias("reason"), chain.alias("chain"))


def claims(propositions: DataFrame, relations: DataFrame, run: str = "run") -> DataFrame:
    """claim, claim_id, statement, support_status, epistemic_type, reasoning, chain of propositions (claim, proposition, kind, path, refuted).

    refuted is null, or the ids of relations that a caller brings against the claim: such a claim is contradicted without any
    check, with all of them as its chain, but is rejected where there are none. A claim that names a relation of another run
    is rejected as a whole. The sentence is made from the proposition alone, so no verdict changes what is said.
    """
    asked = propositions.filter("refuted is null")
    checked = verified(asked, relations.filter(F.col("run_id") == run)).select("claim", "supported", "reason", "chain")
    brought = propositions.filter("refuted is not null")
    cited = brought.select("claim", F.explode("refuted").alias("id")).distinct().join(relations.select("id", "run_id"), "id", "left")
    foreign = cited.groupBy("claim").agg(F.count_if(F.coalesce(F.col("run_id") != run, F.lit(True))).alias("foreign"))
    out = propositions.join(checked, "claim", "left").join(foreign, "claim", "left")
    against = F.col("refuted").isNotNull()
    status = (
        F.when(against & (F.size("refuted") == 0), "rejected").when(F.coalesce(F.col("foreign") > 0, F.lit(False)), "rejected").when(against, "contradicted")
        .when(F.col("supported"), "supported").otherwise("insufficient_evidence")
    )
    reason = F.when(against & (F.size("refuted") == 0), NO_EVIDENCE).when(status == "rejected", F.lit("relation of another run")).when(against, ASSERTED).when(F.col("supported"), "").otherwise(F.col("reason"))
    subject, target = F.element_at("path", 1), F.element_at("path", -1)
    inner = F.when(F.col("proposition") == "reachability", F.array_join("path", ",")).otherwise("")
    key = F.concat_ws("|", "proposition", subject, "kind", target, inner)
    chain = F.when(status == "rejected", F.array().cast("array<string>")).when(against, F.col("refuted")).otherwise(F.col("chain"))
    return out.select(
        "claim", stable_id("claim", F.lit(run), F.lit("observed"), key).alias("claim_id"), evidence.statement(F.col("proposition"), F.col("kind"), subject, target).alias("statement"),
        status.alias("support_status"), F.lit("observed").alias("epistemic_type"), reason.alias("reasoning"), chain.alias("chain"),
    )


def chains(made: DataFrame, relations: DataFrame, regions: DataFrame) -> DataFrame:
    """claim, hop, relation, source, target, kind, region: the evidence of claims() in order, with the region (region_id, path, start_line, end_line) of a relation's own line."""
    hops = made.select("claim", F.posexplode("chain").alias("hop", "id"))
    own = regions.filter("start_line = end_line").select("path", F.col("start_line").alias("line"), F.col("region_id").alias("region"))
    df = hops.join(relations.select("id", "source", F.coalesce("target", "target_reference").alias("target"), "kind", "path", "line"), "id").join(own, ["path", "line"], "left")
    return df.select("claim", "hop", F.col("id").alias("relation"), "source", "target", "kind", "region")


def bounded(relations: DataFrame, symbols: DataFrame, targets: DataFrame, steps: int = 2) -> tuple[DataFrame, DataFrame]:
    """What a proposer is shown of each target (target): entities (target, entity) and relations (target, id).

    All that `steps` relations of any status reach in either direction, the target itself, and its parent with the parent's
    children, by symbols (id, parent). Relations are those that touch an entity before the last step.
    """
    known = relations.select("id", F.col("source").alias("a"), F.col("target").alias("b"))
    ends = known.select("id", "a", "b").unionByName(known.filter("b is not null").select("id", F.col("b").alias("a"), F.col("a").alias("b")))
    front = targets.select("target", F.col("target").alias("entity")).distinct()
    seen, shown = front, None
    for _ in range(steps):
        touched = ends.join(front.select("target", F.col("entity").alias("a")), "a").select("target", "id", F.col("b").alias("entity"))
        shown = touched.select("target", "id") if shown is None else shown.unionByName(touched.select("target", "id"))
        front = touched.filter("entity is not null").select("target", "entity").distinct().join(seen, ["target", "entity"], "left_anti")
        seen = seen.unionByName(front)
    parent = targets.join(symbols.select(F.col("id").alias("target"), "parent"), "target").filter("parent is not null").select("target", "parent").distinct()
    siblings = parent.join(symbols.select("parent", F.col("id").alias("entity")), "parent").select("target", "entity")
    seen = seen.unionByName(parent.select("target", F.col("parent").alias("entity"))).unionByName(siblings).distinct()
    return seen, (shown if shown is not None else seen.select("target", F.lit(None).cast("string").alias("id")).limit(0)).distinct()


#: What a reply of a proposer holds; items that are no such object are kept apart.
REPLY = "proposals array<string>"
ITEM = "proposition struct<kind:string,subject_entity_id:string,relation_kind:string,object_entity_id:string,path_entity_ids:array<string>>, proposed_statement string, broken string"


def parsed_proposals(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposals (reply, item, proposition, kind, path) from replies (reply, text), JSON texts, and what was left out (reply, item, reason).

    An item that is no object, has a null or missing part, a kind that is not known, or a path that does not lead from its
    subject to its object is left out by itself; a text without a list of proposals is left out whole, with a null item.
    """
    df = replies.select("reply", F.from_json("text", REPLY, {"mode": "PERMISSIVE"}).alias("r"))
    none = df.filter("r.proposals is null").select("reply", F.lit(None).cast("int").alias("item"), F.lit("no list of proposals").alias("reason"))
    items = df.select("reply", F.posexplode("r.proposals").alias("item", "raw"))
    items = items.withColumn("x", F.from_json("raw", ITEM, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    p = F.col("x.proposition")
    subject, target = p["subject_entity_id"], p["object_entity_id"]
    way = F.coalesce(p["path_entity_ids"], F.array().cast("array<string>"))
    direct = p["kind"] == "direct_relation"
    reason = (
        F.when(F.col("x").isNull() | F.col("x.broken").isNotNull() | ~F.coalesce(F.trim("raw").startswith("{"), F.lit(False)), "no object")
        .when(p.isNull(), "no proposition")
        .when(~F.coalesce(p["kind"].isin(PROPOSITIONS), F.lit(False)), "unknown kind")
        .when(~F.coalesce(p["relation_kind"].isin(RELATIONS), F.lit(False)), "unknown relation")
        .when((F.coalesce(subject, F.lit("")) == "") | (F.coalesce(target, F.lit("")) == ""), "no subject or object")
        .when(direct & (F.size(way) > 0), "a direct relation has no path")
        .when(~direct & (F.size(way) < 2), "a path has two entities at least")
        .when(~direct & (~F.coalesce(F.element_at(way, 1) == subject, F.lit(False)) | ~F.coalesce(F.element_at(way, -1) == target, F.lit(False))), "a path leads from its subject to its object")
    )
    items = items.withColumn("reason", reason)
    good = items.filter("reason is null").select("reply", "item", p["kind"].alias("proposition"), p["relation_kind"].alias("kind"), F.when(direct, F.array(subject, target)).otherwise(way).alias("path"))
    return good, none.unionByName(items.filter("reason is not null").select("reply", "item", "reason"))


def verified_targets(replies: DataFrame, relations: DataFrame, symbols: DataFrame, run: str = "run", steps: int = 2) -> tuple[DataFrame, DataFrame]:
    """Claims (target, item and the columns of claims()) for replies (target, text) about targets, and what was left out (target, item, reason).

    A proposal that names an entity which its target's bounded evidence lacks is left out; the others are checked against all
    relations of the run and not against the evidence alone.
    """
    own = relations.filter(F.col("run_id") == run)
    good, bad = parsed_proposals(replies.withColumnRenamed("target", "reply"))
    shown, _ = bounded(own, symbols, replies.select("target").distinct(), steps)
    used = good.select("reply", "item", F.explode(F.array_distinct("path")).alias("entity"))
    unknown = used.join(shown.select(F.col("target").alias("reply"), "entity"), ["reply", "entity"], "left_anti").select("reply", "item").distinct()
    kept = good.join(unknown, ["reply", "item"], "left_anti")
    made = claims(kept.select(F.struct("reply", "item").alias("claim"), "proposition", "kind", "path", F.lit(None).cast("array<string>").alias("refuted")), own, run)
    out = bad.unionByName(unknown.select("reply", "item", F.lit("entity that was not shown").alias("reason")))
    return made.select(F.col("claim.reply").alias("target"), F.col("claim.item").alias("item"), *made.columns[1:]), out.withColumnRenamed("reply", "target")
