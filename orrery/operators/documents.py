"""Joins and summaries of the map and of documents: components, their evidence, links, and what has gone stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import matching

#: Words of a component, and parts of a path that belong to it.
KEYWORDS = [
    (("api", "public", "convenience", "request"), ("_api", "__init__", "/api", "request")),
    (("client", "lifecycle", "sync", "async"), ("client", "session")),
    (("transport", "adapter", "boundary"), ("transport", "adapter")),
    (("auth", "cookie"), ("auth", "cookie")),
    (("model", "request", "response"), ("model", "request", "response")),
    (("config", "timeout", "limit"), ("config", "timeout", "limit")),
    (("url",), ("url",)),
    (("content", "decoder", "multipart"), ("content", "decoder", "multipart")),
    (("cli", "command"), ("_main", "cli", "command")),
    (("route", "backend", "api"), ("route", "router", "endpoint")),
    (("frontend", "screen", "page"), ("frontend", "page", ".svelte", ".tsx")),
    (("deployment", "infra"), ("docker", "compose", "deploy", "k8s")),
]


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | text.contains(p)
    return hit


def links(relationships: DataFrame, components: DataFrame) -> DataFrame:
    """(component, related, kind): relationships (a, b, label) from both ends; from the far one the kind ends in _by."""
    out = relationships.select(F.col("a").alias("component"), F.col("b").alias("related"), F.col("label").alias("kind"))
    back = relationships.filter("a <> b").select(F.col("b").alias("component"), F.col("a").alias("related"), F.concat("label", F.lit("_by")).alias("kind"))
    return out.unionByName(back).join(components.select(F.col("id").alias("related"), "name"), "related").select("component", "related", "kind", "name")


def rule_bits(text: Column, side: int) -> Column:
    """Numbers of the keyword rules whose words (side 0) or path parts (side 1) a text holds."""
    return F.array_compact(F.array(*[F.when(_any(F.lower(text), r[side]), F.lit(i)) for i, r in enumerate(KEYWORDS)]))


def stem(path: Column) -> Column:
    """A path's last part without its last ending, and without bars and hyphens around it."""
    leaf = F.element_at(F.split(F.lower(path), "/"), -1)
    return F.regexp_replace(F.regexp_replace(leaf, r"\.[^.]*$", ""), "^[_-]+|[_-]+$", "")


def regions_by_keyword(components: DataFrame, regions: DataFrame) -> DataFrame:
    """(component, region): a region's path is one of a component's own, a rule holds for both, or the component's text holds the path's stem.

    components: (component, text, paths), regions: (region, path). Paths and rules meet as keys; stems are sought by matching.
    """
    key = lambda rules, paths: F.array_distinct(F.concat(F.transform(rules, lambda i: F.concat(F.lit("rule:"), i.cast("string"))), F.transform(paths, lambda p: F.concat(F.lit("path:"), F.lower(p)))))
    a = components.select("component", F.explode(key(rule_bits(F.col("text"), 0), F.col("paths"))).alias("k"))
    b = regions.select("region", F.explode(key(rule_bits(F.col("path"), 1), F.array("path"))).alias("k"))
    stems = regions.select("region", stem(F.col("path")).alias("stem"))
    held = matching.contained(components.select(F.col("component").alias("id"), "text"), stems.select(F.col("stem").alias("pattern_id"), F.col("stem").alias("pattern")).distinct())
    by_stem = held.select(F.col("id").alias("component"), F.col("pattern_id").alias("stem")).join(stems, "stem").select("component", "region")
    return a.join(b, "k").select("component", "region").unionByName(by_stem).distinct()


def mentions(sources: DataFrame, symbols: DataFrame, least: int = 3, most: int = 40) -> DataFrame:
    """(source, symbol, name, rank): the first `most` symbols, by place, whose name the text of sources (source, text) holds in any case.

    symbols: (symbol, name, place). A name has `least` characters or more, of any kind; a symbol does not mention itself.
    """
    named = symbols.filter(F.length("name") >= least)
    held = matching.contained(sources.select(F.col("source").alias("id"), "text"), named.select(F.lower("name").alias("pattern_id"), F.col("name").alias("pattern")).distinct())
    hit = held.select(F.col("id").alias("source"), F.col("pattern_id").alias("low")).distinct().join(named.withColumn("low", F.lower("name")), "low").filter("symbol <> source")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("place", "symbol"))
    return hit.withColumn("rank", rank).filter(F.col("rank") <= most).select("source", "symbol", "name", "rank")


def claims_of_components(claims: DataFrame, citations: DataFrame, components: DataFrame) -> DataFrame:
    """(component, claim): the claim's text holds the component's label, or the component's text holds a path that the claim cites, in any case.

    claims: (claim, text), citations: (claim, path), components: (component, label, text); a component's text is its label,
    summary, duties and paths.
    """
    named = matching.contained(claims.select(F.col("claim").alias("id"), "text"), components.select(F.col("component").alias("pattern_id"), F.col("label").alias("pattern")))
    cited = citations.filter("path <> ''").select("claim", F.lower("path").alias("path")).distinct()
    placed = matching.contained(components.select(F.col("component").alias("id"), "text"), cited.select(F.col("path").alias("pattern_id"), F.col("path").alias("pattern")).distinct())
    placed = placed.select(F.col("id").alias("component"), F.col("pattern_id").alias("path")).join(cited, "path").select("component", "claim")
    return named.select(F.col("pattern_id").alias("component"), F.col("id").alias("claim")).unionByName(placed).distinct()


def component_evidence(rows: DataFrame, most: int = 40) -> DataFrame:
    """component, region, origin, score of rows (component, region, origin, place, confidence, verified).

    Of one region the first origin counts: the component's own regions, then claims, then anchors. The first `most` rows are
    what a reader is shown.
    """
    order = F.when(F.col("origin") == "component_source_region", 0).when(F.col("origin") == "grounded_claim", 1).otherwise(2)
    score = F.when(order == 0, 1.0).when(order == 1, F.when(F.col("verified"), 0.95).otherwise(0.55)).otherwise(F.col("confidence"))
    best = rows.withColumn("o", order).withColumn("score", score).groupBy("component", "region").agg(F.min(F.struct("o", "place", "origin", "score")).alias("x"))
    rank = F.row_number().over(Window.partitionBy("component").orderBy("x.o", "x.place", "region"))
    return best.withColumn("r", rank).filter(F.col("r") <= most).select("component", "region", "x.origin", "x.score")


def node_status(support: Column, evidence: Column, overview: Column) -> Column:
    return (
        F.when(overview == "degraded_no_llm", "insufficient")
        .when(support == "orientation_only", "candidate")
        .when(support == "unsupported", "unsupported")
        .when(evidence > 0, "verified")
        .otherwise("insufficient")
    )


def node_kind(label: Column) -> Column:
    low = F.lower(label)
    return F.when(_any(low, ("external", "transport", "provider", "api client")), "external_boundary").when(_any(low, ("auth", "config", "observability", "logging")), "cross_cutting").otherwise("component")


def diagnostics(nodes: DataFrame) -> DataFrame:
    """One row over nodes (id, status, evidence): counts by status, and how many stand without evidence."""
    n = lambda s: F.count_if(F.col("status") == s)
    return nodes.agg(n("verified").alias("verified"), n("insufficient").alias("insufficient"), n("unsupported").alias("unsupported"), F.count_if(F.col("evidence") == 0).alias("without_evidence"))


def module_summary(modules: DataFrame, symbols: DataFrame, shown: int = 8) -> DataFrame:
    """path, summary from modules (path, language) and symbols (path, name, place): the first names, and how many more."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy("place", "name"))
    names = symbols.withColumn("r", rank).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("r") <= shown, F.struct("r", "name")))).alias("x"))
    df = modules.join(names, "path", "left")
    more = F.when(F.col("n") > shown, F.concat(F.lit(", and "), F.col("n") - shown, F.lit(" more"))).otherwise("")
    some = F.concat(F.col("path"), F.lit(" defines "), F.array_join(F.transform("x", lambda x: x["name"]), ", "), more, F.lit("."))
    none = F.concat(F.col("path"), F.lit(" is a "), F.col("language"), F.lit(" module with no parsed declarations."))
    return df.select("path", F.when(F.col("n") > 0, some).otherwise(none).alias("summary"))


def anchor_components(anchors: DataFrame, shown: int = 12) -> DataFrame:
    """kind, label, anchors, paths: anchors (kind, path, place) grouped by kind, with the distinct paths of the first ones."""
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("place", "path"))
    df = anchors.withColumn("r", rank).groupBy("kind").agg(F.count(F.lit(1)).alias("anchors"), F.sort_array(F.collect_list(F.when(F.col("r") <= shown, F.struct("r", "path")))).alias("x"))
    paths = F.array_distinct(F.transform("x", lambda x: x["path"]))
    return df.select("kind", F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))).alias("label"), "anchors", F.array_join(paths, ",").alias("paths"))


def packages(symbols: DataFrame) -> DataFrame:
    """id, kind, files, symbols: a directory for each package that holds files with symbols (path), and the files at the top."""
    up = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    kind = F.when(up == "", "module").otherwise("package")
    return symbols.groupBy(F.when(up == "", F.col("path")).otherwise(up).alias("id"), kind.alias("kind")).agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("symbols"))


def stale(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """id, state of documents (id, source, source_hash) against sources (source, hash): fresh, stale, or orphaned where the source is gone."""
    df = documents.join(sources, "source", "left")
    return df.select("id", F.when(F.col("hash").isNull(), "orphaned").when(F.col("hash") == F.col("source_hash"), "fresh").otherwise("stale").alias("state"))


def valid_label(label: Column, description: Column) -> Column:
    """Whether an interpretation has a label of 2 to 8 words and a description of at most 1200 characters."""
    words = F.size(F.filter(F.split(label, r"\s+"), lambda x: x != ""))
    return F.coalesce(words.between(2, 8) & (F.trim(description) != "") & (F.length(description) <= 1200), F.lit(False))
