"""Ranked retrieval over lines and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import CONCEPTS, query_terms, tokens

#: Weight of each field, and the factor of a term that only means the same.
WEIGHTS = {"name": 8.0, "qualified_name": 6.0, "path": 4.0, "signature": 3.0, "source": 1.5}
SYNONYM = 0.65
ACTIONS = ["call", "import", "reference", "use"]


def _term_score(term: str, sets: dict[str, Column]) -> Column:
    best = F.lit(0.0)
    for concept in CONCEPTS.get(term, [term]):
        factor = 1.0 if concept == term else SYNONYM
        for field, weight in WEIGHTS.items():
            best = F.greatest(best, F.when(F.array_contains(sets[field], concept), weight * factor).otherwise(0.0))
    return best


def local_search(candidates: DataFrame, question: str, k: int = 10) -> DataFrame:
    """rank, id, score, confidence of the k best of candidates (id, kind, name, qualified_name, path, signature, source, start_line).

    Every term scores its best field; terms found add up to 4 more; a question about uses prefers sources that hold its
    target over the target itself. No term, no result. Ties go by path, line, name and id.
    """
    terms = query_terms(question)
    targets = [t for t in terms if t not in ACTIONS]
    df = candidates
    for field in WEIGHTS:
        df = df.withColumn(f"_{field}", F.array_distinct(tokens(F.col(field))))
    sets = {field: F.col(f"_{field}") for field in WEIGHTS}
    for i, t in enumerate(terms):
        df = df.withColumn(f"_t{i}", _term_score(t, sets))
    scores = [F.col(f"_t{i}") for i in range(len(terms))]
    matched = sum([F.when(s > 0, 1).otherwise(0) for s in scores], F.lit(0))
    score = sum(scores, F.lit(0.0)) + (4.0 * matched / max(1, len(terms)))
    if targets and len(targets) < len(terms):
        held, named = F.lit(True), F.lit(True)
        for t in targets:
            held = held & F.arrays_overlap(sets["source"], F.array(*map(F.lit, CONCEPTS.get(t, [t]))))
            named = named & F.array_contains(sets["name"], t)
        score = score + F.when(held, F.when(named, -4.0).otherwise(9.0)).otherwise(0.0)
    df = df.withColumn("score", F.round(score, 6))
    df = df.withColumn("score", F.when((F.col("kind") == "module") & (F.col("score") > 0), F.col("score") + 0.25).otherwise(F.col("score"))).filter("score > 0")
    top = df.orderBy(F.desc("score"), "path", "start_line", "name", "id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "path", "start_line", "name", "id"))
    return top.select(rank.alias("rank"), "id", "score", F.round(F.least(F.lit(1.0), 0.35 + F.col("score") / 24), 6).alias("confidence"))


def search_files(files: DataFrame, query: str, k: int = 20) -> DataFrame:
    """path, score: one for each term in the path, 0.2 more for production files; files without a term are left out."""
    terms = query.lower().split()
    score = sum([F.when(F.lower("path").contains(t), 1.0).otherwise(0.0) for t in terms], F.lit(0.0))
    df = files.withColumn("score", score).filter("score > 0").withColumn("score", F.round(F.col("score") + F.when(F.col("role") == "production", 0.2).otherwise(0.0), 6))
    return df.orderBy(F.desc("score"), "path").limit(k).select("path", "score")


def search_code(lines: DataFrame, query: str, k: int | None = 20) -> DataFrame:
    """path, line, score of lines (path, role, line, text) that hold every term; early lines and production files first."""
    terms = query.lower().split()
    every = F.lit(bool(terms))
    for t in terms:
        every = every & F.lower("text").contains(t)
    score = F.lit(float(len(terms))) + F.when(F.col("role") == "production", 0.4).otherwise(0.0) + F.when(F.col("line") <= 20, 0.1).otherwise(0.0)
    df = lines.filter(every).select("path", "line", F.round(score, 6).alias("score"))
    return df if k is None else df.orderBy(F.desc("score"), "path", "line").limit(k)


def find_definition(symbols: DataFrame, query: str, k: int = 20) -> DataFrame:
    """id, score: one for each term in name and qualified name, three more where the name is the query."""
    terms = query.lower().split()
    text = F.lower(F.concat_ws(" ", "name", "qualified_name"))
    score = sum([F.when(text.contains(t), 1.0).otherwise(0.0) for t in terms], F.lit(0.0)) + F.when(F.lower("name") == query.lower(), 3.0).otherwise(0.0)
    return symbols.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "path", "id").limit(k).select("id", "score")


def find_references(lines: DataFrame, name: str, path: str | None = None, k: int = 20) -> DataFrame:
    """Lines that name a symbol, in one file where a path is given. The limit comes before that choice, as callers know it."""
    hits = search_code(lines, name, k)
    return (hits if path is None else hits.filter(F.col("path") == path)).withColumn("score", F.round(F.greatest(F.lit(0.1), F.col("score") - 0.5), 6))


def outline(lines: DataFrame, pattern: str) -> DataFrame:
    """path, start_line, end_line, title: a section begins at each line that fits and ends before the next one."""
    last = lines.groupBy("path").agg(F.max("line").alias("last"))
    starts = lines.filter(F.col("text").rlike(pattern)).select("path", F.col("line").alias("start_line"), F.substring("text", 1, 80).alias("title"))
    end = F.lead("start_line").over(Window.partitionBy("path").orderBy("start_line")) - 1
    return starts.withColumn("e", end).join(last, "path").select("path", "start_line", F.coalesce("e", "last").alias("end_line"), "title")


def regions(lines: DataFrame, around: int) -> DataFrame:
    """Every line's region of `around` lines to both sides, inside its file."""
    last = lines.groupBy("path").agg(F.max("line").alias("last"))
    return lines.join(last, "path").select("path", "line", F.greatest(F.lit(1), F.col("line") - around).alias("start_line"), F.least("last", F.col("line") + around).alias("end_line"))


def matching_components(components: DataFrame, question: str, k: int = 10) -> DataFrame:
    """id, score of components (id, label, summary, responsibilities): shared words count 3 in labels, 2 in summaries, 1 in each responsibility."""
    import re

    terms = F.array(*[F.lit(w) for w in sorted({w for w in re.split("[^a-z0-9]+", question.lower()) if len(w) >= 3})])
    shared = lambda c: F.size(F.array_intersect(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+")), terms))
    duties = F.aggregate(F.transform("responsibilities", shared), F.lit(0), lambda a, x: a + x)
    df = components.withColumn("score", (3 * shared(F.col("label")) + 2 * shared(F.col("summary")) + duties).cast("long"))
    return df.filter("score > 0").orderBy(F.desc("score"), "id").limit(k).select("id", "score")
