"""A positional index of words, written once, and searches that read nothing else until texts are shown."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.lineage import durable

#: Folders of a written index; a word is in one of them.
BUCKETS = 64


def _posted(id_type: str):
    def rows(batches: Iterator) -> Iterator:
        """Postings of each row's text, in batches of some ten thousand words."""
        import re

        import pyarrow as pa

        def batch(ids, terms, positions):
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ids, kind), pa.array(positions, pa.list_(pa.int32()))], names=["term", "id", "positions"])

        for x in batches:
            kind, ids, terms, positions, words = x.schema.field("id").type, [], [], [], 0
            for i, text in zip(x.column("id"), x.column("low")):
                at: dict[str, list[int]] = {}
                for n, word in enumerate(re.findall("[a-z0-9]+", text.as_py())):
                    at.setdefault(word, []).append(n)
                    words += 1
                ids += [i.as_py()] * len(at)
                terms += at.keys()
                positions += at.values()
                if words > 50_000:
                    yield batch(ids, terms, positions)
                    ids, terms, positions, words = [], [], [], 0
            yield batch(ids, terms, positions)

    return rows, f"term string, id {id_type}, positions array<int>"


def index(texts: DataFrame) -> DataFrame:
    """term, id, positions: where each word, a run of letters a-z and digits in any case, stands in texts (id, text).

    A text's postings are made where it is read, so no word moves; only those of ids with several texts are brought together.
    """
    rows, schema = _posted(texts.schema["id"].dataType.simpleString())
    every = texts.filter("id is not null and text is not null")
    posted = every.select("id", F.lower("text").alias("low")).mapInArrow(rows, schema)
    twice = durable(every.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"))
    if not twice.take(1):
        return posted
    several = posted.join(twice, "id", "left_semi").groupBy("term", "id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return posted.join(twice, "id", "left_anti").select("term", "id", "positions").unionByName(several)


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write(postings: DataFrame, path: str) -> None:
    """Writes an index so that the postings of a word lie in one folder, side by side.

    A folder's rows are spread over tasks by word and id, so a word of every text is not one task's work.
    """
    df = postings.withColumn("bucket", _bucket(F.col("term")))
    df.repartitionByRange("bucket", "term", F.xxhash64("id")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The postings of some words: only their folders are listed and only their row groups are read."""
    df = spark.read.parquet(path)
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()] if terms else []
    return df.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket")


def words_in_order(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def phrase(postings: DataFrame, text: str) -> DataFrame:
    """ids of what holds the words of a phrase one after another: positions, less their place in the phrase, agree for all."""
    words = words_in_order(text)
    places = F.create_map(*[x for w in dict.fromkeys(words) for x in (F.lit(w), F.array(*[F.lit(i) for i, v in enumerate(words) if v == w]))])
    hit = postings.filter(F.col("term").isin(words)).select("id", F.explode("positions").alias("at"), F.element_at(places, F.col("term")).alias("places"))
    starts = hit.select("id", F.explode("places").alias("place"), "at").select("id", (F.col("at") - F.col("place")).alias("start"), "place").filter("start >= 0")
    return starts.groupBy("id", "start").agg(F.countDistinct("place").alias("n")).filter(F.col("n") == len(words)).select("id").distinct()


def phrases(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """asked's other columns and id: texts that hold the words (array) of a row of asked one after another, for many rows at once.

    The rarest word of each phrase finds the texts; only there the other words' positions are looked up.
    """
    others = [c for c in asked.columns if c != "words"]
    q = asked.filter(F.size("words") > 0).withColumn("phrase", F.array_join("words", " "))
    each = q.select("phrase", "words").distinct().select("phrase", F.size("words").alias("length"), F.posexplode("words").alias("place", "term"))
    per = postings.join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rare = each.join(per, "term", "left").groupBy("phrase").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.min_by(F.struct("term", "place"), F.struct("n", "place")).alias("r")).filter("absent = 0")
    starts = postings.join(rare.select("phrase", F.col("r.term").alias("term"), F.col("r.place").alias("place")), "term").select("phrase", "id", F.explode("positions").alias("at"), "place")
    starts = starts.select("phrase", "id", (F.col("at") - F.col("place")).alias("start")).filter("start >= 0")
    hit = starts.join(each, "phrase").join(postings, ["term", "id"]).filter(F.array_contains("positions", F.col("start") + F.col("place")))
    full = hit.groupBy("phrase", "id", "start", "length").agg(F.count(F.lit(1)).alias("n")).filter("n = length").select("phrase", "id").distinct()
    return q.join(full, "phrase").select(*others, "id")


def search(postings: DataFrame, every: list[str] = (), some: list[str] = (), none: list[str] = (), phrases: list[str] = ()) -> DataFrame:
    """ids of what holds every word of `every`, one of `some` if given, none of `none`, and all phrases.

    Without every, some or a phrase nothing is asked for and nothing is found. Each condition is a set of ids from postings alone.
    """
    low = lambda words: [w.lower() for w in words]
    held = []
    if every:
        of = postings.filter(F.col("term").isin(low(every)))
        held.append(of.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(set(low(every)))).select("id"))
    if some:
        held.append(postings.filter(F.col("term").isin(low(some))).select("id").distinct())
    held += [phrase(postings, p) for p in phrases]
    if not held:
        return postings.select("id").limit(0)
    out = held[0]
    for h in held[1:]:
        out = out.join(h, "id", "left_semi")
    return out.join(postings.filter(F.col("term").isin(low(none))).select("id"), "id", "left_anti") if none else out


def snippets(texts: DataFrame, found: DataFrame, sought: str, around: int = 40) -> DataFrame:
    """id, snippet: what stands around the first place of a word or phrase in the texts (id, text) that were found (id)."""
    at = F.instr(F.lower("text"), sought.lower())
    cut = F.substring(F.col("text"), F.greatest(F.lit(1), at - around), F.lit(2 * around))
    return texts.join(found, "id", "left_semi").select("id", F.regexp_replace(cut, r"[ \t\n\r\f\x0B]+", " ").alias("snippet"))
