"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.lineage import durable

__all__ = ["SPACE", "WORD", "dealt", "durable", "fold", "fresh", "small", "spread_join", "table", "words"]
#: Characters that end a word.
SPACE = r"[\x20\x09-\x0D]"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(scan: DataFrame, rows: int = 4096) -> DataFrame:
    """scan, a table as it is read, its rows dealt out anew where one task gets over `rows` of them and twice a core's share.

    A file's row group is never cut, and a table may be one of them: all work up to the first shuffle would be one task, and
    what that writes would be one task again. Rows are counted without reading a column. Rows go by their number within what
    was read, so copies and hot keys are dealt like any others, and a table that lies in even parts is not moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    per = scan.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    most, total = per.agg(F.max("n"), F.sum("n")).first()
    if not total or most <= max(rows, 2 * total / cores):
        return scan
    row = fresh(scan, "dealt_row")
    return scan.withColumn(row, F.monotonically_increasing_id()).repartition(max(4 * cores, -(-total // rows)), row).drop(row)


def words(text: Column) -> Column:
    """Words of a text in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), "")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def small(df: DataFrame, limit: int) -> bool:
    """Whether a side may be broadcast: it has at most `limit` rows."""
    return len(df.limit(limit + 1).select(F.lit(1)).groupBy().count().filter(F.col("count") <= limit).take(1)) == 1


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever extra columns callers bring."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", most: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has one row a key at most, though a key may hold a third of left's rows.

    Keys with more than one in `most` of left's rows, fewer than `most` by that, have their rows of right broadcast; all other
    rows are shuffled. left is read twice, so it should be durable or a scan. counts (key, rows_), where they are known, save
    counting. Null keys match nothing.
    """
    per = left.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("rows_")) if counts is None else counts
    total = per.agg(F.sum("rows_").alias("n")).first()["n"] or 0
    hot = durable(per.filter(F.col("rows_") > max(most, total / most)).select(F.col(on), F.lit(True).alias("hot_")))
    if not hot.take(1):
        return left.join(right, on, how)
    marked = left.join(F.broadcast(hot), on, "left")
    heavy = marked.filter("hot_").drop("hot_").join(F.broadcast(right.join(F.broadcast(hot), on, "left_semi")), on, how)
    return marked.filter("hot_ is null").drop("hot_").join(right, on, how).unionByName(heavy)
