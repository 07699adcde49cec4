"""Keeping runs: replacement by run, claims of a repository, which run answers, and repair after an interruption."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States of a job that an interruption ends, and what is noted then.
OPEN = ["queued", "running"]
INTERRUPTED = "Analysis was interrupted by a backend restart."


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row written last for each key: that with the largest `order`, a number of the write, then the larger of its other values. Null keys count as one key.

    Rows meet as one maximum per key, combined before they move, so a key that is written over and over is no task's whole work.
    """
    others = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *others)).alias("last_")).select(*[F.col(k) if k in keys else F.col(f"last_.{k}").alias(k) for k in rows.columns])


def upserted(kept: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """kept with new's rows put in by key: of all rows of a key, in either, the one written last stays."""
    return latest(kept.unionByName(new, allowMissingColumns=True), keys, order)


def replaced(kept: DataFrame, new: DataFrame, key: str = "run_id", order: str | None = None) -> DataFrame:
    """kept with all rows of the runs in new replaced by new's; with order, of new's rows of one id the one written last."""
    rows = new.dropDuplicates() if order is None else latest(new, [key, "id"], order)
    return kept.join(new.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


#: The folder of a store that holds which generation of each run counts.
COMMITS = "commits"


def write_runs(df: DataFrame, path: str, order: str | None = None) -> str:
    """Writes df (run_id, id, ...) as a new generation of its runs, and returns its name. With order, of rows of one id the last written stays.

    Rows go to a folder of their own, which no reader looks at before the commit: a small table of (run_id, generation, at)
    that is written after all of them. So a reader sees a run as it was or as it is, never half of it, and a lost job leaves
    only a folder that nobody reads. Other runs are not touched.
    """
    spark = df.sparkSession
    rows = df.dropDuplicates() if order is None else latest(df, ["run_id", "id"], order)
    generation = uuid.uuid4().hex
    rows.write.partitionBy("run_id").parquet(f"{path}/rows/generation={generation}")
    written = spark.read.parquet(f"{path}/rows/generation={generation}").select(F.col("run_id").cast("string").alias("run_id")).distinct()
    written.select("run_id", F.lit(generation).alias("generation"), F.lit(time.time_ns()).alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/{COMMITS}")
    return generation


def committed(spark: SparkSession, path: str) -> DataFrame:
    """run_id, generation of each run of a store: that of its last commit."""
    return spark.read.parquet(f"{path}/{COMMITS}").groupBy("run_id").agg(F.max(F.struct("at", "generation")).alias("x")).select("run_id", "x.generation")


def read_runs(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """All rows of the last commit of every run that write_runs() has kept, or of one run, read from its folder alone.

    Columns added later are null in older runs.
    """
    now = committed(spark, path)
    now = now if run_id is None else now.filter(F.col("run_id") == run_id)
    rows = spark.read.option("mergeSchema", True).option("basePath", f"{path}/rows").parquet(f"{path}/rows").withColumn("run_id", F.col("run_id").cast("string"))
    rows = rows if run_id is None else rows.filter(F.col("run_id") == run_id)
    return rows.join(now, ["run_id", "generation"], "left_semi").drop("generation")


def repaired(jobs: DataFrame) -> DataFrame:
    """jobs (status, error) as they are after a restart: what was queued or running has failed."""
    cut = F.col("status").isin(OPEN)
    return jobs.withColumn("error", F.when(cut, INTERRUPTED).otherwise(F.col("error"))).withColumn("status", F.when(cut, "failed").otherwise(F.col("status")))


def claimed(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests (request, path, at) with granted: the first one of each path, where no job of that path runs.

    Paths are compared without closing slashes, with forward ones.
    """
    name = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "/+$", "")
    busy = jobs.filter("status = 'running'").select(name.alias("p")).distinct().withColumn("busy", F.lit(True))
    df = requests.withColumn("p", name)
    first = df.groupBy("p").agg(F.min(F.struct("at", "request")).alias("x")).select("p", F.col("x.request").alias("first"))
    df = df.join(first, "p").join(busy, "p", "left")
    return df.select("request", (F.col("busy").isNull() & (F.col("request") == F.col("first"))).alias("granted"))


def resolved_runs(requests: DataFrame, runs: DataFrame, active: str | None = None) -> DataFrame:
    """request, run_id, code of requests (request, asked, header): the run asked for, else the header's, else the active one.

    200 where that run is completed, 503 without any run, 404 for an unknown one, 409 for one that is not ready. It is never
    another run than the first that is named.
    """
    df = requests.withColumn("run_id", F.coalesce(F.nullif("asked", F.lit("")), F.nullif("header", F.lit("")), F.lit(active).cast("string")))
    df = df.join(runs.select("run_id", "status"), "run_id", "left")
    code = F.when(F.col("run_id").isNull(), 503).when(F.col("status").isNull(), 404).when(F.col("status") == "completed", 200).otherwise(409)
    return df.select("request", "run_id", code.alias("code"))
