"""Metrics of runs and their stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Price of a million tokens in and out.
PRICE_IN, PRICE_OUT = 3.0, 15.0


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return F.round((tokens_in * PRICE_IN + tokens_out * PRICE_OUT) / 1_000_000, 6)


def run_metrics(stages: DataFrame) -> DataFrame:
    """One row for each run of stages (run_id, status, duration_ms, tokens_in, tokens_out, cache_hit, fallback_reason, warnings).

    A stage fell back where it gives a reason for it; warnings is its array of them.
    """
    df = stages.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("stage_count"),
        F.count_if(F.col("status") == "failed").alias("failed_stage_count"),
        F.count_if((F.col("tokens_in") > 0) | (F.col("tokens_out") > 0)).alias("llm_stage_count"),
        F.count_if(F.col("fallback_reason") != "").alias("fallback_stage_count"),
        F.sum(F.coalesce(F.size("warnings"), F.lit(0))).alias("warning_count"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.sum("duration_ms").alias("duration_ms"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
    )
    return df.withColumn("estimated_cost", cost(F.col("tokens_in"), F.col("tokens_out")))


def slowest(stages: DataFrame, k: int = 8) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy(F.desc("duration_ms"), "stage")
    return stages.filter("duration_ms > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("run_id", "rank", "stage", "duration_ms")


def current_stage(stages: DataFrame) -> DataFrame:
    """(run_id, current_stage): the first stage that runs, else the last that is completed, else idle."""
    running = F.min_by("stage", F.when(F.col("status") == "running", F.col("sort_order")))
    done = F.max_by("stage", F.when(F.col("status") == "completed", F.col("sort_order")))
    return stages.groupBy("run_id").agg(F.coalesce(running, done, F.lit("idle")).alias("current_stage"))


def stage_overview(stages: DataFrame) -> DataFrame:
    """run_id, current_stage, can_render, and how many stages have each status (status, n): what a reader of a run polls.

    A run can be shown as soon as any of its stages says so.
    """
    whole = stages.groupBy("run_id").agg(F.coalesce(F.bool_or("can_render"), F.lit(False)).alias("can_render"))
    counts = stages.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return current_stage(stages).join(whole, "run_id").join(counts, "run_id")


def changes(progress: DataFrame) -> DataFrame:
    """progress (run_id, at, payload) without rows that repeat the payload before them."""
    before = F.lag("payload").over(Window.partitionBy("run_id").orderBy("at"))
    return progress.withColumn("before", before).filter(~F.col("payload").eqNullSafe(F.col("before"))).drop("before")


def latest(stages: DataFrame) -> DataFrame:
    """The last row of each (run_id, stage) in order of `at`."""
    cols = [c for c in stages.columns if c not in ("run_id", "stage")]
    return stages.groupBy("run_id", "stage").agg(F.max_by(F.struct(*cols), F.col("at")).alias("x")).select("run_id", "stage", "x.*")
