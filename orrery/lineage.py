"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast.
LIGHT = 100_000


def durable(df: DataFrame) -> DataFrame:
    """df, written once under spark.checkpoint.dir. Only a local session may do without that setting: its executors share its disk."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint(eager=True)


def light(df: DataFrame) -> DataFrame:
    """df, a durable one, to be broadcast where it is counted to have few rows: its plan does not say how many it has."""
    return F.broadcast(df) if df.limit(LIGHT + 1).count() <= LIGHT else df
