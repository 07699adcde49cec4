"""Progress of runs as streams: changes only, stage states with durations, and the latest row of each stage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("completed", "failed", "skipped")


def changes(progress: DataFrame, late: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """run_id, at, payload, closed of a stream (run_id string, at timestamp, payload string), where the payload differs from the last one.

    A terminal payload closes its run: what comes later is dropped. The state of a run is its last payload; it is forgotten
    once the watermark, which allows rows to be `late`, has gone idle_ms beyond a run's last row.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run_id": [], "at": pd.to_datetime([]), "payload": [], "closed": []})
            return
        last, closed = state.get if state.exists else (None, False)
        out, newest = [], 0
        for at, payload in sorted((r for b in batches for r in zip(b["at"], b["payload"])), key=lambda r: r[0]):
            newest = max(newest, at.value // 1_000_000)
            if closed or payload == last:
                continue
            last, closed = payload, payload in TERMINAL
            out.append((key[0], at, payload, closed))
        state.update((last, closed))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), newest) + idle_ms)
        yield pd.DataFrame(out, columns=["run_id", "at", "payload", "closed"])

    return progress.withWatermark("at", late).groupBy("run_id").applyInPandasWithState(step, "run_id string, at timestamp, payload string, closed boolean", "payload string, closed boolean", "append", GroupStateTimeout.EventTimeTimeout)


def durations(stages: DataFrame) -> DataFrame:
    """run_id, stage, status, duration_ms at each end of a stage in a stream (run_id string, stage string, status string, at timestamp)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun = state.get[0] if state.exists else None
        out = []
        for at, status in sorted((r for b in batches for r in zip(b["at"], b["status"])), key=lambda r: r[0]):
            if status == "running":
                begun = at.value // 1000
            elif status in TERMINAL:
                out.append((*key, status, max(0, at.value // 1_000_000 - begun // 1000) if begun is not None else 0))
                begun = None
        if begun is None:
            state.remove() if state.exists else None
        else:
            state.update((begun,))
        yield pd.DataFrame(out, columns=["run_id", "stage", "status", "duration_ms"])

    return stages.groupBy("run_id", "stage").applyInPandasWithState(step, "run_id string, stage string, status string, duration_ms long", "begun long", "append", GroupStateTimeout.NoTimeout)


#: Which states a stage may go to from each, none being before its first row.
LEGAL = {None: ("pending", "running", "skipped"), "pending": ("running", "failed", "skipped"), "running": ("completed", "failed", "skipped")}


class StageMachine(StatefulProcessor):
    """One stage's state and when it began; a timer ends what stays in a state for too long."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, begun long, timer long")

    def _timer(self, at_ms: int) -> int:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms + self.idle_ms)
        return at_ms + self.idle_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, begun, _ = self.state.get() if self.state.exists() else (None, None, None)
        out, last = [], None
        for at, new in sorted((r for b in rows for r in zip(b["at"], b["status"])), key=lambda r: (r[0], r[1])):
            ms = at.value // 1_000_000
            legal = new in LEGAL.get(status, ())
            took = None
            if legal:
                begun = ms if new == "running" else begun
                took = (ms - begun if begun is not None else 0) if new in TERMINAL else None
            out.append((*key, at, status, new, legal, took))
            if legal:
                status, last = new, ms
        if last is not None:
            self.state.update((status, begun, self._timer(last)))
        yield pd.DataFrame(out, columns=["run_id", "stage", "at", "before", "status", "legal", "duration_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, begun, timer = self.state.get() if self.state.exists() else (None, None, None)
        self.state.clear()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        rows = [(*key, at, status, "expired", True, timer - begun if begun is not None else 0)] if status in ("pending", "running") else []
        yield pd.DataFrame(rows, columns=["run_id", "stage", "at", "before", "status", "legal", "duration_ms"])

    def close(self) -> None:
        pass


def transitions(stages: DataFrame, late: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """run_id, stage, at, before, status, legal, duration_ms of every step in a stream (run_id string, stage string, status string, at timestamp).

    A step that the table of legal ones does not have is reported and changes nothing, so what comes late or twice after an
    end is seen and does no harm. A stage ends with its duration since it began to run. One that stays pending or running
    until the watermark, which allows rows to be `late`, has gone idle_ms beyond its last step is reported as expired, and its
    state goes; so does that of an ended stage, without a report. Needs a state store with column families, such as RocksDB's.
    """
    schema = "run_id string, stage string, at timestamp, before string, status string, legal boolean, duration_ms long"
    return stages.withWatermark("at", late).groupBy("run_id", "stage").transformWithStateInPandas(StageMachine(idle_ms), schema, "append", "EventTime")


def fresh_plans(plans: DataFrame, ttl: str = "30 minutes") -> DataFrame:
    """plans (plan_id string, at timestamp) without repeats inside the time that a plan lives; state older than that is dropped."""
    return plans.withWatermark("at", ttl).dropDuplicatesWithinWatermark(["plan_id"])


def upsert_into(path: str):
    """A foreachBatch function that keeps the latest row of each (run_id, stage) under path, one directory for each run.

    Only runs of a batch are read and written again; what a batch writes twice after a failure is the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        from orrery.lineage import durable
        from orrery.operators.runs import latest

        if batch.isEmpty():
            return
        spark = batch.sparkSession
        store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store):
            kept = spark.read.schema(batch.schema).option("basePath", path).parquet(path)
            batch = kept.join(F.broadcast(batch.select("run_id").distinct()), "run_id", "left_semi").select(batch.columns).unionByName(batch)
        durable(latest(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)

    return write
