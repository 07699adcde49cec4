import datetime

import pytest
from pyspark.sql import functions as F

from orrery.streaming import progress


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


@pytest.fixture
def drain(spark, tmp_path):
    def run(df, make, schema):
        df.write.parquet(str(tmp_path / "in"))
        q = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("drained").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.sql("select * from drained").collect()

    return run


def test_changes_only(spark, drain):
    rows = [("a", at(0), "p1"), ("a", at(1), "p1"), ("a", at(2), "p2"), ("a", at(3), "completed"), ("a", at(4), "p3"), ("b", at(1), "p1")]
    df = spark.createDataFrame(rows, "run_id string, at timestamp, payload string").coalesce(1)
    got = sorted((r.run_id, r.payload, r.closed) for r in drain(df, progress.changes, df.schema))
    assert got == [("a", "completed", True), ("a", "p1", False), ("a", "p2", False), ("b", "p1", False)]


def test_durations(spark, drain):
    rows = [("a", "s", "pending", at(0)), ("a", "s", "running", at(1)), ("a", "s", "completed", at(3)), ("a", "t", "failed", at(4))]
    df = spark.createDataFrame(rows, "run_id string, stage string, status string, at timestamp").coalesce(1)
    got = sorted((r.stage, r.status, r.duration_ms) for r in drain(df, progress.durations, df.schema))
    assert got == [("s", "completed", 2000), ("t", "failed", 0)]


def test_upsert(spark, tmp_path):
    write = progress.upsert_into(str(tmp_path / "out"))
    schema = "run_id string, stage string, status string, at timestamp"
    write(spark.createDataFrame([("a", "s", "running", at(1)), ("a", "t", "running", at(1))], schema), 0)
    write(spark.createDataFrame([("a", "s", "completed", at(2))], schema), 1)
    write(spark.createDataFrame([("b", "s", "running", at(3))], schema), 2)
    write(spark.createDataFrame([], schema), 3)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("run_id", "stage").select(F.concat_ws(":", "run_id", "stage", "status")).collect()
    assert [r[0] for r in got] == ["a:s:completed", "a:t:running", "b:s:running"]


def test_fresh_plans(spark, drain):
    rows = [("p", at(0)), ("p", at(60)), ("q", at(61)), ("p", at(4000))]
    df = spark.createDataFrame(rows, "plan_id string, at timestamp").coalesce(1)
    got = sorted(r.plan_id for r in drain(df, lambda s: progress.fresh_plans(s, "1 minute"), df.schema))
    assert got.count("q") == 1 and 1 <= got.count("p") <= 2


def test_illegal_steps_change_nothing_and_idle_stages_expire(spark, tmp_path):
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "run_id string, stage string, status string, at timestamp"
        first = [("a", "s", "pending", at(0)), ("a", "s", "completed", at(1)), ("a", "s", "running", at(2)), ("a", "s", "running", at(3)), ("b", "s", "running", at(2)), ("c", "s", "failed", at(1))]
        later = [("a", "s", "completed", at(5)), ("a", "s", "completed", at(5)), ("z", "s", "pending", at(5000))]
        last = [("z", "s", "skipped", at(5001))]
        for i, rows in enumerate((first, later, last)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q = progress.transitions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 minute", 600_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(120)
        got = {(r.run_id, r.before, r.status, r.legal, r.duration_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    finally:
        spark.conf.unset(conf)
    assert got == {
        ("a", None, "pending", True, None), ("a", "pending", "completed", False, None), ("a", "pending", "running", True, None), ("a", "running", "running", False, None), ("a", "running", "completed", True, 3000), ("a", "completed", "completed", False, None),
        ("b", None, "running", True, None), ("b", "running", "expired", True, 600_000), ("c", None, "failed", False, None), ("z", None, "pending", True, None), ("z", "pending", "skipped", True, 0),
    }
