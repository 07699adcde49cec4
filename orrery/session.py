"""Session settings that the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int = 8, app: str = "orrery") -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("ORRERY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.files.maxPartitionBytes", "8m")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
