"""Session factory: UTC, adaptive execution, Arrow transfer."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "quantloom", cpus: int | None = None, shuffle: int | None = None) -> SparkSession:
    """A local session unless a master is set elsewhere (spark-submit, PYSPARK_SUBMIT_ARGS)."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.appName(app)
        .master(os.environ.get("SPARK_MASTER", f"local[{n}]"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle or n))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # A day of ticks of one instrument stays in the window's memory buffer instead of a spillable sorter.
        .config("spark.sql.windowExec.buffer.in.memory.threshold", "65536")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
