"""Session factory with the settings the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "docloom", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
