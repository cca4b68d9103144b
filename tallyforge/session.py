"""One way to open a session: UTC, ANSI arithmetic, adaptive execution."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def open_session(master: str | None = None, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """Return a session with the settings every operator assumes; keyword settings use `__` for a dot."""
    builder = (
        SparkSession.builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("tallyforge")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
