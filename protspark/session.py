"""Session settings for local runs; on a cluster the given session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "protspark", cpus: str | None = None, memory: str = "8g") -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (SparkSession.builder.master(f"local[{cpus}]").appName(name)
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", memory)
            .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .getOrCreate())
