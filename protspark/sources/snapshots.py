"""Graph snapshots as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from protspark.schemas import SNAPSHOT_SCHEMA


def read_snapshot(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Snapshots, one document per line, or one per file with ``multi_line``."""
    return spark.read.option("multiLine", multi_line).schema(SNAPSHOT_SCHEMA).json(path)


def snapshot_nodes(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("query", F.posexplode("nodes").alias("ord", "n")).select("query", "ord", "n.*")


def snapshot_edges(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("query", F.posexplode("edges").alias("ord", "e")).select("query", "ord", "e.*")


def write_snapshot(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("overwrite").json(path)
