"""Sinks with a fixed layout; each is a plain Spark write from the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protspark.schemas import ENTITY_COLUMNS


def write_contacts(contacts: DataFrame, path: str) -> None:
    contacts.select(*ENTITY_COLUMNS["contacts"]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_entity_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').option("emptyValue", "").csv(path)


def write_fasta(seqs: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    seqs.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = metrics.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def write_ranked(ranked: DataFrame, path: str, *order) -> None:
    """Range-sorted output: part files are in order and each is sorted."""
    ranked.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_position_vectors(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Per-position vectors as Parquet, foldered by a hash of the id so that one id reads few files."""
    bucketed = df.withColumn("id_bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    bucketed.write.mode("overwrite").partitionBy("id_bucket").parquet(path)


def read_position_vectors(spark, path: str, ids: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """Read them back; for named ids only their folders are scanned."""
    table = spark.read.parquet(path)
    if ids is None:
        return table.drop("id_bucket")
    wanted = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id string")
              .select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).distinct().collect()]
    return table.where(F.col("id_bucket").isin(wanted) & F.col("id").isin(ids)).drop("id_bucket")
