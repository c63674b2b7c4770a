"""Line-level scans that keep the order of the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from protspark.functions.columns import file_stem


def read_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """``(path, ord, value)``: ``ord`` = (block start, row id) sorts the rows of one file in file order.

    Spark numbers rows inside a scan task in reading order, and a task reads a block from its start, so
    the pair is ordered even when a large file is split.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if separator:
        reader = reader.option("lineSep", separator)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord"),
        "value",
    )


def stem(path: str | Column = "path") -> Column:
    return file_stem(path)
