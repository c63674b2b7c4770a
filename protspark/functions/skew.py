"""Joins that stay spread when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from protspark.functions.ordered import hot_group_rows, ranked


def salted_join(left: DataFrame, right: DataFrame, on: list[str], rows_per_task: int | None = None) -> DataFrame:
    """Inner equi-join; keys with many ``left`` rows are cut into slices and their ``right`` rows repeated.

    Only hot keys are repeated, once per slice of ``rows_per_task`` left rows, so the copies of the right
    side never outnumber the left side's slices.
    """
    limit = rows_per_task or hot_group_rows(left)
    hot = (left.groupBy(*on).count().where(F.col("count") > limit)
           .select(*on, F.ceil(F.col("count") / limit).cast("int").alias("_slices")))
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    salted = (left.join(hot, on, "left")
              .withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if _hashable(left, c)]), slices).cast("int"))
              .drop("_slices"))
    spread = (right.join(hot, on, "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), slices - 1)))
              .drop("_slices"))
    return salted.join(spread, [*on, "_salt"]).drop("_salt")


def _hashable(df: DataFrame, name: str) -> bool:
    return "map<" not in df.schema[name].dataType.simpleString()


def pair_join(df: DataFrame, by: list[str], pos: str, cols: list[str], block: int = 256) -> DataFrame:
    """All pairs ``pos_i < pos_j`` inside a group, as a block join.

    Positions are cut into blocks; each (block, block) cell is its own join key, so a cell has at most
    ``block * block`` pairs and one long chain is spread over many tasks. ``pos`` must be unique in a group.
    """
    sizes = df.groupBy(*by).agg(F.max(F.col(pos)).alias("_last"), F.min(F.col(pos)).alias("_first"))
    blocked = df.join(sizes, by).select(
        *by, pos, *cols,
        F.floor((F.col(pos) - F.col("_first")) / block).cast("int").alias("_b"),
        F.floor((F.col("_last") - F.col("_first")) / block).cast("int").alias("_nb"),
    )
    left = blocked.select(
        *by, F.col(pos).alias(f"{pos}_i"), *[F.col(c).alias(f"{c}_i") for c in cols],
        F.col("_b").alias("_bi"), F.explode(F.sequence("_b", "_nb")).alias("_bj"))
    right = blocked.select(
        *by, F.col(pos).alias(f"{pos}_j"), *[F.col(c).alias(f"{c}_j") for c in cols],
        F.explode(F.sequence(F.lit(0), "_b")).alias("_bi"), F.col("_b").alias("_bj"))
    return left.join(right, [*by, "_bi", "_bj"]).where(F.col(f"{pos}_i") < F.col(f"{pos}_j")).drop("_bi", "_bj")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash rows over all shuffle partitions before a step that makes very many rows, or much work, of each.

    The number is given, because adaptive execution would merge partitions that are still small.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def with_group_stats(df: DataFrame, by: list[str], **stats) -> DataFrame:
    """Add group aggregates by aggregate-then-join: combined before the shuffle, unlike a window."""
    totals = df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(totals, by)


GROUP_LIMIT_ROWS = 1_000  # Spark's default bound for limiting a group before the shuffle


def first_n(df: DataFrame, by: list[str], order: list, n: int, name: str = "_rn") -> DataFrame:
    """First ``n`` rows per group.

    For a small literal ``n`` Spark limits each group before the shuffle. For larger ones it does not, so the
    rank comes from ``ranked``, which splits large groups.
    """
    if n > GROUP_LIMIT_ROWS:
        keys = [o if isinstance(o, Column) else F.col(o) for o in order]
        return ranked(df, by, keys, name).where(F.col(name) <= n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
