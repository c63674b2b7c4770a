"""Exact ranks, running totals and quantiles that never put one large group into one task.

A window over a group sends the whole group to one task. That is fine while groups are small; a group
that holds a third of the table is not. The functions here sort the table by range instead: rows are
range-partitioned on (group, order), ranked inside each range, and shifted by the number of rows
the group has in the ranges before. The ranges are checkpointed, because both the local pass and
the counting pass must see the same boundaries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from protspark.functions.lineage import cut

HOT_GROUP_CONF = "spark.protspark.hotGroupRows"
HOT_GROUP_ROWS = 1_000_000


def hot_group_rows(df: DataFrame) -> int:
    """Largest group a plain window may take, from the session or the default."""
    return int(df.sparkSession.conf.get(HOT_GROUP_CONF, str(HOT_GROUP_ROWS)))


def _largest_group(df: DataFrame, by: list[str]) -> int:
    sizes = df.groupBy(*by).count()
    return sizes.agg(F.max("count")).first()[0] or 0


def _needs_ranges(df: DataFrame, by: list[str]) -> bool:
    return not by or _largest_group(df, by) > hot_group_rows(df)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys])


def _by_range(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    ranged = df.repartitionByRange(*[F.col(c) for c in by], *order)
    return cut(ranged.withColumn("_range", F.spark_partition_id()))


def _offsets(parts: DataFrame, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """Per (range, group): the totals of the same group in all earlier ranges."""
    sums = parts.groupBy("_range", *by).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in ["_range", *by]],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in totals],
    )


def running_totals(df: DataFrame, by: list[str], order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums per group; ``order`` must be unique inside a group.

    The input is usually an aggregate, so it is written once before its groups are measured.
    """
    df = cut(df) if by else df
    if not _needs_ranges(df, by):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in totals.items()])
    parts = _by_range(df, by, order)
    offsets = _offsets(parts, by, totals)
    keys = ["_range", *by]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(c).over(w).alias(f"_l_{n}") for n, c in totals.items()])
    return local.join(offsets, _same(local, offsets, keys)).select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_off_{n}")).alias(n) for n in totals]
    )


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """Add the 1-based position of each row in its group; ``order`` must be total."""
    if not _needs_ranges(df, by):
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    parts = _by_range(df, by, order)
    offsets = _offsets(parts, by, {name: F.lit(1)})
    keys = ["_range", *by]
    local = parts.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return local.join(offsets, _same(local, offsets, keys)).select(
        *df.columns, (F.col("_rn") + F.col(f"_off_{name}")).cast("long").alias(name)
    )


def value_ranks(df: DataFrame, by: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """One row per (group, value): count ``n``, rows below ``below`` and average rank ``avg_rank``."""
    counts = df.groupBy(*by, value).agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"))
    cum = running_totals(counts, by, [F.col(value)], {"upto": F.col("n")})
    below = F.col("upto") - F.col("n")
    return cum.select(*by, value, "n", below.alias("below"), (below + (F.col("n") + 1) / 2).alias("avg_rank"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles per group in columns ``q0, q1, ...``.

    Values are counted first, so only distinct values are ordered, and the order is by range: no task
    sees the whole group.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ranks = value_ranks(rows, by, value)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    sized = ranks.join(sizes, by) if by else ranks.withColumn("_size", F.lit(rows.count()))
    inside = lambda pos: (F.col("below") <= pos) & (pos < F.col("below") + F.col("n"))
    out, pick = [], []
    for k, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("_size") - 1)
        pick += [F.max(F.when(inside(F.floor(pos)), F.col(value))).alias(f"_lo{k}"),
                 F.max(F.when(inside(F.ceil(pos)), F.col(value))).alias(f"_hi{k}")]
        frac = pos - F.floor(pos)
        out.append((F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * frac).alias(f"q{k}"))
    return sized.groupBy(*by, "_size").agg(*pick).select(*by, *out)
