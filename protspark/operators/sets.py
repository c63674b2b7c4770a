"""Set operations on id tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_ids(*tables: DataFrame) -> DataFrame:
    """Distinct union of single-column tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.distinct()


def concat_nodes(*tables: DataFrame) -> DataFrame:
    """Bag union by column name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def minus(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def common(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key is in ``right``."""
    return left.join(right.select(key).distinct(), key, "left_semi")


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()
