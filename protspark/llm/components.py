"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protspark.functions.lineage import cut


FILES, FILE_ROWS = 12, 200_000  # a round is written to so many files, or more if they would hold more rows than that


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one lesser neighbour at most, which has none itself."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("leaf")).union(edges.select("v", F.lit(0)))
    met = ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.count("*").alias("all"))
    return met.where((F.col("leaf") > 1) | (F.col("leaf") > 0) & (F.col("leaf") < F.col("all"))).isEmpty()


def _cut(edges: DataFrame, rows: int) -> DataFrame:
    return cut(edges.coalesce(max(FILES, rows // FILE_ROWS)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge, the root being the smallest node of its component.

    Edges keep the form u > v. Each round halves the depth of the remaining trees, a round is written to the shared
    folder, and the end is reached when all trees are stars. An empty edge table gives an empty result. The edges are
    read twice, first for their number; a round never has more.
    """
    rows = edges.count()
    now = _cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), rows)
    while not _stars(now):
        now = _cut(_small_star(_large_star(now)), rows)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
