"""Given tables seen as sequences, structures and graphs, for Spark and as SQL text.

* points: an embedding's first three entries are coordinates, its label the structure, its id the index;
* aligned: an embedding's 64 entries, cut into 21 steps, are a row of an alignment of its label;
* lines: an order is a structure, its lines the residues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from protspark.plans.registry import table

STEPS = "ACDEFGHIKLMNPQRSTVWY-"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("model_id"), F.col("vec_id").alias("idx"),
                    *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")])


POINTS_SQL = """pts AS (SELECT label AS model_id, vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS x,
    CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""


def step_letter(v: Column) -> Column:
    k = F.least(F.lit(20), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.3) * 35))).cast("int")
    return F.substring(F.lit(STEPS), k + 1, F.lit(1))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("msa_id"), F.col("vec_id").alias("row_id"),
                    F.array_join(F.transform("embedding", step_letter), "").alias("seq"))


ALIGNED_SQL = f"""aln AS (SELECT label AS msa_id, vec_id AS row_id, array_to_string(list_transform(embedding, lambda v:
    substr('{STEPS}', CAST(least(20, greatest(0, floor((CAST(v AS DOUBLE) + 0.3) * 35))) AS INT) + 1, 1)), '') AS seq FROM embeddings)"""
# One row per letter.
LETTERS_SQL = ALIGNED_SQL + """,
long AS (SELECT msa_id, row_id, col, substr(seq, col + 1, 1) AS ch FROM (SELECT *, unnest(range(0, 64)) AS col FROM aln))"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ungapped sequences with an id."""
    return aligned(spark, sf_dir).select(F.col("row_id").alias("query_id"), F.translate("seq", "-", "").alias("seq"))


SEQUENCES_SQL = ALIGNED_SQL + ", seqs AS (SELECT row_id AS query_id, replace(seq, '-', '') AS seq FROM aln)"

# Contact pairs of points by brute force.
PAIRS_SQL = POINTS_SQL + """, pairs AS (SELECT a.model_id, a.idx AS i, b.idx AS j,
    sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist
    FROM pts a JOIN pts b ON a.model_id = b.model_id AND a.idx < b.idx)"""
