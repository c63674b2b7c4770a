"""Spark ML jobs and batch scoring on embeddings and documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from protspark.functions.lineage import cut
from protspark.operators import learning as L
from protspark.operators.geometry import contacts
from protspark.operators.splits import kfold, split_fraction
from protspark.plans.elimination import SOLVE_SQL
from protspark.plans.registry import query, r6, table
from protspark.plans.split_queries import placed_sql
from protspark.plans.stand_ins import PAIRS_SQL, points


@query("mlt01_scale", """
    WITH l AS (SELECT vec_id, d, CAST(embedding[d] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS d FROM embeddings))
    SELECT vec_id, CAST(d - 1 AS INT) AS dim, round((v - avg(v) OVER p) / stddev_pop(v) OVER p, 6) + 0.0 AS value FROM l WINDOW p AS (PARTITION BY d)""")
def scale(spark, sf):
    s = L.scale(table(spark, sf, "embeddings"), "embedding")
    return s.select("vec_id", F.posexplode("scaled").alias("dim", "value")).withColumn("value", r6("value"))


def train_test(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"), (F.col("embedding")[0] * 2 + F.col("embedding")[5] - F.col("embedding")[9] + F.col("label") / 50).cast("double").alias("y"))
    parts = cut(split_fraction(e, "vec_id", 0.8))
    return parts.where("split = 'train'"), parts.where("split = 'val'")


@query("mlt02_linear_grid")
def linear_grid(spark, sf):
    train, test = train_test(spark, sf)
    out = L.linear_grid(train, test, "y", alphas=[0.001, 0.01, 0.1, 1.0], l1_ratios=[0.0, 0.5, 1.0], folds=5)
    return out.select(r6("mse").alias("mse"), r6("pearson").alias("pearson"), "n", "alpha", "l1_ratio")


#: Normal equations of each (alpha, fold) from all other folds: unknown 0 is the intercept, which is not shrunk.
@query("mlt02_ridge_folds", f"""
    WITH RECURSIVE {placed_sql('embeddings', 'vec_id')},
    l AS (SELECT vec_id, CAST((n - 1) % 5 AS INT) AS fold, d - 1 AS d, CAST(embedding[d] AS DOUBLE) AS v FROM (SELECT vec_id, n, embedding, unnest(range(1, 65)) AS d FROM p)),
    z AS (SELECT vec_id, fold, d + 1 AS c, v FROM l UNION ALL SELECT DISTINCT vec_id, fold, 0, 1.0::DOUBLE FROM l
          UNION ALL SELECT p.vec_id, CAST((n - 1) % 5 AS INT), 65, CAST(label AS DOUBLE) FROM p),
    f AS (SELECT x.fold, x.c AS i, y.c AS j, sum(x.v * y.v) AS s FROM z x JOIN z y USING (vec_id) GROUP BY 1, 2, 3),
    t AS (SELECT fold, i, j, sum(s) OVER (PARTITION BY i, j) - s AS s FROM f),
    a AS (SELECT unnest([0.01, 0.1, 1.0])::DOUBLE AS alpha),
    rows_ AS (SELECT fold, s AS n FROM t WHERE i = 0 AND j = 0),
    m0 AS (SELECT (alpha, fold) AS g, i, j, 65 AS n, s / r.n + CASE WHEN i = j AND i > 0 THEN alpha ELSE 0.0 END AS v FROM t JOIN rows_ r USING (fold), a WHERE i < 65),
    {SOLVE_SQL},
    guess AS (SELECT g, z.fold, vec_id, sum(z.v * solved.v) AS yhat FROM solved JOIN z ON z.fold = g[2] AND z.c = solved.i GROUP BY 1, 2, 3)
    SELECT g[1] AS alpha, fold, round(avg((label - yhat) ** 2), 6) + 0.0 AS mse, CAST(count(*) AS DOUBLE) AS weight FROM guess JOIN embeddings USING (vec_id) GROUP BY g, fold""")
def ridge_folds(spark, sf):
    rows = kfold(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"), "vec_id")
    errors = L.grid_errors(rows, "label", "embedding", alphas=[0.01, 0.1, 1.0], l1_ratios=[0.0], fold="fold")
    return errors.select("alpha", "fold", r6("mse").alias("mse"), "weight")


@query("mlt03_boosted")
def boosted(spark, sf):
    train, test = train_test(spark, sf)
    _, importances = L.boosted(train, test, "y", depth=3, rounds=5)
    return importances.withColumn("importance", r6("importance"))


@query("mlt03_boosted_folds", f"""
    WITH {placed_sql('embeddings', 'vec_id')} SELECT vec_id, CAST((n - 1) % 5 AS INT) AS fold, true AS better FROM p""")
def boosted_folds(spark, sf):
    """Every row with its fold, and whether the report agrees with its predictions and they beat the label's mean."""
    rows = kfold(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"), (F.col("embedding")[0] * 2 - F.col("embedding")[9]).cast("double").alias("y")), "vec_id")
    found, report = L.boosted_folds(rows, "y", fold="fold", depth=3, rounds=10, rate=0.3)
    told = report.where("fold IS NULL").select("mse", "n")
    own = found.agg(F.avg((F.col("y") - F.col("prediction")) ** 2).alias("own"), F.var_pop("y").alias("spread"), F.count(F.lit(1)).alias("rows"))
    better = told.join(F.broadcast(own), F.col("n") == F.col("rows")).select((F.abs(F.col("mse") - F.col("own")) < 1e-9).alias("same"), (F.col("mse") < F.col("spread")).alias("beats"))
    return found.join(F.broadcast(better), F.lit(True)).select("vec_id", "fold", (F.col("same") & F.col("beats")).alias("better"))


#: Two projections of all 64 entries: the sum of the odd places and the sum of the even ones.
ODD_EVEN = [[1.0, 0.0] * 32, [0.0, 1.0] * 32]
DOT_SQL = "a.odd * b.even + a.even * b.odd"


@query("mlt04_score_pairs", f"""
    WITH {PAIRS_SQL}, l AS (SELECT vec_id, d, CAST(embedding[d] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS d FROM embeddings)),
    e AS (SELECT vec_id, sum(v) FILTER (d % 2 = 1) AS odd, sum(v) FILTER (d % 2 = 0) AS even FROM l GROUP BY 1)
    SELECT model_id AS graph_id, i, j, round(1 / (1 + exp(-(0.5 * (({DOT_SQL}) + ({DOT_SQL})) + 0.25 + 0.1 * dist + CASE WHEN j - i >= 2 THEN -0.5 ELSE 0.0 END))), 6) + 0.0 AS score
    FROM pairs JOIN e a ON a.vec_id = i JOIN e b ON b.vec_id = j WHERE dist <= 0.1""")
def score_pairs(spark, sf):
    features = table(spark, sf, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("idx"), F.col("embedding").alias("features"))
    pairs = contacts(points(spark, sf), 0.1).select(F.col("model_id").alias("graph_id"), "i", "j", F.col("dist").alias("mi"))
    s = L.score_pairs(features, pairs, u=ODD_EVEN, v=ODD_EVEN[::-1], bias=0.25, mi_weight=0.1, distance_bias=[0.0, 0.0, -0.5], symmetric=True, squash=True)
    return s.select("graph_id", "i", "j", r6("score").alias("score"))


def text_length(texts: pd.Series) -> pd.Series:
    return texts.str.len().astype(float)


@query("mlt05_infer_cached", """
    SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents c WHERE c.lang = 'en' AND c.text = d.text) THEN -1.0::DOUBLE ELSE CAST(length(text) AS DOUBLE) END AS result FROM documents d""")
def infer_cached(spark, sf):
    from protspark.functions.columns import content_key

    d = table(spark, sf, "documents")
    cache = d.where("lang = 'en'").select(content_key(F.lit("model"), "text").alias("key"), F.lit(-1.0).alias("result")).distinct()
    return L.infer_cached(d, cache, "text", text_length)[0].select("doc_id", "result")
