"""Model-table jobs on Spark ML and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from protspark.functions.columns import content_key
from protspark.functions.lineage import written
from protspark.functions.vectors import as_double, dot, project
from protspark.operators.evaluation import guarded_corr


def scale(df: DataFrame, vec: str = "features", out: str = "scaled") -> DataFrame:
    """Zero mean and unit population variance per entry.

    Spark's scaler divides by the sample deviation, so its output is stretched by sqrt(n/(n-1)).
    """
    rows = df.withColumn("_v", array_to_vector(as_double(vec)))
    n = rows.count()
    model = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(rows)
    stretch = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    return model.transform(rows).withColumn(out, F.transform(vector_to_array("_s"), lambda x: x * stretch)).drop("_v", "_s")


def _vectors(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("_features", array_to_vector(as_double(vec)))


def _fold(vec: str, folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), as_double(vec)), F.lit(folds)).cast("int")


def _usable(df: DataFrame, label: str, vec: str, weight: str | None) -> DataFrame:
    """Rows with a finite label, finite entries and a positive weight, as ``_x``, ``_y``, ``_w`` beside their columns."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df.withColumns({"_x": as_double(vec), "_y": F.col(label).cast("double"), "_w": F.col(weight).cast("double") if weight else F.lit(1.0)})
    return rows.where(fine(F.col("_y")) & fine(F.col("_w")) & (F.col("_w") > 0) & F.coalesce(F.forall("_x", fine), F.lit(False)))


def fold_grams(df: DataFrame, label: str, vec: str, fold: str, weight: str | None = None) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Sums of products of (1, entries, label) per fold, from one scan, and the shift that was taken off entries and label.

    A task sends one partial matrix a fold; ``folds * (d + 2) ** 2`` numbers come to the driver, whatever the rows.
    The shift is some row's, so that large offsets do not eat the digits.
    """
    rows = _usable(df, label, vec, weight).select(F.col(fold).cast("int").alias("fold"), "_x", "_y", "_w")
    some = rows.select("_x", "_y").first()
    if some is None:
        return {}, np.zeros(1)
    shift = np.array([*some["_x"], some["_y"]])
    m = len(shift) + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {}
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), np.column_stack([np.stack(pdf["_x"]), pdf["_y"]]) - shift]) if len(pdf) else np.zeros((0, m))
            for k in pdf["fold"].unique():
                at = (pdf["fold"] == k).to_numpy()
                total[k] = total.get(k, 0.0) + z[at].T @ (z[at] * pdf["_w"].to_numpy()[at, None])
        for k, g in total.items():
            yield pd.DataFrame({"fold": k, "cell": np.arange(m * m, dtype=np.int32), "v": g.ravel()})

    out: dict[int, np.ndarray] = {}
    for k, cell, v in rows.mapInPandas(sums, "fold int, cell int, v double").groupBy("fold", "cell").agg(F.sum("v")).collect():
        out.setdefault(k, np.zeros(m * m))[cell] = v
    return {k: out[k].reshape(m, m) for k in sorted(out)}, shift


def _swept(a: np.ndarray, c: np.ndarray, l1: float, l2: float, rounds: int) -> np.ndarray:
    """A start by coordinate descent."""
    w, left = np.zeros(len(c)), c.copy()
    for _ in range(rounds):
        for j in np.flatnonzero(np.diag(a) > 0):
            r = left[j] + a[j, j] * w[j]
            step = np.sign(r) * max(abs(r) - l1, 0.0) / (a[j, j] + l2) - w[j]
            left -= a[:, j] * step
            w[j] += step
    return w


def _by_signs(a: np.ndarray, c: np.ndarray, w: np.ndarray, l1: float, l2: float, slack: np.ndarray, max_steps: int) -> np.ndarray:
    """From ``w`` to the least value: solve for the weights on, stop where one passes zero, else let in the one that pulls most."""
    h = a + l2 * np.eye(len(c))
    value = lambda x: x @ h @ x / 2 - c @ x + l1 * np.abs(x).sum()
    sign = np.sign(w)
    for _ in range(max_steps):
        on = np.flatnonzero(sign)
        goal = np.zeros(len(w))
        goal[on] = np.linalg.lstsq(h[np.ix_(on, on)], c[on] - l1 * sign[on], rcond=None)[0]
        turned = on[(np.sign(goal[on]) != sign[on]) & (w[on] != goal[on])]
        if len(turned):
            tries = [goal]
            for t in np.unique(w[turned] / (w[turned] - goal[turned])):
                tries.append(w + t * (goal - w))
                tries[-1][turned[np.isclose(w[turned] / (w[turned] - goal[turned]), t, rtol=1e-12, atol=0)]] = 0.0
            w = min(tries, key=value)
            sign = np.sign(w)
            continue
        w = goal
        pull = np.where(sign == 0, np.abs(c - h @ w) - l1 - slack, -np.inf)
        if not len(pull) or pull.max() <= 0:
            return w
        sign[pull.argmax()] = np.sign((c - h @ w)[pull.argmax()])
    raise RuntimeError(f"no solution in {max_steps} steps")


def solve_gram(gram: np.ndarray, alpha: float, l1_ratio: float, sweeps: int = 50, max_steps: int = 10_000) -> np.ndarray:
    """Intercept and weights least in ``mean (y - b - xw)^2 / 2 + alpha * (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2)``.

    Ridge is solved in closed form. Lasso and elastic net begin with coordinate descent on the covariances and end with direct
    solutions of the weights that are not zero, since single coordinates creep where columns nearly depend on each other.
    """
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    a, c = cov[:-1, :-1], cov[:-1, -1]
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    if l1 == 0:
        w = np.linalg.lstsq(a + l2 * np.eye(len(c)), c, rcond=None)[0]
    else:
        slack = 1e-10 * np.sqrt(np.maximum(np.diag(a), 0.0) * max(cov[-1, -1], 0.0))
        w = _by_signs(a, c, _swept(a, c, l1, l2, sweeps), l1, l2, slack, max_steps)
    return np.concatenate([[mean[-1] - mean[:-1] @ w], w])


def _mse(gram: np.ndarray, model: np.ndarray) -> float:
    u = np.concatenate([-model, [1.0]])
    return float(u @ gram @ u / gram[0, 0])


def _grid(grams: dict[int, np.ndarray], alphas: list[float], l1_ratios: list[float]) -> list[tuple[float, float, int, float, float]]:
    total = sum(grams.values())
    cells = [(a, r, k, g) for a in alphas for r in l1_ratios for k, g in grams.items() if total[0, 0] > g[0, 0]]
    return [(a, r, k, _mse(g, solve_gram(total - g, a, r)), float(g[0, 0])) for a, r, k, g in cells]


def grid_errors(df: DataFrame, label: str, vec: str = "features", alphas: list[float] = [0.01, 0.1, 1.0], l1_ratios: list[float] = [0.0, 0.5, 1.0],
                folds: int = 5, fold: str | None = None, weight: str | None = None, seed: int = 42) -> DataFrame:
    """(alpha, l1_ratio, fold, mse, weight): the error on each fold of the model of the other folds, for the whole grid."""
    have = df if fold else df.withColumn("_fold", _fold(vec, folds, seed))
    grams, _ = fold_grams(have, label, vec, fold or "_fold", weight)
    return df.sparkSession.createDataFrame(_grid(grams, alphas, l1_ratios) if grams else [], "alpha double, l1_ratio double, fold int, mse double, weight double")


def linear_grid(train: DataFrame, test: DataFrame, label: str, vec: str = "features", alphas: list[float] = [0.01, 0.1, 1.0],
                l1_ratios: list[float] = [0.0, 0.5, 1.0], folds: int = 5, fold: str | None = None, weight: str | None = None, seed: int = 42) -> DataFrame:
    """Ridge (ratio 0), lasso (1) and elastic net: best of the grid by the mean error over folds, errors on ``test``.

    All folds and all models come from one scan of ``train`` (``fold_grams``). Without a ``fold`` column rows are dealt by a
    hash of their vector, so copies share a fold. Rows without a finite label, vector or a positive weight are left out;
    vectors must have one length.
    """
    have = train if fold else train.withColumn("_fold", _fold(vec, folds, seed))
    grams, shift = fold_grams(have, label, vec, fold or "_fold", weight)
    if not grams:
        raise ValueError("no row of the training table has a label and a vector")
    errors: dict[tuple[float, float], list[float]] = {(a, r): [] for a in alphas for r in l1_ratios}
    for a, r, _, mse, _ in _grid(grams, alphas, l1_ratios):
        errors[a, r].append(mse)
    alpha, ratio = min(errors, key=lambda k: np.mean(errors[k]) if errors[k] else 0.0)
    model = solve_gram(sum(grams.values()), alpha, ratio)
    model[0] += shift[-1] - shift[:-1] @ model[1:]
    weights = F.array(*[F.lit(float(x)) for x in model[1:]])
    scored = _usable(test, label, vec, None).withColumn("_p", F.aggregate(F.zip_with("_x", weights, lambda x, w: x * w), F.lit(float(model[0])), lambda s, x: s + x))
    return scored.agg(F.avg((F.col("_y") - F.col("_p")) ** 2).alias("mse"), guarded_corr(F.col("_y"), F.col("_p")).alias("pearson"),
                      F.count(F.lit(1)).alias("n")).withColumns({"alpha": F.lit(alpha), "l1_ratio": F.lit(ratio)})


def boosted(train: DataFrame, test: DataFrame, label: str, vec: str = "features", depth: int = 4, rounds: int = 20,
            rate: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Boosted trees: predictions on ``test`` and the feature importances, largest first."""
    model = GBTRegressor(featuresCol="_features", labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=rate, seed=seed).fit(_vectors(train, vec))
    weights = [(int(k), float(v)) for k, v in enumerate(model.featureImportances.toArray())]
    importances = train.sparkSession.createDataFrame(weights, "dim int, importance double").orderBy(F.desc("importance"), "dim")
    return model.transform(_vectors(test, vec)).drop("_features"), importances


def boosted_folds(df: DataFrame, label: str, vec: str = "features", folds: int = 5, fold: str | None = None, weight: str | None = None,
                  tau: float = 0.0, depth: int = 4, rounds: int = 20, rate: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Boosted trees by cross-validation: (predictions, report).

    Each usable row (see ``linear_grid``) gets the ``prediction`` of the model of the other folds. The report has (weighted) mse and
    mae, pearson, the share of equal signs where both sides exceed ``tau``, and n per fold, and over all rows with a null fold.
    A fold that holds all rows has no model and gives no prediction.
    """
    named = fold or "fold"
    rows = _usable(df if fold else df.withColumn(named, _fold(vec, folds, seed)), label, vec, weight)
    rows = written(rows.withColumn(named, F.col(named).cast("int")).withColumnRenamed("_w", "_weight"), "boosted")
    counts = {r[0]: r[1] for r in rows.groupBy(named).count().collect()}  # one number a fold
    ready = rows.withColumn("_features", array_to_vector("_x"))
    trees = GBTRegressor(featuresCol="_features", labelCol="_y", weightCol="_weight", maxDepth=depth, maxIter=rounds, stepSize=rate, seed=seed)
    parts = [trees.fit(ready.where(F.col(named) != k)).transform(ready.where(F.col(named) == k)) for k in sorted(counts) if len(counts) > 1]
    scored = reduce(DataFrame.unionByName, parts) if parts else ready.where("false").withColumn("prediction", F.lit(0.0))
    error, w = F.col("_y") - F.col("prediction"), F.col("_weight")
    both = (F.abs("_y") > tau) & (F.abs("prediction") > tau)
    measures = [F.try_divide(F.sum(w * error * error), F.sum(w)).alias("mse"), F.try_divide(F.sum(w * F.abs(error)), F.sum(w)).alias("mae"),
                guarded_corr(F.col("_y"), F.col("prediction")).alias("pearson"),
                F.coalesce(F.avg(F.when(both, (F.signum("_y") == F.signum("prediction")).cast("double"))), F.lit(float("nan"))).alias("sign_agreement"),
                F.count(F.lit(1)).alias("n")]
    scored = written(scored.drop("_features"), "boosted")
    report = scored.groupBy(F.col(named).alias("fold")).agg(*measures).unionByName(scored.agg(F.lit(None).cast("int").alias("fold"), *measures))
    return scored.drop("_x", "_y", "_weight"), report


def score_pairs(features: DataFrame, pairs: DataFrame, u: list[list[float]], v: list[list[float]], bias: float = 0.0,
                by: str = "graph_id", mi_weight: float = 0.0, distance_bias: list[float] | None = None,
                symmetric: bool = False, squash: bool = False) -> DataFrame:
    """Low-rank pair logits ``<U h_i, V h_j> + b`` with given weights.

    Each position is projected once, then joined to the pair list. Optional parts: ``mi_weight`` times
    the pair's ``mi``, a bias per clipped ``|i-j|``, the mean with the swapped pair, a sigmoid.
    """
    low = features.select(by, "idx", project("features", u).alias("_u"), project("features", v).alias("_v"))
    end = lambda e: low.select(by, F.col("idx").alias(e), F.col("_u").alias(f"_u{e}"), F.col("_v").alias(f"_v{e}"))
    joined = pairs.join(end("i"), [by, "i"]).join(end("j"), [by, "j"])
    logit = dot("_ui", "_vj")
    if symmetric:
        logit = (logit + dot("_uj", "_vi")) / 2
    logit = logit + bias
    if mi_weight:
        logit = logit + mi_weight * F.coalesce("mi", F.lit(0.0))
    if distance_bias:
        table = F.array(*[F.lit(float(b)) for b in distance_bias])
        sep = F.least(F.abs(F.col("i") - F.col("j")), F.lit(len(distance_bias) - 1))
        logit = logit + F.element_at(table, sep.cast("int") + 1)
    score: Column = 1 / (1 + F.exp(-logit)) if squash else logit
    return joined.select(*pairs.columns, score.alias("score"))


def infer_cached(df: DataFrame, cache: DataFrame, seq: str, fn: Callable[[pd.Series], pd.Series], model: str = "model",
                 out_type: str = "double") -> tuple[DataFrame, DataFrame]:
    """(all results, new cache rows): each distinct text that the cache lacks is inferred once.

    ``fn`` maps a batch of texts to results. Cache: ``key, result``. The key covers model and text.
    """
    keyed = df.withColumn("key", content_key(F.lit(model), seq))
    todo = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min(seq).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "result": fn(pdf["_text"])})

    fresh = todo.mapInPandas(run, f"key string, result {out_type}")
    every = cache.select("key", "result").unionByName(fresh)
    return keyed.join(every, "key", "left"), fresh
