"""Linear models from fold sums, boosted folds and iterated potentials against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from protspark.operators import evaluation as E
from protspark.operators import learning as L
from protspark.operators import residue_graph as G

SCHEMA = "k long, features array<double>, y double, w double, fold int"


def data(n=240, d=5, offset=1e4):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, d)) + offset
    y = x @ np.array([2.0, -1.0, 0.0, 0.0, 0.5]) + rng.normal(size=n) * 0.3 + 7
    return x, y, rng.integers(1, 4, n).astype(float), np.arange(n) % 4


def frame(spark, x, y, w, fold, extra=()):
    rows = [(k, x[k].tolist(), float(y[k]), float(w[k]), int(fold[k])) for k in range(len(y))]
    return spark.createDataFrame([*rows, *extra], SCHEMA).repartition(5)


ODD = [(900, None, 1.0, 1.0, 0), (901, [1.0] * 5, None, 1.0, 1), (902, [float("nan")] * 5, 1.0, 1.0, 2), (903, [1.0, None, 1.0, 1.0, 1.0], 1.0, 1.0, 3),
       (904, [1.0] * 5, float("inf"), 1.0, 0), (905, [1.0] * 5, 1.0, None, 1), (906, [1.0] * 5, 1.0, 0.0, 1)]


def ridge(x, y, w, alpha):
    mean, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    a = (x - mean).T @ ((x - mean) * w[:, None]) / w.sum() + alpha * np.eye(x.shape[1])
    b = np.linalg.solve(a, (x - mean).T @ ((y - my) * w) / w.sum())
    return my - mean @ b, b


def test_ridge_errors_by_fold(spark):
    x, y, w, fold = data()
    got = L.grid_errors(frame(spark, x, y, w, fold, ODD), "y", alphas=[0.0, 0.3], l1_ratios=[0.0], fold="fold", weight="w").collect()
    assert len(got) == 8
    for r in got:
        at = fold == r.fold
        b0, b = ridge(x[~at], y[~at], w[~at], r.alpha)
        assert r.mse == pytest.approx(np.average((y[at] - b0 - x[at] @ b) ** 2, weights=w[at]), rel=1e-6) and r.weight == w[at].sum()


@pytest.mark.parametrize("ratio", [0.4, 1.0])
def test_coordinate_descent_meets_its_conditions(spark, ratio):
    x, y, w, fold = data(offset=3.0)
    grams, shift = L.fold_grams(frame(spark, x, y, w, fold, ODD), "y", "features", "fold", "w")
    model = L.solve_gram(sum(grams.values()), 0.2, ratio)
    z = np.column_stack([x, y]) - shift
    left = z[:, -1] - model[0] - z[:, :-1] @ model[1:]
    slope = ((z[:, :-1] - np.average(z[:, :-1], axis=0, weights=w)) * (left * w)[:, None]).sum(axis=0) / w.sum() - 0.2 * (1 - ratio) * model[1:]
    on = model[1:] != 0
    assert 0 < on.sum() < 5 and abs(np.average(left, weights=w)) < 1e-9
    assert np.allclose(slope[on], 0.2 * ratio * np.sign(model[1:][on]), atol=1e-9) and (abs(slope[~on]) <= 0.2 * ratio + 1e-9).all()
    with pytest.raises(RuntimeError):
        L.solve_gram(sum(grams.values()), 0.2, ratio, max_steps=0)


def test_steps_by_signs_equal_long_coordinate_descent():
    rng = np.random.default_rng(3)
    for d, l1 in [(1, 0.1), (4, 0.05), (12, 0.3), (12, 0.01), (30, 0.1)]:
        x = rng.normal(size=(60, d)) @ rng.normal(size=(d, d))
        a, c = x.T @ x / 60, x.T @ rng.normal(size=60) / 60 * 5
        want = L._swept(a, c, l1, 0.1, 20_000)
        for start in (np.zeros(d), L._swept(a, c, l1, 0.1, 3), rng.normal(size=d)):
            assert np.allclose(L._by_signs(a, c, start, l1, 0.1, np.full(d, 1e-12), 500), want, atol=1e-7)


def test_linear_grid(spark):
    x, y, w, fold = data()
    df = frame(spark, x, y, w, fold, ODD)
    out = L.linear_grid(df.where("k < 200 OR k >= 900"), df.where("k >= 200"), "y", alphas=[1e-6, 5.0], l1_ratios=[0.0, 1.0]).collect()[0]
    b0, b = ridge(x[:200], y[:200], np.ones(200), 1e-6)
    assert out.n == 42 and out.pearson == out.pearson  # rows 905 and 906 lack a weight only
    few = L.linear_grid(df.where("k < 200"), df.where("k >= 200 AND k < 900"), "y", alphas=[1e-6], l1_ratios=[0.0], fold="fold").collect()[0]
    assert few.mse == pytest.approx(np.mean((y[200:] - b0 - x[200:] @ b) ** 2), rel=1e-5) and few.pearson > 0.95
    with pytest.raises(ValueError):
        L.linear_grid(df.where("k > 1000"), df, "y")
    assert L.grid_errors(df.where("k > 1000"), "y").count() == 0


def test_boosted_folds(spark):
    x, y, w, fold = data(offset=0.0)
    df = frame(spark, x, y - 7, w, fold, ODD)
    found, report = L.boosted_folds(df, "y", fold="fold", weight="w", tau=0.2, depth=3, rounds=8, rate=0.3)
    got = sorted((r.k, r.fold, r.y, r.w, r.prediction) for r in found.collect())
    assert [(g[0], g[1]) for g in got] == [(k, int(fold[k])) for k in range(240)] and found.columns == [*df.columns, "prediction"]
    told = {r.fold: r for r in report.collect()}
    assert set(told) == {None, 0, 1, 2, 3}
    for k, r in told.items():
        part = np.array([g[2:] for g in got if k is None or g[1] == k])
        t, ww, p = part.T
        big = (abs(t) > 0.2) & (abs(p) > 0.2)
        assert r.n == len(part) and r.mse == pytest.approx(np.average((t - p) ** 2, weights=ww)) and r.mae == pytest.approx(np.average(abs(t - p), weights=ww))
        assert r.sign_agreement == pytest.approx(np.mean(np.sign(t[big]) == np.sign(p[big]))) and r.pearson == pytest.approx(np.corrcoef(t, p)[0, 1])
    assert told[None].mse < np.var(y)
    assert L.boosted_folds(df.where("k > 1000"), "y", fold="fold")[0].count() == 0


def test_distinct_head(spark):
    df = spark.createDataFrame([("a", v, k) for k, v in enumerate([5, 3, 5, 4, 9, 3, 1])] + [("b", None, 9)], "g string, v int, ord int")
    head = lambda *by: sorted(map(tuple, E.distinct_head(df, "v", ["g"], 3, *by).collect()))
    assert head("ord") == [("a", 3, 2, 2), ("a", 4, 1, 3), ("a", 5, 2, 1), ("b", None, 1, 1)]
    assert head() == [("a", 1, 1, 1), ("a", 3, 2, 2), ("a", 4, 1, 3), ("b", None, 1, 1)]


def test_unsolved_potentials_are_an_error(spark):
    edges = spark.createDataFrame([("g", k, k + 1, 1.0 + k % 3) for k in range(12)], "graph_id string, i long, j long, w double")
    nodes, end = G.graph_nodes(edges), lambda i: spark.createDataFrame([("g", i)], "graph_id string, idx long")
    with pytest.raises(RuntimeError):
        G.potentials(edges, nodes, end(0), end(12), max_nodes=1, max_iter=2)
    dense, steps = (sorted(map(tuple, G.potentials(edges, nodes, end(0), end(12), max_nodes=m).collect())) for m in (256, 1))
    assert [d[:2] for d in dense] == [s[:2] for s in steps] and np.allclose([d[2] for d in dense], [s[2] for s in steps], atol=1e-6)
