import math

import numpy as np
import pytest

from protspark.llm import whitening as W

NAN, INF = float("nan"), float("inf")


def brute(rows, components=4):
    """(id, deviation, whitened up to sign, explained) by a dense covariance in plain numpy."""
    used = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(t) for t in {tuple(x) for _, x in used}]
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    c = np.array([[x[j] - sums[j] / n for j in range(d)] for x in fit])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return {i: (n, sum((n * x[j] - sums[j]) ** 2 for j in range(d)), [abs((np.array(x) - np.array(sums) / n) @ u[:, k]) / math.sqrt(e[k]) if e[k] > 1e-9 else None
                for k in range(len(e))], [e[k] / np.trace(v) if np.trace(v) else None for k in range(len(e))]) for i, x in used}


def check(spark, rows, tol=1e-8):
    df = spark.createDataFrame([(i, v, "a", 1.0) for i, v in rows], "vec_id long, embedding array<float>, component string, n double")
    got, want = {}, brute(rows)
    for r in W.whiten(df).collect():
        got.setdefault(r.vec_id, []).append(r)
    assert set(got) == set(want)
    for i, parts in got.items():
        n, deviation, whitened, explained = want[i]
        parts.sort(key=lambda r: r.component)
        assert [r.component for r in parts[:len(whitened)]] == list(range(1, len(whitened) + 1))
        for r, w, e in zip(parts, whitened, explained):
            assert (r.n, r.deviation) == (n, deviation if deviation < 2**63 else None)
            assert (r.whitened is None) == (w is None)
            if w is not None:
                assert abs(abs(r.whitened) - w) < tol * max(1, w) and abs(r.explained - e) < 1e-9 and r.identity_error < 1e-8
    return got


def test_equals_dense_solution(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(9, 9))
    rows = [(i, v.tolist()) for i, v in enumerate((rng.normal(size=(400, 9)) * [9, 7, 5, 3, 1, 1, 1, 1, 1]) @ mix)]
    rows += [(1000 + k, rows[3][1]) for k in range(50)]  # copies fit once
    rows += [(2000, None), (2001, [NAN] * 9), (2002, [1.0] * 8 + [None]), (2003, [INF] + [0.0] * 8), (2004, [])]
    check(spark, rows)


def test_signs_agree_between_rows(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.1]), (2, [-1.0, -0.1])]
    got = check(spark, rows)
    first = [next(r.whitened for r in got[i] if r.component == 1) for i in (1, 2)]
    assert first[0] * first[1] < 0


@pytest.mark.parametrize("rows", [
    [(1, [0.5, 0.5, 0.25])],  # one vector: no variance at all
    [(1, [0.5, 0.5, 0.25]), (2, [0.5, 0.5, 0.25]), (None, [0.5, 1.5, 0.75])],  # one direction only, an id that is null
    [(i, [float(i), 2.0, -float(i * i)]) for i in range(20)],  # a constant entry
    [(i, [float(i)]) for i in range(5)],
], ids=["one", "two", "constant", "one entry"])
def test_few_directions(spark, rows):
    check(spark, rows, 1e-6)


def test_wide_range_of_variances(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=6) * [4e4, 900.0, 20.0, 1.0, 0.3, 0.02]).tolist()) for i in range(300)]
    check(spark, rows, 1e-6)


def test_lengths_and_overflow(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0] * 5), (4, [3e38, -3e38])], "vec_id long, embedding array<float>")
    out = W.whiten(df).collect()
    assert {r.vec_id for r in out} == {1, 2, 4} and all(r.deviation is None for r in out if r.vec_id == 4)
    assert W.whiten(df.filter("vec_id > 9")).collect() == []
    assert W.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


def test_triangular_solve():
    rng = np.random.default_rng(7)
    r = np.triu(rng.normal(size=(6, 6))) + 3 * np.eye(6)
    x = rng.normal(size=(10, 6))
    assert np.allclose(W._solved(x, r) @ r, x)
