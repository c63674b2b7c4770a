"""Converged centralities of the registered queries against dense solutions."""

import numpy as np
import pytest

from protspark.functions.lineage import cut
from protspark.operators import centrality as C
from protspark.operators import small_graphs as S
from protspark.plans import residue_graph_queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture
def dense(spark, monkeypatch):
    """Some graphs of the registered queries, as matrices."""
    some = cut(Q.graphs(spark, SF).where("graph_id % 40 = 1"))
    monkeypatch.setattr(Q, "graphs", lambda *_: some)
    mats = {}
    for r in Q.graphs(spark, SF).select("graph_id", "i", "j", "w").collect():
        mats.setdefault(r.graph_id, []).append((r.i, r.j, r.w))
    out = {}
    for g, edges in mats.items():
        ids = sorted({x for i, j, _ in edges for x in (i, j)})
        m = np.zeros((len(ids), len(ids)))
        for i, j, w in edges:
            m[ids.index(i), ids.index(j)] += w
            m[ids.index(j), ids.index(i)] += w
        out[g] = ids, m
    return out


def test_converged_pagerank(spark, dense):
    got = {(r.graph_id, r.idx): r.pagerank for r in Q.pagerank_converged(spark, SF).collect()}
    for g, (ids, m) in dense.items():
        n = len(ids)
        want = np.linalg.solve(np.eye(n) - 0.85 * (m / m.sum(axis=1, keepdims=True)).T, np.full(n, 0.15 / n))
        assert np.allclose([got[g, k] for k in ids], want, atol=1e-6)


def test_converged_eigenvector(spark, monkeypatch):
    """Small weights, which the shift outweighs unless they are scaled."""
    rng = np.random.default_rng(1)
    m = np.triu(rng.uniform(0.01, 0.1, (6, 6)), 1)
    df = spark.createDataFrame([("g", i, j, float(m[i, j])) for i in range(6) for j in range(i + 1, 6)], "graph_id string, i long, j long, w double")
    monkeypatch.setattr(Q, "graphs", lambda *_: df)
    got = {r.idx: r.eigen for r in Q.eigenvector_converged(spark, SF).collect()}
    assert np.allclose([got[k] for k in range(6)], np.abs(np.linalg.eigh(m + m.T)[1][:, -1]), atol=1e-6)


def test_unconverged_is_an_error(spark):
    path = spark.createDataFrame([("p", k, k + 1, 1.0) for k in range(30)], "graph_id string, i long, j long, w double")
    with pytest.raises(RuntimeError, match="converge"):
        C.pagerank(path, iters=2, tol=1e-12).count()
    with pytest.raises(RuntimeError, match="converge"):
        C.eigenvector_centrality(path, iters=2, tol=1e-12).count()


@pytest.mark.parametrize("small", [True, False])
def test_rounding_does_not_stop_eigenvectors(spark, monkeypatch, small):
    """Two parts, equal or nearly so: vectors that were left out as dependent took part of the best one along, and the residual stayed."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in range(150):
        h = int(rng.integers(3, 12))
        part = np.triu(rng.uniform(0.01, 0.1, (h, h)), 1)
        like = 1.0 if g % 4 == 0 else 1 - 10.0 ** -rng.uniform(1, 3)
        m = np.kron(np.diag([1.0, like]), part)
        rows += [(g, int(i), int(j), float(m[i, j])) for i, j in zip(*m.nonzero())]
        values, vectors = np.linalg.eigh(m + m.T)
        top = vectors[:, values > values[-1] - 1e-9]
        x = top @ top.sum(axis=0)
        want[g] = x / np.linalg.norm(x)
    if not small:
        monkeypatch.setattr(S, "SMALL_EDGES", 0)
    df = spark.createDataFrame(rows, "graph_id long, i long, j long, w double")
    got = {(r.graph_id, r.idx): r.eigen for r in C.eigenvector_centrality(df, iters=60, tol=1e-12).collect()}
    assert len(got) == sum(map(len, want.values()))
    assert all(np.allclose([got[g, k] for k in range(len(x))], x, atol=1e-7) for g, x in want.items())
