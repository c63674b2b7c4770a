"""Block sweeps and Krylov cycles against dense solutions on graphs that need several blocks, rounds and cycles."""

import math
import random

import numpy as np
import pytest

from protspark.operators import centrality as C

SCHEMA = "graph_id string, i long, j long, w double"


def graphs():
    rng = random.Random(11)
    out = {
        "path": [(k, k + 1, 1.0) for k in range(13)],
        "star": [(0, k, 1.0 + k % 3) for k in range(1, 16)],
        "two parts": [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 1.0), (7, 8, 1.0), (8, 9, 1.0)],
        "pair": [(3, 5, 0.25)],
        "ring with ties": [(k, (k + 1) % 12, 1.0) for k in range(12)] + [(0, 6, 3.0)],
        "dense": [(i, j, round(rng.uniform(0.1, 2), 2)) for i in range(15) for j in range(i + 1, 15) if rng.random() < 0.3],
    }
    return out, [(g, i, j, w) for g, es in out.items() for i, j, w in es]


def distances(edges, weighted):
    ids = sorted({x for i, j, _ in edges for x in (i, j)})
    at = {x: k for k, x in enumerate(ids)}
    d = np.full((len(ids), len(ids)), math.inf)
    np.fill_diagonal(d, 0)
    for i, j, w in edges:
        a, b = at[i], at[j]
        d[a, b] = d[b, a] = min(d[a, b], w if weighted else 1.0)
    step = d.copy()
    for k in range(len(ids)):
        d = np.minimum(d, d[:, k:k + 1] + d[k:k + 1])
    return ids, step, d


def brute(edges, weighted):
    """Closeness and betweenness by counting paths in order of distance."""
    ids, step, d = distances(edges, weighted)
    n = len(ids)
    count = np.zeros((n, n))
    for s in range(n):
        count[s, s] = 1
        for v in np.argsort(d[s], kind="stable"):
            if v != s and d[s, v] < math.inf:
                count[s, v] = sum(count[s, u] for u in range(n) if u != v and step[u, v] < math.inf and abs(d[s, u] + step[u, v] - d[s, v]) < 1e-9)
    close, between = {}, {}
    for v in range(n):
        near = d[v][(d[v] < math.inf) & (d[v] > 0)]
        close[ids[v]] = len(near) / near.sum() * len(near) / (n - 1) if len(near) else 0.0
        b = sum(count[s, v] * count[v, t] / count[s, t] for s in range(n) for t in range(n)
                if s != v and t != v and s != t and d[s, t] < math.inf and abs(d[s, v] + d[v, t] - d[s, t]) < 1e-9)
        between[ids[v]] = b / ((n - 1) * (n - 2)) if n > 2 else b
    return close, between


@pytest.mark.parametrize("weight, block", [(None, 6), ("w", 10), ("w", 62)])
def test_blocks_of_sources(spark, weight, block):
    out, rows = graphs()
    df = spark.createDataFrame(rows, SCHEMA)
    close = {(r.graph_id, r.idx): r.closeness for r in C.closeness(df, weight=weight, block=block).collect()}
    between = {(r.graph_id, r.idx): r.betweenness for r in C.betweenness(df, weight=weight, block=block).collect()}
    want = {g: brute(es, bool(weight)) for g, es in out.items()}
    assert close.keys() == between.keys() == {(g, v) for g, (c, _) in want.items() for v in c}
    for (g, v), x in close.items():
        assert math.isclose(x, want[g][0][v], abs_tol=1e-9) and math.isclose(between[g, v], want[g][1][v], abs_tol=1e-9)


def test_isolated_nodes_and_no_edges(spark):
    df = spark.createDataFrame([("g", 1, 2, 1.0)], SCHEMA)
    nodes = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("alone", 4)], "graph_id string, idx long")
    assert {(r.graph_id, r.idx): r.closeness for r in C.closeness(df, nodes, block=2).collect()} == {("g", 1): 0.5, ("g", 2): 0.5, ("g", 3): 0.0, ("alone", 4): 0.0}
    assert {r.betweenness for r in C.betweenness(df, nodes, block=2).collect()} == {0.0}
    empty = df.where("false")
    for f in (C.closeness, C.betweenness, C.pagerank, C.eigenvector_centrality):
        assert f(empty).collect() == []


def test_eigenvector_of_slow_graphs(spark):
    """A long path has a small gap: power iteration would need some thousand rounds."""
    out, rows = graphs()
    del out["two parts"]
    out["long path"] = [(k, k + 1, 1.0) for k in range(30)]
    rows = [(g, i, j, w) for g, es in out.items() for i, j, w in es]
    got = {(r.graph_id, r.idx): r.eigen for r in C.eigenvector_centrality(spark.createDataFrame(rows, SCHEMA), tol=1e-12).collect()}
    for g, es in out.items():
        ids = sorted({x for i, j, _ in es for x in (i, j)})
        m = np.zeros((len(ids), len(ids)))
        for i, j, w in es:
            m[ids.index(i), ids.index(j)] = m[ids.index(j), ids.index(i)] = w
        want = np.abs(np.linalg.eigh(m)[1][:, -1])
        assert np.allclose([got[g, k] for k in ids], want, atol=1e-8), g


def test_pagerank_with_dangling_nodes(spark):
    out, rows = graphs()
    nodes = [(g, x) for g, es in out.items() for x in {x for i, j, _ in es for x in (i, j)}] + [("star", 100), ("star", 101), ("none", 1), ("none", 2)]
    df, nd = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(nodes, "graph_id string, idx long")
    got = {(r.graph_id, r.idx): r.pagerank for r in C.pagerank(df, nd, tol=1e-14).collect()}
    plain = {(r.graph_id, r.idx): r.pagerank for r in C.pagerank(df, nd, tol=None, iters=40).collect()}
    for g in {g for g, _ in nodes}:
        ids = sorted(x for h, x in nodes if h == g)
        n = len(ids)
        m = np.zeros((n, n))
        for i, j, w in out.get(g, []):
            m[ids.index(i), ids.index(j)] = m[ids.index(j), ids.index(i)] = w
        total = m.sum(axis=1)
        step = np.where(total[:, None] > 0, m / np.where(total, total, 1)[:, None], 1 / n)
        want = np.linalg.solve(np.eye(n) - 0.85 * step.T, np.full(n, 0.15 / n))
        assert np.allclose([got[g, k] for k in ids], want, atol=1e-12) and np.allclose([plain[g, k] for k in ids], want, atol=1e-3)
