import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from support import rows
from protspark.operators import centrality as C
from protspark.operators import residue_graph as G


def random_graph(spark, seed=2, n=9, graphs=("a", "b")):
    rnd = random.Random(seed)
    edges = [(g, i, j, round(rnd.uniform(0.5, 3), 2), 1.0) for g in graphs for i, j in itertools.combinations(range(n), 2) if rnd.random() < 0.35]
    return edges, spark.createDataFrame(edges, "graph_id string, i long, j long, w double, dist double")


def all_shortest(edges, g, weighted):
    """Every shortest path between ordered node pairs, by enumeration of simple paths."""
    adj = {}
    for gg, i, j, w, _ in edges:
        if gg == g:
            adj.setdefault(i, []).append((j, w if weighted else 1.0))
            adj.setdefault(j, []).append((i, w if weighted else 1.0))
    best = {}

    def walk(path, length):
        key = (path[0], path[-1])
        if len(path) > 1:
            known = best.get(key)
            if known is None or length < known[0] - 1e-9:
                best[key] = (length, [tuple(path)])
            elif abs(length - known[0]) <= 1e-9:
                known[1].append(tuple(path))
        for nxt, w in adj[path[-1]]:
            if nxt not in path:
                walk(path + [nxt], length + w)

    for s in adj:
        walk([s], 0.0)
    return adj, best


def test_betweenness_and_closeness(spark):
    edges, df = random_graph(spark)
    for weight in (None, "w"):
        bc = {(r[0], r[1]): r[2] for r in C.betweenness(df, weight=weight).collect()}
        cc = {(r[0], r[1]): r[2] for r in C.closeness(df, weight=weight).collect()}
        for g in ("a", "b"):
            adj, best = all_shortest(edges, g, weight is not None)
            n = len(adj)
            for v in adj:
                b = sum(sum(v in p[1:-1] for p in ps) / len(ps) for _, ps in best.values()) / ((n - 1) * (n - 2))
                assert math.isclose(bc[g, v], b, abs_tol=1e-9)
                d = [length for (s, _), (length, _) in best.items() if s == v]
                assert math.isclose(cc[g, v], len(d) / sum(d) * len(d) / (n - 1), abs_tol=1e-9)


def test_path_graph_betweenness(spark):
    df = spark.createDataFrame([("p", k, k + 1, 1.0, 1.0) for k in range(4)], "graph_id string, i long, j long, w double, dist double")
    assert [round(r[2], 6) for r in sorted(C.betweenness(df).collect())] == [0.0, 0.5, round(4 / 6, 6), 0.5, 0.0]


def test_pagerank_and_eigenvector_match_dense(spark):
    edges, df = random_graph(spark)
    nodes = spark.createDataFrame([(g, k) for g in "ab" for k in range(10)], "graph_id string, idx long")  # node 9 is isolated
    pr = {(r[0], r[1]): r[2] for r in C.pagerank(df, nodes, iters=100, tol=1e-10).collect()}
    ev = {(r[0], r[1]): r[2] for r in C.eigenvector_centrality(df, nodes, iters=200, tol=1e-10).collect()}
    for g in "ab":
        mat = np.zeros((10, 10))
        for gg, i, j, w, _ in edges:
            if gg == g:
                mat[i, j] = mat[j, i] = w
        out = mat.sum(axis=1)
        x = np.full(10, 0.1)
        for _ in range(300):
            x = 0.85 * (mat.T @ np.divide(x, out, where=out > 0, out=np.zeros(10)) + x[out == 0].sum() / 10) + 0.015
        assert np.allclose([pr[g, k] for k in range(10)], x, atol=1e-8)
        assert math.isclose(sum(x), 1.0, abs_tol=1e-9) and ev[g, 9] == 0.0
        top = np.abs(np.linalg.eigh(mat)[1][:, -1])
        assert np.allclose([ev[g, k] for k in range(10)], top, atol=1e-5)


def test_dense_and_iterative_solvers_agree(spark):
    edges, df = random_graph(spark)
    nodes = spark.createDataFrame([(g, k) for g in "ab" for k in range(10)], "graph_id string, idx long")
    src, snk = nodes.where("idx = 0"), nodes.where("idx = 6")
    dense = {(r[0], r[1]): r[2] for r in G.potentials(df, nodes, src, snk).collect()}
    cg = {(r[0], r[1]): r[2] for r in G.potentials(df, nodes, src, snk, max_nodes=1).collect()}
    assert dense.keys() == cg.keys() and len(dense) == 20
    for g in "ab":
        mat = np.zeros((10, 10))
        for gg, i, j, w, _ in edges:
            if gg == g:
                mat[i, j] = mat[j, i] = w
        b = np.zeros(10)
        b[0], b[6] = 1, -1
        want = np.linalg.solve(np.diag(mat.sum(axis=1)) - mat + 1e-3 * np.eye(10), b)
        assert np.allclose([dense[g, k] for k in range(10)], want, atol=1e-8)
        assert np.allclose([cg[g, k] for k in range(10)], want, atol=1e-6)
        assert abs(want.sum()) < 1e-6


def test_uncharged_graph_stays_at_zero(spark):
    _, df = random_graph(spark)
    nodes = G.graph_nodes(df)
    only_a = nodes.where("graph_id = 'a'")
    cg = G.potentials(df, nodes, only_a.where("idx = 0"), only_a.where("idx = 6"), max_nodes=1)
    assert {r["phi"] for r in cg.where("graph_id = 'b'").collect()} == {0.0}


def test_sink_overrides_source(spark):
    _, df = random_graph(spark, graphs=("a",))
    nodes = G.graph_nodes(df)
    one = nodes.where("idx = 0")
    charged = G._charges(nodes, one, one)
    assert charged.where("idx = 0").first()["b"] == -1.0


def test_minmax_constant_graph_and_conductance(spark):
    df = spark.createDataFrame([("a", 0, 1, 2.0), ("a", 1, 2, 2.0), ("b", 0, 1, 1.0), ("b", 1, 2, 3.0)], "graph_id string, i long, j long, g_mem double")
    assert [r["g_mem"] for r in G.minmax_by_graph(df).orderBy("graph_id", "i").collect()][:3] == [0.0, 0.0, 0.0]
    noisy = G.minmax_by_graph(df, jitter=1e-3).where("graph_id = 'a'")
    assert all(abs(r["g_mem"]) < 0.1 for r in noisy.collect())
    f = df.withColumn("g_mem", F.lit(float("nan"))).withColumn("flux", F.lit(2.0))
    assert math.isclose(G.adapt_conductance(f).first()["g_mem"], 0.8 + 0.2 * 3.0)


def test_build_graphs_skips_short_chains(spark):
    rnd = random.Random(1)
    pts = [("big", k, *(rnd.uniform(0, 20) for _ in range(3))) for k in range(12)] + [("small", k, *(rnd.uniform(0, 20) for _ in range(3))) for k in range(7)]
    g = G.build_graphs(spark.createDataFrame(pts, "model_id string, idx long, x double, y double, z double"), topk=3)
    assert {r[0] for r in g.select("graph_id").distinct().collect()} == {"big"}
    assert g.agg(F.min("g_mem"), F.max("g_mem")).first()[0] == 0.0


def test_scalers_keep_memory_raw(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5],), ([3.0, 2.0, 0.7],)], "features array<double>")
    out = sorted(tuple(r[0]) for r in G.apply_scalers(df, G.fit_scalers(df), keep_raw=2).collect())
    assert np.allclose(out, [(-1.0, 0.0, 0.5), (1.0, 0.0, 0.7)], atol=1e-5)


def test_normalize_weights_needs_both_ends(spark):
    df = spark.createDataFrame([("a", 0, 1, 2.0), ("a", 1, 2, 2.0)], "graph_id string, i long, j long, w double")
    lig = spark.createDataFrame([("a", 0, 2), ("a", 0, 99)], "graph_id string, i long, j long")
    got = rows(G.normalize_weights(df, lig, G.graph_nodes(df)))
    assert got == [("a", 0, 1, 0.1), ("a", 0, 2, 1.0), ("a", 1, 2, 0.1)]


def test_gradients_of_small_graphs_need_no_rounds_of_joins(spark, monkeypatch):
    """In a task or by joins: the same potentials, also with parallel links, loops, nodes without links and graphs without charge."""
    rng = random.Random(3)
    pairs = [(g, i, j, rng.uniform(0.1, 2)) for g in "abc" for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.4]
    df = spark.createDataFrame(pairs + [("a", 0, 1, 5.0), ("a", 2, 2, 3.0), ("b", 1, 2, None), ("b", 3, 99, 1.0), ("b", None, 3, 1.0)], "graph_id string, i long, j long, w double")
    nodes = spark.createDataFrame([(g, k) for g in "abcd" for k in [*range(14), None]], "graph_id string, idx long")
    src, snk = nodes.where("idx = 0 AND graph_id != 'c'"), nodes.where("idx = 13 AND graph_id != 'c'")
    solve = lambda: {(r[0], r[1]): r[2] for r in G.potentials(df, nodes, src, snk, max_nodes=1).collect()}
    monkeypatch.setattr(G, "IN_TASK", 0)
    joined = solve()
    monkeypatch.undo()
    monkeypatch.setattr(G, "_rounds", None)
    packed = solve()
    assert len(joined) == 60 and packed.keys() == joined.keys() and max(abs(packed[k] - joined[k]) for k in joined) < 1e-6
