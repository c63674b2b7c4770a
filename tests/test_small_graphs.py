"""Stacked matrices and joins give the same centralities, and each is used where it should be."""

import math

import pytest
from support import rows
from test_sweeps import SCHEMA, graphs

from protspark.operators import centrality as C
from protspark.operators import small_graphs as S

MEASURES = {
    "closeness": C.closeness, "closeness w": lambda e: C.closeness(e, weight="w"),
    "betweenness": C.betweenness, "betweenness w": lambda e: C.betweenness(e, weight="w"),
    "pagerank": lambda e: C.pagerank(e, tol=1e-14), "pagerank 6": lambda e: C.pagerank(e, iters=6, tol=None),
    "eigen": lambda e: C.eigenvector_centrality(e, tol=1e-12), "eigen 6": lambda e: C.eigenvector_centrality(e, iters=6, tol=None)}


@pytest.mark.parametrize("name", MEASURES)
def test_both_forms_agree(spark, monkeypatch, name):
    """Parallel edges, loops, missing weights, a graph of null ends and one without an id are among the rows."""
    out = graphs()[1] + [("star", 0, 3, 0.5), ("pair", 3, 3, 0.5), ("pair", 5, 3, 2.0), ("path", 2, 9, None), ("odd", 1, None, 1.0), ("odd", 1, 2, 1.0), (None, 1, 2, 1.0)]
    df = spark.createDataFrame([r for r in out if r[0] != "two parts" or not name.startswith("eigen")], SCHEMA)
    few = {}
    for most in (S.SMALL_EDGES, 0):
        monkeypatch.setattr(S, "SMALL_EDGES", most)
        got = {(r[0], r[1]): r[2] for r in MEASURES[name](df).collect()}
        few = few or got
        assert got.keys() == few.keys() and all(x == few[k] or math.isclose(x, few[k], abs_tol=1e-9) for k, x in got.items()), most


def test_small_graphs_take_no_rounds(spark, monkeypatch):
    """Rounds on disk were what stopped these queries on large tables: small graphs need none."""
    def no(*_):
        raise AssertionError("a round of joins")
    for f in ("_round", "_relaxed", "_settled"):
        monkeypatch.setattr(C, f, no)
    df = spark.createDataFrame(graphs()[1], SCHEMA)
    assert all(rows(f(df)) for f in MEASURES.values())


def test_lengths_beyond_a_double(spark):
    df = spark.createDataFrame([("g", 1, 2, 1e30), ("g", 2, 3, 1e-30), ("g", 3, 4, 1e-30)], SCHEMA)
    with pytest.raises(ValueError, match="add up"):
        C.betweenness(df, weight="w").collect()


def test_structures_are_solved_in_their_row(spark, monkeypatch):
    """A round of joins per step of conjugate gradients took too long for structures beyond the dense limit."""
    from protspark.operators import residue_graph as G

    edges = spark.createDataFrame([("a", k, (7 * k + s) % 300, 0.1 + (k * s) % 5) for k in range(300) for s in (1, 3)] + [("b", 1, 2, 1.0)], SCHEMA)
    edges = edges.selectExpr("graph_id", "least(i, j) AS i", "greatest(i, j) AS j", "w")
    nodes = G.graph_nodes(edges)
    ends = [nodes.groupBy("graph_id").agg(f("idx").alias("idx")) for f in (G.F.min, G.F.max)]
    dense = rows(G.potentials(edges, nodes, *ends, max_nodes=2_000))
    monkeypatch.setattr(G, "_solve_cg", None)
    packed = rows(G.potentials(edges, nodes, *ends, max_edges=1_000))
    assert len(packed) == 302 and all(a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-6) for a, b in zip(packed, dense))
    points = spark.createDataFrame([("m", k, k * 0.9 % 7.0, k * 1.7 % 5.0, k * 0.01) for k in range(300)], "model_id string, idx long, x double, y double, z double")
    assert G.build_graphs(points).count() > 300
