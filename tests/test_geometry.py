import math
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from support import rows
from protspark.operators import alignments as A
from protspark.operators import geometry as G


def cloud(spark, sizes, seed=1, span=30.0, copies=0):
    rnd = random.Random(seed)
    pts = [(m, k, *(round(rnd.uniform(0, span), 3) for _ in range(3))) for m, n in sizes.items() for k in range(n)]
    pts += [("dup", k, 1.0, 2.0, 3.0) for k in range(copies)]
    return pts, spark.createDataFrame(pts, "model_id string, idx long, x double, y double, z double")


def pairs(pts):
    return [(a, b, math.dist(a[2:], b[2:])) for a in pts for b in pts if a[0] == b[0] and a[1] < b[1]]


def test_radius_pairs_small_and_large_models(spark):
    pts, df = cloud(spark, {"s": 9, "m": 40, "l": 150})
    for closed in (True, False):
        want = sorted((a[0], a[1], b[1]) for a, b, d in pairs(pts) if (d <= 8.0 if closed else d < 8.0))
        assert rows(G.contacts(df, 8.0, closed=closed), "model_id", "i", "j") == want


def test_threshold_is_closed_by_default(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0), ("a", 1, 8.0, 0.0, 0.0)], "model_id string, idx long, x double, y double, z double")
    assert G.contacts(df, 8.0).count() == 1 and G.contacts(df, 8.0, closed=False).count() == 0


def test_crowded_cell_is_salted(spark, monkeypatch):
    monkeypatch.setattr(G, "CROWDED_CELL", 7)
    pts, df = cloud(spark, {"m": 60}, span=4.0)
    want = sorted((a[1], b[1]) for a, b, d in pairs(pts) if d <= 8.0)
    assert rows(G.contacts(df, 8.0), "i", "j") == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.floats(-20, 20, width=32)] * 3), min_size=30, max_size=45))
def test_grid_equals_brute_force(spark, coords):
    pts = [("m", k, *map(float, c)) for k, c in enumerate(coords)]
    df = spark.createDataFrame(pts, "model_id string, idx long, x double, y double, z double")
    sure = {(a[1], b[1]) for a, b, d in pairs(pts) if d < 5.0 - 1e-9}
    maybe = {(a[1], b[1]) for a, b, d in pairs(pts) if d <= 5.0 + 1e-9}
    got = {(r["i"], r["j"]) for r in G.contacts(df, 5.0).collect()}
    assert sure <= got <= maybe


def test_missing_coordinates(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0), ("a", 1, None, 0.0, 0.0), ("a", 2, 1.0, 0.0, float("nan")), ("a", 3, 1.0, 0.0, 0.0)],
                               "model_id string, idx long, x double, y double, z double")
    assert rows(G.contact_labels(df), "i", "j", "y") == [(0, 3, 1)]
    assert rows(G.valid_pairs(df)) == [("a", 4, 2, 1)]


def test_neighbours_with_copies_and_sparse_tail(spark):
    pts, df = cloud(spark, {"a": 70, "b": 5, "far": 3}, copies=40)
    far = [("a", 500, 900.0, 900.0, 900.0)]
    pts += far
    df = df.union(spark.createDataFrame(far, df.schema))
    got = {}
    for r in G.neighbours(df, 4, 2).collect():
        got.setdefault((r["model_id"], r["i"]), []).append((round(r["dist"], 9), r["j"]))
    for p in pts:
        want = sorted((round(math.dist(p[2:], q[2:]), 9), q[1]) for q in pts if q[0] == p[0] and abs(q[1] - p[1]) >= 2)[:4]
        assert sorted(got.get((p[0], p[1]), [])) == want


def test_ligand_contacts_and_hbonds(spark):
    ca = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0, "N"), ("a", 2, 9.0, 0.0, 0.0, "O")], "model_id string, idx long, x double, y double, z double, element string")
    lig = spark.createDataFrame([("a", 7, 3.0, 0.0, 0.0, "o"), ("a", 8, 0.0, 3.0, 0.0, "C")], ca.schema)
    assert rows(G.ligand_contacts(ca, lig)) == [("a", 1)]
    assert rows(G.hbond_pairs(ca, lig), "ligand_idx", "protein_idx") == [(7, 1)]


def brute_score(a, b, scheme):
    match, mis, opening, extend = A.SCHEMES[scheme]
    neg = -1e18
    n, m = len(a), len(b)
    M = [[neg] * (m + 1) for _ in range(n + 1)]
    X = [[neg] * (m + 1) for _ in range(n + 1)]
    Y = [[neg] * (m + 1) for _ in range(n + 1)]
    M[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                M[i][j] = max(M[i - 1][j - 1], X[i - 1][j - 1], Y[i - 1][j - 1]) + (match if a[i - 1] == b[j - 1] else mis)
            if i:
                X[i][j] = max(max(M[i - 1][j], Y[i - 1][j]) + opening, X[i - 1][j] + extend)
            if j:
                Y[i][j] = max(max(M[i][j - 1], X[i][j - 1]) + opening, Y[i][j - 1] + extend)
    return max(M[n][m], X[n][m], Y[n][m])


def path_score(q, t, scheme):
    match, mis, opening, extend = A.SCHEMES[scheme]
    total, last = 0.0, None
    for a, b in zip(q, t):
        kind = "q" if a == "-" else "t" if b == "-" else None
        total += (match if a == b else mis) if kind is None else (extend if kind == last else opening)
        last = kind
    return total


@pytest.mark.parametrize("scheme", sorted(A.SCHEMES))
def test_align_pairs_is_optimal(spark, scheme):
    rnd = random.Random(5)
    data = [(k, "".join(rnd.choice("ACDE") for _ in range(rnd.randrange(0, 14))), "".join(rnd.choice("ACDE") for _ in range(rnd.randrange(0, 14)))) for k in range(40)]
    for r in A.align_pairs(spark.createDataFrame(data, "id long, query string, target string"), ["id"], scheme).collect():
        _, q, t = data[r["id"]]
        assert r["qaln"].replace("-", "") == q and r["taln"].replace("-", "") == t
        assert math.isclose(r["score"], brute_score(q, t, scheme), abs_tol=1e-6)
        assert math.isclose(path_score(r["qaln"], r["taln"], scheme), r["score"], abs_tol=1e-6)


def test_map_aligned_walk(spark):
    hits = spark.createDataFrame([(1, "AC-DE", "A-GDE", 2, 1, 10), (2, None, None, None, None, 4)], "hit int, qaln string, taln string, qstart int, tstart int, query_len int")
    assert rows(A.map_aligned(hits, ["hit"]), "q_idx", "t_idx") == [(1, 0), (3, 2), (4, 3)]
    assert rows(A.mapping_stats(hits, ["hit"])) == [(1, 1.0, 0.3), (2, 0.0, 0.0)]


def test_distance_bins(spark):
    df = spark.createDataFrame([(0.0,), (3.99,), (4.0,), (24.0,), (29.9,), (30.0,), (99.0,)], "d double")
    assert [r[0] for r in df.select(A.distance_bin(F.col("d"))).collect()] == [0, 0, 1, 9, 9, 9, 9]


def test_closest_contacts_hold_the_first_ones(spark):
    """Crowds, copies and repeated or missing ids: the first pairs of each model are those of all contacts, from far fewer rows."""
    from protspark.operators.topk import topk_pairs

    rng = random.Random(4)
    at = lambda w: tuple(rng.uniform(-w, w) for _ in range(3))
    places = [at(0.3) for _ in range(12)]
    rows = [("crowd", k, *at(0.2)) for k in range(500)]
    rows += [("copies", k, *places[k % 12]) for k in range(150)] + [("copies", 150, places[0][0] + 1e-16, *places[0][1:])]
    rows += [("tied", k, *((0.0, 0.0, 0.0) if k % 2 else (1e-17, 0.0, 0.0))) for k in range(40)]
    rows += [("sparse", k, k * 0.2, 0.0, 0.0) for k in range(20)] + [("one", 1, 0.0, 0.0, 0.0)]
    rows += [("ids", k % 7, *at(0.05)) for k in range(30)] + [("ids", None, 0.0, 0.0, 0.0), ("ids", 90, None, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0)]
    rows += [("far", k, 1e12 + k % 3, 0.0, 0.0) for k in range(10)]
    p = spark.createDataFrame(rows, "model_id string, idx long, x double, y double, z double")
    n = p.groupBy("model_id").agg(F.count(F.lit(1)).alias("len"))
    score = lambda c: topk_pairs(c.select("model_id", "i", "j", (1 / (1 + F.col("dist"))).alias("score")).join(n, "model_id"), ["model_id"], length="len")
    rank = lambda df: sorted((r.model_id, r.rank, r.i, r.j, r.score) for r in df.collect())
    few, every = G.closest_contacts(p, n, "len", 0.25), G.contacts(p, 0.25)
    assert rank(score(few)) == rank(score(every))
    count = lambda df, m: df.where(F.col("model_id") == m).count()
    assert count(few, "crowd") * 4 < count(every, "crowd") and count(few, "copies") * 3 < count(every, "copies")
