"""Metrics, drift, splits, profiles, variants, naming: ties, blanks, empty groups."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from support import rows
from protspark.functions import columns as C
from protspark.operators import cleaning, drift, evaluation as E, learning, profiles as P, splits, topk as T, variants as V
from protspark.streaming.monitor import monitor_stream


def scores(spark, data):
    return spark.createDataFrame(data, "g string, s double, y int")


def brute_auc(data):
    pos, neg = [s for _, s, y in data if y], [s for _, s, y in data if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=4, max_size=25).filter(lambda v: 0 < sum(y for _, y in v) < len(v)))
def test_auc_matches_pairs_and_flips(spark, small_groups, data):
    data = [("a", float(s), y) for s, y in data]
    df = scores(spark, data)
    auc = E.roc_auc(df, "s", "y").first()[0]
    assert math.isclose(auc, brute_auc(data))
    assert math.isclose(E.roc_auc(df.withColumn("s", -F.col("s")), "s", "y").first()[0], 1 - auc, abs_tol=1e-12)


def test_one_class_and_no_positives(spark):
    df = scores(spark, [("a", 0.2, 0), ("a", 0.9, 0)])
    assert math.isnan(E.roc_auc(df, "s", "y").first()[0])
    assert E.average_precision(df, "s", "y").first()[0] == 0.0
    assert tuple(E.best_f1(df, "s", "y").first()) == (0.0, 0.5)


def test_average_precision_ties(spark):
    df = scores(spark, [("a", 0.9, 1), ("a", 0.5, 0), ("a", 0.5, 1), ("a", 0.1, 1)])
    assert math.isclose(E.average_precision(df, "s", "y").first()[0], 1 / 3 + 2 / 3 / 3 + 3 / 4 / 3)


def test_best_f1_takes_smallest_threshold(spark):
    df = scores(spark, [("a", 0.8, 1), ("a", 0.05, 0)])
    assert tuple(E.best_f1(df, "s", "y").first()) == (1.0, 0.1)


def test_precision_rules(spark, small_groups):
    df = spark.createDataFrame([("a", (10 - k) / 10, int(k < 3), k) for k in range(10)], "g string, s double, y int, k int")
    assert E.precision_at(df.withColumn("L", F.lit(4)), "s", "y", ["g"], ["k"], "length", length="L").first()["precision"] == 0.75
    assert E.precision_at(df, "s", "y", ["g"], ["k"], "sqrt").first()["k"] == 4
    assert E.precision_at(df, "s", "y", ["g"], ["k"], "frac", 0.2).first()["k"] == 1


def test_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 2.0, 1), (3.0, 5.0, 2), (3.0, 9.0, 3)], "x double, y double, k int")
    rx, ry = np.array([1, 2, 3.5, 3.5]), np.array([1.5, 1.5, 3, 4])
    assert math.isclose(E.spearman(df, "x", "y").first()[0], np.corrcoef(rx, ry)[0, 1])
    assert math.isclose(E.spearman(df, "x", "y", ties="ordinal", ord_col="k").first()[0], 1.0)
    const = df.withColumn("x", F.lit(1.0))
    assert math.isnan(E.safe_pearson(const, "x", "y").first()[0]) and E.safe_pearson(const, "x", "y", missing=0.0).first()[0] == 0.0
    assert math.isnan(E.regression_metrics(const, "x", "y").first()["r2"])
    assert math.isnan(E.sign_agreement(df, "x", "y", 100.0).first()[0])


def test_psi_properties(spark):
    df = spark.createDataFrame([(float(k),) for k in range(100)], "v double")
    edges = drift.quantile_edges(df, "v")
    assert np.allclose(edges, np.quantile(np.arange(100.0), np.linspace(0, 1, 11)))
    p = drift.hist_props(df, "v", edges)
    assert abs(drift.psi(p, p).first()[0]) < 1e-12 and math.isclose(sum(r["p"] for r in p.collect()), 1.0)
    assert drift.quantile_edges(df.where("v < 0"), "v") == [0.0, 1.0]
    one = drift.quantile_edges(df.where("v = 3"), "v")
    assert one == [3 - 1e-6, 3 + 1e-6]
    counts = np.histogram(np.arange(100.0), bins=[0, 10, 50, 99])[0] / 100
    assert np.allclose([r["p"] for r in drift.hist_props(df, "v", [0.0, 10.0, 50.0, 99.0]).orderBy("bin").collect()], counts)
    out = df.where("v > 98").withColumn("v", F.lit(500.0))
    assert {r["p"] for r in drift.hist_props(out, "v", [0.0, 1.0, 2.0]).collect()} == {0.5}
    assert {r["p"] for r in drift.hist_props(out, "v", [0.0, 1.0, 2.0], empty="zero").collect()} == {0.0}


def test_verdict_limits(spark):
    df = spark.createDataFrame([(0.1,), (0.25,), (0.5,)], "v double")
    assert [tuple(r) for r in df.select(*[drift.psi_verdict("v", s) for s in ("four", "watch", "report")]).collect()] == [
        ("slight_shift", "stable", "monitor"), ("moderate_shift", "watch", "investigate"), ("major_shift", "drift", "investigate")]


def test_monitor_batch_form(spark):
    df = spark.createDataFrame([("2024-01-01 01:00:00", 0.5), ("2024-01-02 01:00:00", 1.5), ("2024-01-02 02:00:00", 9.0)], "t string, v double")
    got = monitor_stream(df, "t", "v", [0.0, 1.0, 2.0], [0.5, 0.5]).orderBy("window_start").collect()
    assert [r["n"] for r in got] == [1, 1] and got[0]["verdict"] == "drift"


def test_splits_are_exact_and_disjoint(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    n = {r["split"]: r["count"] for r in splits.split_exact(df, "k", 0.2).groupBy("split").count().collect()}
    assert n == {"val": 21, "train": 82}
    assert splits.split_exact(df.limit(1), "k").first()["split"] == "both"
    again = splits.split_exact(df.repartition(9), "k", 0.2)
    assert rows(again) == rows(splits.split_exact(df, "k", 0.2))
    folds = [r["count"] for r in splits.kfold(df, "k").groupBy("fold").count().collect()]
    assert sorted(folds) == [20, 20, 21, 21, 21]
    grouped = splits.split_by_group(df.withColumn("g", F.col("k") % 10), "g", 0.8)
    assert grouped.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_balanced_pairs(spark, small_groups):
    df = spark.createDataFrame([("a", k, int(k < 3)) for k in range(50)] + [("b", 100 + k, 0) for k in range(9)], "g string, k int, y int")
    got = {tuple(r) for r in splits.balanced_pairs(df, ["g"], "k").groupBy("g", "y").count().collect()}
    assert got == {("a", 1, 3), ("a", 0, 9)}


def msa(spark, *seqs):
    return spark.createDataFrame([("m", k, s) for k, s in enumerate(seqs)], "msa_id string, row_id int, seq string")


def test_profiles(spark):
    m = msa(spark, "AC-D", "AC-D", "GCXD", "--AD")
    assert {(r["col"], r["ch"]): r["freq"] for r in P.profile_freq(m).collect()}[(2, "-")] == 0.75
    assert [r["pos"] for r in P.col2pos(m).orderBy("col").collect()] == [0, 1, None, 2]
    pssm = {(r["pos"], r["ch"]): (r["freq"], r["coverage"]) for r in P.pssm(m, spark.createDataFrame([("m", 4)], "msa_id string, length int")).collect()}
    assert pssm[(0, "A")] == (2 / 3, 0.75) and pssm[(3, None)] == (None, 0.0)
    assert math.isclose(sum(r["weight"] for r in P.henikoff_weights(m).collect()), 1.0)
    assert {r["entropy"] for r in P.profile_entropy(msa(spark, "ACD")).collect()} == {0.0}
    assert P.column_mi(m).count() == 0 and P.column_mi(m, min_depth=2, max_len=3).count() == 0


def test_mutual_information(spark):
    seqs = ["AC", "AC", "DE", "DE", "A-", "DC"]
    table = {("A", "C"): 2, ("D", "E"): 2, ("D", "C"): 1}
    n = sum(table.values())
    want = sum(c / n * math.log(c / n / (sum(v for k, v in table.items() if k[0] == a) / n) / (sum(v for k, v in table.items() if k[1] == b) / n)) for (a, b), c in table.items())
    assert math.isclose(P.column_mi(msa(spark, *seqs), min_depth=2).first()["mi"], want, rel_tol=1e-6)


def test_mutations(spark):
    df = spark.createDataFrame([("MKTA", "M1A,M1C"), ("MKTA", "K0A, K9R,T3*,xx,K2"), ("MKTA", "")], "s string, m string")
    assert [r[0] for r in df.select(V.apply_mutations("s", "m")).collect()] == ["CKTA", "MKTA", "MKTA"]
    wt = spark.createDataFrame([("q", "MKT"), ("w", "AA")], "query_id string, seq string")
    muts = spark.createDataFrame([("q", 2, "R"), ("q", 9, "R"), ("q", 0, "R")], "query_id string, position int, new_aa string")
    got = rows(V.mutate_table(wt, muts).na.fill("-").na.fill(-1))
    assert got == [("q", 0, "-", "Position 0 is out of range for sequence length 3"), ("q", 2, "MRT", "-"), ("q", 9, "-", "Position 9 is out of range for sequence length 3"), ("w", -1, "AA", "-")]
    ranked = spark.createDataFrame([("q", 0, 1)], "query_id string, ord int, pos int")
    assert [r["mut_seq"] for r in V.point_mutants(wt, ranked, 3).orderBy("mut_aa").collect()] == ["MAT", "MCT", "MDT"]
    assert V.scan_space(wt.withColumnRenamed("query_id", "graph_id")).count() == 5 * 19


def test_rewards(spark):
    scan = spark.createDataFrame([("g", 0, "A", "C"), ("g", 0, "A", "D")], "graph_id string, pos int, wt string, mut string")
    s = spark.createDataFrame([("g", 0, "C", 1.0, -2.0), ("g", 0, "D", 1.0, 2.0)], "graph_id string, pos int, mut string, A_hat double, ddG_hat double")
    got = V.scan_rewards(scan, s, spark.createDataFrame([("g", 0.5)], "graph_id string, A0 double")).collect()
    assert [(r["mut"], round(r["reward"], 6)) for r in got] == [("C", 0.45), ("D", -0.55)]


def test_unique_names(spark, small_groups):
    df = spark.createDataFrame([(k, n) for k, n in enumerate(["a", "a", "a_2", "a", "b", "a_2"])], "ord int, name string")
    got = [r["unique_name"] for r in T.uniquify_names(df).orderBy("ord").collect()]
    assert got == ["a", "a_3", "a_2", "a_4", "b", "a_2_2"] and len(set(got)) == 6


def test_top_hits_nulls_last(spark):
    h = spark.createDataFrame([("q", "s1", 0, None, 9.0), ("q", "s2", 1, 0.1, None), ("q", "s2", 2, 0.1, 5.0), ("q", "s3", 3, 0.0, None)], "query string, subject string, ord int, evalue double, bits double")
    assert [(r["subject"], r["ord"]) for r in T.top_hits(h).orderBy("rank").collect()] == [("s3", 3), ("s2", 2), ("s1", 0)]


def test_casts(spark):
    df = spark.createDataFrame([("3.7", 1), ("null", 2), ("x", 3), ("", 4)], "v string, k int")
    assert [(r["v"], r["v_raw"]) for r in C.tolerant_cast(df, {"v": "int"}).orderBy("k").collect()] == [(3, None), (None, None), (None, "x"), (None, None)]
    with pytest.raises(Exception, match="is not a number"):
        C.strict_cast(df, {"v": "double"}).collect()


def test_concat_modes(spark):
    left = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [2.0]), ("b", 0, [3.0])], "id string, idx int, vec array<double>")
    right = spark.createDataFrame([("a", 0, [9.0])], left.schema)
    pad = {(r["id"], r["idx"]): r["vec"] for r in cleaning.concat_features(left, right, "pad", 1).collect()}
    assert pad == {("a", 0): [1.0, 9.0], ("a", 1): [2.0, 0.0], ("b", 0): [3.0]}
    assert cleaning.concat_features(left, right, "crop").count() == 2
    with pytest.raises(Exception, match="length mismatch"):
        cleaning.concat_features(left, right, "strict", 1).collect()


def test_cached_inference_runs_once_per_text(spark):
    df = spark.createDataFrame([(1, "MK"), (2, "MK"), (3, "TTT")], "k int, seq string")
    cache = spark.createDataFrame([], "key string, result double")
    out, fresh = learning.infer_cached(df, cache, "seq", lambda s: s.str.len().astype(float))
    assert fresh.count() == 2 and rows(out, "k", "result") == [(1, 2.0), (2, 2.0), (3, 3.0)]
    _, none = learning.infer_cached(df, fresh, "seq", lambda s: s.str.len().astype(float))
    assert none.count() == 0
