"""Distributed ranks, running totals, quantiles and salted joins against plain windows and joins."""

import random

import numpy as np
from pyspark.sql import functions as F

from support import rows
from protspark.functions import ordered, skew


def skewed(spark, n=300):
    rnd = random.Random(3)
    data = [(k, "hot" if rnd.random() < 0.5 else f"g{rnd.randrange(40)}", rnd.randrange(20)) for k in range(n)]
    return data, spark.createDataFrame(data, "k long, g string, v int").repartition(7)


def test_ranked_hot_groups(spark, small_groups):
    data, df = skewed(spark)
    want = {}
    for g in {d[1] for d in data}:
        for rn, d in enumerate(sorted((d for d in data if d[1] == g), key=lambda d: (-d[2], d[0])), 1):
            want[d[0]] = rn
    got = {r["k"]: r["rn"] for r in ordered.ranked(df, ["g"], [F.desc("v"), F.col("k")]).collect()}
    assert got == want


def test_ranked_without_groups(spark):
    data, df = skewed(spark)
    got = {r["k"]: r["rn"] for r in ordered.ranked(df, [], [F.col("v"), F.col("k")]).collect()}
    assert got == {d[0]: n for n, d in enumerate(sorted(data, key=lambda d: (d[2], d[0])), 1)}


def test_ranked_null_group(spark, small_groups):
    df = spark.createDataFrame([(k, None if k < 9 else "a") for k in range(12)], "k long, g string")
    assert rows(ordered.ranked(df, ["g"], [F.col("k")]).where("g is null"), "k", "rn") == [(k, k + 1) for k in range(9)]


def test_running_totals(spark, small_groups):
    data, df = skewed(spark)
    got = {r["k"]: (r["s"], r["c"]) for r in ordered.running_totals(df, ["g"], [F.col("k")], {"s": F.col("v"), "c": F.lit(1)}).collect()}
    seen = {}
    for k, g, v in sorted(data):
        s, c = seen.get(g, (0, 0))
        seen[g] = (s + v, c + 1)
        assert got[k] == seen[g]


def test_exact_quantiles(spark, small_groups):
    data, df = skewed(spark)
    qs = [0.0, 0.1, 0.5, 0.95, 1.0]
    for r in ordered.exact_quantiles(df, ["g"], "v", qs).collect():
        want = np.quantile([d[2] for d in data if d[1] == r["g"]], qs)
        assert np.allclose([r[f"q{k}"] for k in range(5)], want)


def test_value_ranks_average_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    assert rows(ordered.value_ranks(df, [], "v"), "v", "avg_rank") == [(1.0, 1.0), (2.0, 2.5), (5.0, 4.0)]


def test_salted_join_equals_join(spark):
    _, df = skewed(spark)
    right = df.select("g", F.col("k").alias("k2")).where("k2 < 60")
    plain = df.join(right, "g")
    assert rows(skew.salted_join(df, right, ["g"], rows_per_task=10), "k", "k2") == rows(plain, "k", "k2")


def test_pair_join_blocks(spark):
    df = spark.createDataFrame([("m", k, float(k)) for k in range(3, 30)], "m string, p long, x double")
    got = skew.pair_join(df, ["m"], "p", ["x"], block=4)
    assert rows(got, "p_i", "p_j") == [(a, b) for a in range(3, 30) for b in range(a + 1, 30)]
