"""Evaluation metrics on line scores and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from protspark.operators import evaluation as E
from protspark.operators.drift import separations
from protspark.operators.geometry import contacts, long_range
from protspark.plans.registry import query, r6, table
from protspark.plans.stand_ins import PAIRS_SQL, points


def scored(spark, sf):
    """Lines: price as score, returned as label, supplier as example."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") * 10).alias("prob"), (F.col("l_discount") * 20 - 1).alias("logit"), (F.col("l_linestatus") == "O").cast("int").alias("m"), "l_orderkey", "l_partkey", "l_linenumber", "l_tax", "l_discount", "l_quantity")


S = """s AS (SELECT l_suppkey AS g, l_extendedprice AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount * 10 AS prob, l_discount * 20 - 1 AS logit,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS m, l_orderkey, l_partkey, l_linenumber, l_tax, l_discount, l_quantity FROM lineitem)"""


def auc_sql(by: str = "", score: str = "score") -> str:
    part = f"PARTITION BY {by} " if by else ""
    sel, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""WITH {S}, r AS (SELECT {sel}y, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {sel}{score}) - 1) / 2.0 AS rk FROM s)
    SELECT {sel}round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)), 6) + 0.0 AS auc FROM r {grp}"""


@query("evl01_roc_auc", auc_sql())
def roc_auc(spark, sf):
    return E.roc_auc(scored(spark, sf), "score", "y").select(r6("auc").alias("auc"))


@query("evl01_roc_auc_by_example", auc_sql("g", "prob"))
def roc_auc_by(spark, sf):
    return E.roc_auc(scored(spark, sf), "prob", "y", ["g"]).withColumn("auc", r6("auc"))


def ap_sql(by: str = "", score: str = "score") -> str:
    part = f"PARTITION BY {by} " if by else ""
    sel, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    keys = f"{by}, {score}" if by else score
    return f"""WITH {S}, c AS (SELECT {sel}{score} AS sc, sum(y) AS pos, count(*) AS n FROM s GROUP BY {keys}),
    w AS (SELECT *, sum(pos) OVER ({part}ORDER BY sc DESC) AS tp, sum(n) OVER ({part}ORDER BY sc DESC) AS seen FROM c)
    SELECT {sel}round(sum(pos * tp / seen) / sum(pos), 6) + 0.0 AS ap FROM w {grp}"""


@query("evl02_average_precision", ap_sql())
def average_precision(spark, sf):
    return E.average_precision(scored(spark, sf), "score", "y").select(r6("ap").alias("ap"))


@query("evl02_average_precision_by_example", ap_sql("g", "prob"))
def average_precision_by(spark, sf):
    return E.average_precision(scored(spark, sf), "prob", "y", ["g"]).withColumn("ap", r6("ap"))


def f1_sql(t: str) -> str:
    tp, fp, fn = (f"count(*) FILTER (prob >= {t} AND y = 1)", f"count(*) FILTER (prob >= {t} AND y = 0)", f"count(*) FILTER (prob < {t} AND y = 1)")
    p, r = f"({tp} / greatest({tp} + {fp}, 1))", f"({tp} / greatest({tp} + {fn}, 1))"
    return f"2 * {p} * {r} / greatest({p} + {r}, 1e-8)"


@query("evl03_f1_at", f"WITH {S} SELECT g, round({f1_sql('0.5')}, 6) + 0.0 AS f1 FROM s GROUP BY 1")
def f1_at(spark, sf):
    return E.f1_at(scored(spark, sf), "prob", "y", 0.5, ["g"]).withColumn("f1", r6("f1"))


@query("evl04_best_f1", f"WITH {S}, f AS (" + " UNION ALL ".join(f"SELECT g, {t} AS tau, {f1_sql(str(t))} AS f1 FROM s GROUP BY g" for t in E.TAUS) + """),
    b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY f1 DESC, tau) AS rn FROM f)
    SELECT g, round(f1, 6) + 0.0 AS best_f1, CAST(CASE WHEN f1 > 0 THEN tau ELSE 0.5 END AS DOUBLE) AS tau FROM b WHERE rn = 1""")
def best_f1(spark, sf):
    return E.best_f1(scored(spark, sf), "prob", "y", ["g"]).withColumn("best_f1", r6("best_f1"))


def precision_sql(k: str) -> str:
    return f"""WITH {S}, n AS (SELECT g, count(*) AS n, max(l_linenumber) * 10 AS len FROM s GROUP BY 1), kk AS (SELECT g, CAST(least(greatest({k}, 1), n) AS BIGINT) AS k FROM n),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, l_orderkey, l_partkey, l_linenumber) AS rn FROM s)
    SELECT r.g, k, round(avg(y), 6) + 0.0 AS precision FROM r JOIN kk ON kk.g = r.g WHERE rn <= k GROUP BY 1, 2"""


TIE = ["l_orderkey", "l_partkey", "l_linenumber"]


@query("evl05_precision_length", precision_sql("len"))
def precision_length(spark, sf):
    s = scored(spark, sf).withColumn("len", F.col("l_linenumber") * 10)
    return E.precision_at(s, "score", "y", ["g"], TIE, "length", length="len").withColumn("precision", r6("precision"))


@query("evl05_precision_sqrt", precision_sql("round_even(sqrt(n * 2.0), 0)"))
def precision_sqrt(spark, sf):
    return E.precision_at(scored(spark, sf), "score", "y", ["g"], TIE, "sqrt").withColumn("precision", r6("precision"))


@query("evl05_precision_frac", precision_sql("floor(0.2 * floor((1 + sqrt(1 + 8.0 * n)) / 2))"))
def precision_frac(spark, sf):
    return E.precision_at(scored(spark, sf), "score", "y", ["g"], TIE, "frac", frac=0.2).withColumn("precision", r6("precision"))


@query("evl06_long_range", f"WITH {PAIRS_SQL} SELECT model_id, i, j, j - i AS sep FROM pairs WHERE dist <= 0.1 AND j - i >= 6")
def long_range_pairs(spark, sf):
    far = long_range(contacts(points(spark, sf), 0.1), 6).withColumn("y", F.lit(1))
    return separations(far).select("model_id", "i", "j", "sep")


@query("evl07_masked_bce", f"WITH {S} SELECT g, round(sum((greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit)))) * m) / greatest(sum(m), 1), 6) + 0.0 AS loss FROM s GROUP BY 1")
def masked_bce(spark, sf):
    return E.masked_bce(scored(spark, sf), "logit", "y", "m", ["g"]).withColumn("loss", r6("loss"))


@query("evl08_regression_metrics", f"""
    WITH {S} SELECT g, round(avg((l_tax - l_discount) ** 2), 6) + 0.0 AS mse, round(sqrt(avg((l_tax - l_discount) ** 2)), 6) + 0.0 AS rmse, round(avg(abs(l_tax - l_discount)), 6) + 0.0 AS mae,
        round(1 - sum((l_tax - l_discount) ** 2) / (var_pop(l_tax) * count(*) + 1e-12), 6) + 0.0 AS r2, count(*) AS n FROM s GROUP BY 1""")
def regression_metrics(spark, sf):
    m = E.regression_metrics(scored(spark, sf), "l_tax", "l_discount", ["g"])
    return m.select("g", *[r6(c).alias(c) for c in ("mse", "rmse", "mae", "r2")], "n")


@query("evl09_combined_metrics", f"""
    WITH {S} SELECT round(avg((l_tax ** 2 + l_discount ** 2) / 2), 6) + 0.0 AS mse, round(sqrt(avg((l_tax ** 2 + l_discount ** 2) / 2)), 6) + 0.0 AS rmse, round(avg((l_tax + l_discount) / 2), 6) + 0.0 AS mae, count(*) AS n FROM s""")
def combined_metrics(spark, sf):
    return E.combined_metrics(scored(spark, sf), "l_tax", "l_discount").select(*[r6(c).alias(c) for c in ("mse", "rmse", "mae")], "n")


@query("evl10_safe_pearson", "SELECT event_type, round(corr(value, user_id), 6) + 0.0 AS pearson FROM events GROUP BY 1")
def safe_pearson(spark, sf):
    return E.safe_pearson(table(spark, sf, "events"), "value", "user_id", ["event_type"]).withColumn("pearson", r6("pearson"))


@query("evl11_spearman_average", """
    WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a,
        rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b FROM events)
    SELECT event_type, round(corr(a, b), 6) + 0.0 AS spearman FROM r GROUP BY 1""")
def spearman_average(spark, sf):
    return E.spearman(table(spark, sf, "events"), "value", "user_id", ["event_type"]).withColumn("spearman", r6("spearman"))


@query("evl11_spearman_ordinal", """
    WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS b FROM orders) SELECT round(corr(a, b), 6) + 0.0 AS spearman FROM r""")
def spearman_ordinal(spark, sf):
    return E.spearman(table(spark, sf, "orders"), "o_totalprice", "o_custkey", ties="ordinal", ord_col="o_orderkey").select(r6("spearman").alias("spearman"))


@query("evl12_sign_agreement", """
    SELECT user_id, round(coalesce(avg(CASE WHEN abs(value - 50) > 5 AND abs(k - 50) > 5 THEN CASE WHEN sign(value - 50) = sign(k - 50) THEN 1.0 ELSE 0.0 END END), 'nan'::DOUBLE), 6) + 0.0 AS sign_agreement
    FROM (SELECT user_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events) GROUP BY 1""")
def sign_agreement(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("value") - 50).alias("a"), (F.get_json_object("props", "$.k").cast("double") - 50).alias("b"))
    return E.sign_agreement(e, "a", "b", 5.0, ["user_id"]).withColumn("sign_agreement", r6("sign_agreement"))


@query("evl13_binary_report", """
    WITH t AS (SELECT c_nationkey AS g, c_acctbal < 0 AS t, c_custkey - 300 < 0 AS p FROM customer), n AS (SELECT g, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM t GROUP BY 1)
    SELECT g, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) + 0.0 AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) + 0.0 AS recall,
        round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) + 0.0 AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) + 0.0 AS accuracy FROM n""")
def binary_report(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("t"), (F.col("c_custkey") - 300).alias("p"))
    rep = E.binary_report(c, "t", "p", ["g"])
    return rep.select("g", "tp", "fp", "fn", "tn", *[r6(x).alias(x) for x in ("precision", "recall", "f1", "accuracy")])


def _rollup_part(by: str) -> str:
    """AUC and AP of one grouping."""
    g = "g" if by else "NULL::BIGINT"
    grp = "GROUP BY g" if by else ""
    part = "PARTITION BY g " if by else ""
    return f"""SELECT {g} AS g, count(*) AS n, sum(y) AS positives, round({f1_sql('0.5')}, 6) + 0.0 AS f1,
        round((sum(rk{by}) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)), 6) + 0.0 AS auc,
        round(sum(y * tp{by} / seen{by}) / sum(y), 6) + 0.0 AS ap FROM r {grp}"""


@query("evl14_rollup_metrics", f"""
    WITH {S}, r AS (SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS rk, rank() OVER (PARTITION BY g ORDER BY prob) + (count(*) OVER (PARTITION BY g, prob) - 1) / 2.0 AS rk_g,
        sum(y) OVER (ORDER BY prob DESC) AS tp, count(*) OVER (ORDER BY prob DESC) AS seen, sum(y) OVER (PARTITION BY g ORDER BY prob DESC) AS tp_g, count(*) OVER (PARTITION BY g ORDER BY prob DESC) AS seen_g FROM s)
    {_rollup_part('_g')} UNION ALL {_rollup_part('')}""")
def rollup_metrics(spark, sf):
    m = E.rollup_metrics(scored(spark, sf), "prob", "y", "g")
    return m.select("g", "n", "positives", r6("f1").alias("f1"), r6("auc").alias("auc"), r6("ap").alias("ap"))


@query("evl15_sweep_summary", """
    WITH g AS (SELECT user_id, avg(value) AS a, avg(CASE WHEN event_type <> 'error' THEN value END) AS b FROM events GROUP BY 1) SELECT round(avg(a), 6) + 0.0 AS mean_abs, round(avg(b), 6) + 0.0 AS mean_safe, count(*) AS graphs FROM g""")
def sweep_summary(spark, sf):
    e = table(spark, sf, "events").withColumn("safe", F.when(F.col("event_type") == "error", F.lit(float("inf"))).otherwise(F.col("value")))
    return E.sweep_summary(e, "user_id", "value", "safe").select(r6("mean_abs").alias("mean_abs"), r6("mean_safe").alias("mean_safe"), "graphs")


@query("evl16_prediction_report", """
    WITH e AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS estimate FROM lineitem GROUP BY 1) SELECT o_orderkey AS k, o_totalprice AS target, round(estimate, 6) + 0.0 AS estimate, round(estimate - o_totalprice, 6) + 0.0 AS error FROM orders JOIN e ON k = o_orderkey""")
def prediction_report(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    t = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("target"))
    e = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("estimate"))
    return E.prediction_report(t, e, ["k"]).select("k", "target", r6("estimate").alias("estimate"), r6("error").alias("error"))


@query("evl17_describe_target", """
    SELECT event_type, min(value) AS min, max(value) AS max, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std, round(var_pop(value), 6) + 0.0 AS variance, count(*) AS n FROM events GROUP BY 1""")
def describe_target(spark, sf):
    d = E.describe_target(table(spark, sf, "events"), "value", ["event_type"])
    return d.select("event_type", "min", "max", *[r6(c).alias(c) for c in ("mean", "std", "variance")], "n")


@query("evl17_distinct_head", """
    WITH v AS (SELECT event_type, value, count(*) AS n, min(event_id) AS first_at FROM events GROUP BY 1, 2)
    SELECT event_type, value, n, CAST(row_number() OVER (PARTITION BY event_type ORDER BY first_at, value) AS INT) AS place FROM v QUALIFY place <= 10""")
def distinct_head(spark, sf):
    """A report of the first ten distinct values of each type."""
    return E.distinct_head(table(spark, sf, "events"), "value", ["event_type"], 10, "event_id").select("event_type", "value", "n", F.col("place").cast("int").alias("place"))


@query("evl17_mean_identity", "SELECT l_suppkey AS query, round(avg(l_discount), 6) + 0.0 AS mean_identity FROM lineitem GROUP BY 1")
def mean_identity(spark, sf):
    return E.mean_identity(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "query"), ["query"], "l_discount").withColumn("mean_identity", r6("mean_identity"))
