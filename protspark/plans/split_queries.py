"""Splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from protspark.operators import splits as S
from protspark.plans.registry import query, r6, table


def hash_sql(key: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || {key})"


def placed_sql(src: str, key: str) -> str:
    return f"p AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(key)}, {key}) AS n, count(*) OVER () AS total FROM {src})"


@query("smp01_split_exact", f"WITH {placed_sql('documents', 'doc_id')} SELECT doc_id, CASE WHEN n <= greatest(1, round_even(0.2 * total, 0)) THEN 'val' ELSE 'train' END AS split FROM p")
def split_exact(spark, sf):
    return S.split_exact(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.2)


@query("smp02_split_fraction", f"WITH {placed_sql('orders', 'o_orderkey')} SELECT o_orderkey, CASE WHEN n <= greatest(1, floor(0.8 * total)) THEN 'train' ELSE 'val' END AS split FROM p")
def split_fraction(spark, sf):
    return S.split_fraction(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.8)


@query("smp03_split_three", f"WITH {placed_sql('events', 'event_id')} SELECT event_id, CASE WHEN n <= floor(0.7 * total) THEN 'train' WHEN n <= floor(0.85 * total) THEN 'val' ELSE 'test' END AS split FROM p")
def split_three(spark, sf):
    return S.split_three(table(spark, sf, "events").select("event_id"), "event_id")


@query("smp03_split_by_group", f"""
    WITH g AS (SELECT DISTINCT l_orderkey FROM lineitem), {placed_sql('g', 'l_orderkey')} SELECT l_orderkey, l_partkey, CASE WHEN n <= greatest(1, floor(0.8 * total)) THEN 'train' ELSE 'val' END AS split FROM lineitem JOIN p USING (l_orderkey)""")
def split_by_group(spark, sf):
    return S.split_by_group(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", 0.8)


@query("smp04_predefined_split", """
    SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'test' WHEN l_linestatus = 'O' AND l_discount > 0.02 THEN 'valid' ELSE 'train' END AS split FROM lineitem WHERE l_returnflag IN ('A', 'N')""")
def predefined_split(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "A", "test").when(F.col("l_returnflag") == "N", "train").otherwise("other").alias("set"),
                                             F.when(F.col("l_discount") > 0.02, F.col("l_linestatus") == "O").alias("validation"))
    return S.predefined_split(li).select("l_orderkey", "l_partkey", "split")


LINE_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT))"


@query("smp05_balanced_pairs", f"""
    WITH s AS (SELECT l_suppkey AS g, CASE WHEN l_returnflag = 'R' AND l_discount > 0.08 THEN 1 ELSE 0 END AS y, {LINE_KEY} AS k FROM lineitem), c AS (SELECT g, least(sum(y), 40) AS np FROM s GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY g, y ORDER BY {hash_sql('k')}, k) AS n FROM s), q AS (SELECT r.* FROM r JOIN c USING (g) WHERE n <= CASE WHEN y = 1 THEN np ELSE np * 3 END),
    z AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {hash_sql('k')}, k) AS m FROM q) SELECT g, y, k FROM z WHERE m <= 100""")
def balanced_pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    s = li.select(F.col("l_suppkey").alias("g"), ((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08)).cast("int").alias("y"), key.alias("k"))
    return S.balanced_pairs(s, ["g"], "k", "y", ratio=3, max_pos=40, max_pairs=100)


@query("smp06_sample_cap", f"SELECT o_orderkey FROM orders ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT 500")
def sample_cap(spark, sf):
    return S.sample_cap(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("smp06_sample_frac", f"SELECT event_id FROM events WHERE substr({hash_sql('event_id')}, 1, 8) < '{int(0.25 * 16 ** 8):08x}'")
def sample_frac(spark, sf):
    return S.sample_frac(table(spark, sf, "events").select("event_id"), "event_id", 0.25)


@query("smp07_kfold", f"WITH {placed_sql('events', 'event_id')} SELECT event_id, CAST((n - 1) % 5 AS INT) AS fold FROM p")
def kfold(spark, sf):
    return S.kfold(table(spark, sf, "events").select("event_id"), "event_id")


@query("smp07_fold_means", f"WITH {placed_sql('events', 'event_id')}, f AS (SELECT (n - 1) % 5 AS fold, avg(value) AS m FROM p GROUP BY 1) SELECT round(avg(m), 6) + 0.0 AS mean_metric, count(*) AS folds FROM f")
def fold_means(spark, sf):
    folds = S.kfold(table(spark, sf, "events").select("event_id", "value"), "event_id")
    return S.fold_means(folds, F.avg("value")).withColumn("mean_metric", r6("mean_metric"))


@query("smp08_drop_malformed", """
    SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'missing quality' WHEN length(text) <> n_chars + toxic THEN 'length mismatch' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)""")
def drop_malformed(spark, sf):
    from protspark.operators.cleaning import drop_malformed as mark

    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    joined = d.join(lab, "doc_id", "left")
    return mark(joined, ["text", "quality"], (F.length("text"), F.col("n_chars") + F.col("toxic"))).select("doc_id", "reason")
