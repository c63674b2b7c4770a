"""Drift of event values between the first and the second half of the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from protspark.operators import drift as D
from protspark.plans.registry import query, r6, table

EDGES = [0.0, 10.0, 25.0, 50.0, 75.0, 100.0, 200.0]
LENGTHS = [0.0, 100.0, 500.0, 1000.0, 5000.0, 50000.0]
HALF_TS = "2024-01-16"


def bin_sql(v: str, edges: list[float]) -> str:
    parts = [f"WHEN {v} = {edges[-1]} THEN {len(edges) - 2}"] + [f"WHEN {v} >= {edges[k]} AND {v} < {edges[k + 1]} THEN {k}" for k in range(len(edges) - 1)]
    return "CASE " + " ".join(parts) + " END"


def halves(spark, sf):
    e = table(spark, sf, "events")
    return e.where(F.col("ts") < F.lit(HALF_TS).cast("timestamp_ntz")), e.where(F.col("ts") >= F.lit(HALF_TS).cast("timestamp_ntz"))


QUANTILES = ", ".join(str(k / 10) for k in range(11))


@query("drf01_quantile_edges", f"""
    SELECT CAST(k - 1 AS INT) AS k, round(q[k], 6) + 0.0 AS edge FROM (SELECT q, unnest(range(1, len(q) + 1)) AS k FROM (SELECT list_sort(list_distinct(quantile_cont(value, [{QUANTILES}]))) AS q FROM events))""")
def quantile_edges(spark, sf):
    edges = D.quantile_edges(table(spark, sf, "events"), "value", 10)
    # Eleven numbers at most.
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(e) for e in edges])).alias("k", "edge")).withColumn("edge", r6("edge"))


HIST = f"""spine AS (SELECT unnest(range(0, {len(EDGES) - 1})) AS bin), c AS (SELECT event_type, {bin_sql('value', EDGES)} AS bin, count(*) AS n FROM events GROUP BY 1, 2),
    t AS (SELECT event_type, sum(n) FILTER (bin IS NOT NULL) AS t FROM c GROUP BY 1)"""


@query("drf02_hist_props", f"""
    WITH {HIST} SELECT t.event_type, CAST(s.bin AS INT) AS bin, round(coalesce(n, 0) / t, 6) + 0.0 AS p FROM t CROSS JOIN spine s LEFT JOIN c ON c.event_type = t.event_type AND c.bin = s.bin""")
def hist_props(spark, sf):
    return D.hist_props(table(spark, sf, "events"), "value", EDGES, ["event_type"]).withColumn("p", r6("p"))


def psi_sql(eps: float, by: str = "") -> str:
    sel, on = (f"{by}, ", f"AND a.{by} = b.{by}") if by else ("", "")
    return f"""spine AS (SELECT {sel}unnest(range(0, {len(EDGES) - 1})) AS bin FROM (SELECT DISTINCT {by or '1 AS one'} FROM events)),
    half AS (SELECT {sel}ts < TIMESTAMP '{HALF_TS}' AS base, {bin_sql('value', EDGES)} AS bin, count(*) AS n FROM events GROUP BY ALL),
    prop AS (SELECT *, n / sum(n) OVER (PARTITION BY {sel}base) AS p FROM half WHERE bin IS NOT NULL),
    both_ AS (SELECT s.*, least(greatest(coalesce(a.p, 0), {eps}), 1.0) AS p, least(greatest(coalesce(b.p, 0), {eps}), 1.0) AS q FROM spine s LEFT JOIN prop a ON a.bin = s.bin AND a.base {'AND a.' + by + ' = s.' + by if by else ''}
        LEFT JOIN prop b ON b.bin = s.bin AND NOT b.base {'AND b.' + by + ' = s.' + by if by else ''}),
    psi AS (SELECT {sel}sum((p - q) * ln(p / q)) AS psi FROM both_ {'GROUP BY ' + by if by else ''})"""


@query("drf03_psi", f"WITH {psi_sql(1e-12, 'event_type')} SELECT event_type, round(psi, 6) + 0.0 AS psi FROM psi")
def psi(spark, sf):
    base, cur = (D.hist_props(h, "value", EDGES, ["event_type"]) for h in halves(spark, sf))
    return D.psi(base, cur, ["event_type"]).withColumn("psi", r6("psi"))


@query("drf04_psi_verdict", """
    SELECT c_custkey, CASE WHEN v < 0.1 THEN 'stable' WHEN v < 0.25 THEN 'slight_shift' WHEN v < 0.5 THEN 'moderate_shift' ELSE 'major_shift' END AS four,
        CASE WHEN v <= 0.1 THEN 'stable' WHEN v <= 0.25 THEN 'watch' ELSE 'drift' END AS watch, CASE WHEN v < 0.1 THEN 'no drift' WHEN v < 0.25 THEN 'monitor' ELSE 'investigate' END AS report
    FROM (SELECT c_custkey, abs(c_acctbal) / 10000 AS v FROM customer)""")
def psi_verdict(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.abs("c_acctbal") / 10000).alias("v"))
    return c.select("c_custkey", *[D.psi_verdict("v", s).alias(s) for s in ("four", "watch", "report")])


def baseline_sql(metric: str, src: str, v: str, edges: list[float]) -> str:
    los = "[" + ", ".join(map(str, edges)) + "]"
    return f"""SELECT '{metric}' AS metric, CAST(s.bin AS INT) AS bin, CAST({los}[s.bin + 1] AS DOUBLE) AS lo, CAST({los}[s.bin + 2] AS DOUBLE) AS hi, round(coalesce(n, 0) / (SELECT count({bin_sql(v, edges)}) FROM {src}), 6) + 0.0 AS p
        FROM (SELECT unnest(range(0, {len(edges) - 1})) AS bin) s LEFT JOIN (SELECT {bin_sql(v, edges)} AS bin, count(*) AS n FROM {src} GROUP BY 1) c ON c.bin = s.bin"""


@query("drf05_build_baseline", baseline_sql("score", "events", "value", EDGES) + " UNION ALL " + baseline_sql("length", "documents", "n_chars", LENGTHS))
def build_baseline(spark, sf):
    b = D.build_baseline({"score": (table(spark, sf, "events"), "value", EDGES), "length": (table(spark, sf, "documents"), "n_chars", LENGTHS)})
    return b.withColumn("p", r6("p"))


@query("drf06_psi_report", f"WITH {psi_sql(1e-6)} SELECT 'score' AS metric, round(psi, 6) + 0.0 AS psi, CASE WHEN psi < 0.1 THEN 'no drift' WHEN psi < 0.25 THEN 'monitor' ELSE 'investigate' END AS verdict FROM psi")
def psi_report(spark, sf):
    base, cur = (D.build_baseline({"score": (h, "value", EDGES)}) for h in halves(spark, sf))
    return D.psi_report(base, cur).withColumn("psi", r6("psi"))


@query("drf07_embedding_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 6) + 0.0 AS norm FROM embeddings")
def embedding_norms(spark, sf):
    return D.embedding_norms(table(spark, sf, "embeddings"), "embedding").select("vec_id", r6("norm").alias("norm"))


@query("drf07_sequence_lengths", "SELECT l_orderkey, count(*) AS length FROM lineitem GROUP BY 1")
def sequence_lengths(spark, sf):
    return D.sequence_lengths(table(spark, sf, "lineitem"), ["l_orderkey"])


@query("drf08_monitor_scores", f"""
    WITH {psi_sql(1e-6)} SELECT round(psi, 6) + 0.0 AS psi, CASE WHEN psi <= 0.1 THEN 'stable' WHEN psi <= 0.25 THEN 'watch' ELSE 'drift' END AS verdict FROM psi""")
def monitor_scores(spark, sf):
    first, second = halves(spark, sf)
    baseline = D.build_baseline({"score": (first, "value", EDGES)})
    return D.monitor_scores(second, "value", baseline).withColumn("psi", r6("psi"))
