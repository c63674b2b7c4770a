"""Mutants and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from protspark.operators import variants as V
from protspark.plans.registry import query, r6, table
from protspark.plans.stand_ins import SEQUENCES_SQL, sequences
from protspark.schemas import AMINO_ACIDS

AA_LIST = "[" + ", ".join(f"'{a}'" for a in AMINO_ACIDS) + "]"
MUTATED = "substr(seq, 1, CAST({p} AS INT)) || {a} || substr(seq, CAST({p} AS INT) + 2)"


@query("var01_point_mutants", f"""
    WITH {SEQUENCES_SQL}, r AS (SELECT query_id, seq, unnest([length(seq) - 1, length(seq) // 2, 0]) AS pos, unnest([0, 1, 2]) AS ord FROM seqs),
    m AS (SELECT *, substr(seq, CAST(pos AS INT) + 1, 1) AS wt_aa FROM r), x AS (SELECT *, unnest(list_filter({AA_LIST}, lambda a: a <> wt_aa)[1:5]) AS mut_aa FROM m)
    SELECT query_id, CAST(ord AS INT) AS ord, CAST(pos AS INT) AS pos, mut_aa, wt_aa, {MUTATED.format(p='pos', a='mut_aa')} AS mut_seq FROM x""")
def point_mutants(spark, sf):
    s = sequences(spark, sf)
    spots = F.array(F.length("seq") - 1, F.floor(F.length("seq") / 2).cast("int"), F.lit(0))
    return V.point_mutants(s, s.select("query_id", F.posexplode(spots).alias("ord", "pos")), 5)


@query("var02_apply_mutations", f"""
    WITH {SEQUENCES_SQL}, a AS (SELECT query_id, 'W' || substr(seq, 2) AS seq FROM seqs), b AS (SELECT query_id, substr(seq, 1, 4) || 'K' || substr(seq, 6) AS seq FROM a),
    c AS (SELECT query_id, CASE WHEN query_id % 100 BETWEEN 1 AND length(seq) THEN substr(seq, 1, CAST(query_id % 100 AS INT) - 1) || 'Y' || substr(seq, CAST(query_id % 100 AS INT) + 1) ELSE seq END AS seq FROM b)
    SELECT query_id, seq FROM c""")
def apply_mutations(spark, sf):
    spec = F.concat(F.lit("A1C, A1W,bad,X5*,A0G,Q5K,A9999C,"), F.format_string("A%dY", F.pmod("query_id", F.lit(100))))
    return sequences(spark, sf).select("query_id", V.apply_mutations("seq", spec).alias("seq"))


@query("var03_mutate_table", f"""
    WITH {SEQUENCES_SQL}, m AS (SELECT l_suppkey AS query_id, l_linenumber * 12 AS position, upper(l_returnflag) AS new_aa FROM lineitem)
    SELECT query_id, position, CASE WHEN position IS NULL THEN seq WHEN position <= length(seq) THEN {MUTATED.format(p='(position - 1)', a='new_aa')} END AS sequence,
        CASE WHEN position > length(seq) THEN 'Position ' || position || ' is out of range for sequence length ' || length(seq) END AS error FROM seqs LEFT JOIN m USING (query_id)""")
def mutate_table(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_linenumber") * 12).alias("position"), F.col("l_returnflag").alias("new_aa"))
    return V.mutate_table(sequences(spark, sf), li)


SCAN_SQL = SEQUENCES_SQL + f""", chars AS (SELECT query_id AS graph_id, seq, unnest(range(0, length(seq))) AS pos FROM seqs), wt AS (SELECT *, substr(seq, CAST(pos AS INT) + 1, 1) AS wt FROM chars),
    scan AS (SELECT *, unnest(list_filter({AA_LIST}, lambda a: a <> wt)) AS mut FROM wt)"""


@query("var04_scan_space", f"WITH {SCAN_SQL} SELECT graph_id, CAST(pos AS INT) AS pos, wt, count(DISTINCT mut) AS muts, min(md5(seq || {MUTATED.format(p='pos', a='mut')})) AS lo, max(md5(seq || {MUTATED.format(p='pos', a='mut')})) AS hi FROM scan GROUP BY 1, 2, 3")
def scan_space(spark, sf):
    """All variants, summed up per position: their number and the range of their digests."""
    s = sequences(spark, sf).withColumnRenamed("query_id", "graph_id")
    v = V.scan_space(s).withColumn("digest", F.md5(F.concat("seq_before", "seq_after").cast("binary")))
    return v.groupBy("graph_id", "pos", "wt").agg(F.count_distinct("mut").alias("muts"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))


@query("var05_scan_rewards", f"""
    WITH {SCAN_SQL}, s AS (SELECT graph_id, pos, mut, (pos * 7 + ascii(mut)) % 11 / 10.0::DOUBLE AS a, (pos * 3 + ascii(mut)) % 7 / 10.0::DOUBLE - 0.3 AS d FROM scan)
    SELECT graph_id, CAST(pos AS INT) AS pos, round(sum(a - 0.5), 6) + 0.0 AS "delta_A", round(sum(greatest(0.0, d)), 6) + 0.0 AS stability_penalty, round(max(a - 0.5 - 0.5 * greatest(0.0, d) - 0.05), 6) + 0.0 AS reward FROM s GROUP BY 1, 2""")
def scan_rewards(spark, sf):
    seqs = sequences(spark, sf).withColumnRenamed("query_id", "graph_id")
    scan = V.scan_space(seqs, with_sequences=False)
    scores = scan.select("graph_id", "pos", "mut", (F.pmod(F.col("pos") * 7 + F.ascii("mut"), F.lit(11)) / 10).alias("A_hat"), (F.pmod(F.col("pos") * 3 + F.ascii("mut"), F.lit(7)) / 10 - 0.3).alias("ddG_hat"))
    out = V.scan_rewards(scan, scores, seqs.select("graph_id", F.lit(0.5).alias("A0")))
    sums = out.groupBy("graph_id", "pos").agg(F.sum("delta_A").alias("delta_A"), F.sum("stability_penalty").alias("stability_penalty"), F.max("reward").alias("reward"))
    return sums.select("graph_id", "pos", *[r6(c).alias(c) for c in ("delta_A", "stability_penalty", "reward")])


@query("var06_score_variants", "SELECT event_id, round(1 / (1 + exp(-(value / 50 - 1))), 4) AS predicted_score FROM events")
def score_variants(spark, sf):
    return V.score_variants(table(spark, sf, "events"), F.col("value") / 50 - 1).select("event_id", "predicted_score")


@query("var07_prediction_summary", """
    SELECT conv_id, CAST(max(length(text)) AS INT) AS wt_length, count(*) AS num_mutants, string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY turn) AS predictions FROM conversations GROUP BY 1""")
def prediction_summary(spark, sf):
    c = table(spark, sf, "conversations").withColumn("score", F.length("text"))
    s = V.prediction_summary(c, "conv_id", "text", "score", "turn")
    return s.withColumn("predictions", F.array_join(F.col("predictions").cast("array<string>"), ","))
