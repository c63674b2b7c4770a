"""Alignment profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from protspark.operators import profiles as P
from protspark.plans.registry import query, r6, table
from protspark.plans.stand_ins import ALIGNED_SQL, LETTERS_SQL, aligned
from protspark.schemas import AMINO_ACIDS

AA_SQL = "(" + ", ".join(f"'{a}'" for a in AMINO_ACIDS) + ")"
DEPTH_SQL = "d AS (SELECT msa_id, count(*) AS depth FROM aln GROUP BY 1)"


@query("msa01_profile_freq", f"""
    WITH {LETTERS_SQL}, {DEPTH_SQL} SELECT msa_id, CAST(col AS INT) AS col, ch, round(count(*) / any_value(depth), 6) + 0.0 AS freq FROM long JOIN d USING (msa_id) GROUP BY 1, 2, 3""")
def profile_freq(spark, sf):
    return P.profile_freq(aligned(spark, sf)).withColumn("freq", r6("freq"))


QUERY_SQL = LETTERS_SQL + """, q AS (SELECT long.* FROM long JOIN (SELECT msa_id, min(row_id) AS row_id FROM aln GROUP BY 1) USING (msa_id, row_id)),
    map AS (SELECT msa_id, col, CASE WHEN ch <> '-' THEN CAST(sum(CASE WHEN ch <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY msa_id ORDER BY col) - 1 AS BIGINT) END AS pos FROM q)"""


@query("msa02_col2pos", f"WITH {QUERY_SQL} SELECT msa_id, CAST(col AS INT) AS col, pos FROM map")
def col2pos(spark, sf):
    return P.col2pos(aligned(spark, sf))


@query("msa03_pssm", f"""
    WITH {QUERY_SQL}, {DEPTH_SQL}, n AS (SELECT msa_id, pos, ch, count(*) AS n FROM long JOIN map USING (msa_id, col) WHERE ch <> '-' AND pos IS NOT NULL GROUP BY 1, 2, 3),
    t AS (SELECT msa_id, pos, sum(n) AS t FROM n GROUP BY 1, 2), spine AS (SELECT msa_id, unnest(range(0, 66)) AS pos FROM d)
    SELECT msa_id, CAST(s.pos AS INT) AS pos, ch, round(n / t, 6) + 0.0 AS freq, round(coalesce(t, 0) / depth, 6) + 0.0 AS coverage
    FROM spine s JOIN d USING (msa_id) LEFT JOIN n USING (msa_id, pos) LEFT JOIN t USING (msa_id, pos)""")
def pssm(spark, sf):
    a = aligned(spark, sf)
    expected = a.select("msa_id").distinct().withColumn("length", F.lit(66))
    return P.pssm(a, expected).select("msa_id", "pos", "ch", r6("freq").alias("freq"), r6("coverage").alias("coverage"))


@query("msa04_profile_entropy", f"""
    WITH {LETTERS_SQL}, {DEPTH_SQL}, n AS (SELECT msa_id, col, ch, count(*) / any_value(depth) AS p FROM long JOIN d USING (msa_id) GROUP BY 1, 2, 3)
    SELECT msa_id, CAST(col AS INT) AS col, round(sum(CASE WHEN ch IN {AA_SQL} THEN -p * ln(p + 1e-12) ELSE 0 END), 6) + 0.0 AS entropy FROM n GROUP BY 1, 2""")
def profile_entropy(spark, sf):
    return P.profile_entropy(aligned(spark, sf)).withColumn("entropy", r6("entropy"))


MI_SQL = LETTERS_SQL + f""", c AS (SELECT x.msa_id, x.col AS a, y.col AS b, x.ch AS ca, y.ch AS cb, count(*) AS n FROM long x JOIN long y ON x.msa_id = y.msa_id AND x.row_id = y.row_id AND x.col < y.col
        WHERE x.ch IN {AA_SQL} AND y.ch IN {AA_SQL} GROUP BY 1, 2, 3, 4, 5),
    p AS (SELECT *, n / (sum(n) OVER (PARTITION BY msa_id, a, b) + 1e-9) AS p FROM c),
    m AS (SELECT *, sum(p) OVER (PARTITION BY msa_id, a, b, ca) AS pa, sum(p) OVER (PARTITION BY msa_id, a, b, cb) AS pb FROM p),
    mi AS (SELECT msa_id, a, b, sum(p * (ln(p + 1e-12) - ln(pa + 1e-12) - ln(pb + 1e-12))) AS mi FROM m GROUP BY 1, 2, 3)"""


@query("msa05_column_mi", f"WITH {MI_SQL} SELECT msa_id, CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(mi, 6) + 0.0 AS mi FROM mi")
def column_mi(spark, sf):
    return P.column_mi(aligned(spark, sf)).withColumn("mi", r6("mi"))


@query("msa05_mi_inputs", f"""
    WITH {ALIGNED_SQL}, u AS (SELECT msa_id * 1000 + row_id % 40 AS msa_id, row_id, seq FROM aln), s AS (SELECT msa_id, count(*) AS depth, CAST(arg_min(length(seq), row_id) AS INT) AS length FROM u GROUP BY 1)
    SELECT *, CASE WHEN depth < 10 THEN 'shallow' END AS reason FROM s""")
def mi_inputs(spark, sf):
    """Smaller alignments, some of them below the least depth."""
    a = aligned(spark, sf).withColumn("msa_id", F.col("msa_id") * 1000 + F.col("row_id") % 40)
    return P.mi_inputs(a)


@query("msa06_apc", f"""
    WITH {MI_SQL}, ends AS (SELECT msa_id, a AS c, mi FROM mi UNION ALL SELECT msa_id, b, mi FROM mi), rm AS (SELECT msa_id, c, sum(mi) / 64 AS m FROM ends GROUP BY 1, 2),
    g AS (SELECT msa_id, sum(mi) / 4096 AS g FROM ends GROUP BY 1)
    SELECT mi.msa_id, CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(mi - x.m * y.m / (g + 1e-9), 6) + 0.0 AS mi_apc FROM mi JOIN rm x ON x.msa_id = mi.msa_id AND x.c = a
    JOIN rm y ON y.msa_id = mi.msa_id AND y.c = b JOIN g ON g.msa_id = mi.msa_id""")
def apc(spark, sf):
    a = aligned(spark, sf)
    lengths = a.groupBy("msa_id").agg(F.max(F.length("seq")).alias("length"))
    return P.apc(P.column_mi(a), lengths).withColumn("mi_apc", r6("mi_apc"))


@query("msa07_henikoff_weights", f"""
    WITH {LETTERS_SQL}, c AS (SELECT msa_id, col, ch, count(*) AS n FROM long GROUP BY 1, 2, 3), t AS (SELECT msa_id, col, count(*) AS t FROM c GROUP BY 1, 2),
    raw AS (SELECT msa_id, row_id, sum(1.0::DOUBLE / (t * n)) AS w FROM long JOIN c USING (msa_id, col, ch) JOIN t USING (msa_id, col) GROUP BY 1, 2)
    SELECT msa_id, row_id, round(w / sum(w) OVER (PARTITION BY msa_id), 6) + 0.0 AS weight FROM raw""")
def henikoff(spark, sf):
    return P.henikoff_weights(aligned(spark, sf)).withColumn("weight", r6("weight"))


@query("msa08_filter_rows", """
    WITH w AS (SELECT lang, arg_min(length(text), doc_id) AS w FROM documents GROUP BY 1) SELECT lang AS msa_id, doc_id AS row_id FROM documents JOIN w USING (lang) WHERE length(text) = w""")
def filter_rows(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("msa_id"), F.col("doc_id").alias("row_id"), F.col("text").alias("seq"))
    return P.filter_rows(d).select("msa_id", "row_id")


@query("msa08_filter_rows_capped", f"""
    WITH {ALIGNED_SQL}, u AS (SELECT msa_id, row_id, replace(seq, 'A', '') AS seq FROM aln), w AS (SELECT msa_id, arg_min(length(seq), row_id) AS w FROM u GROUP BY 1),
    k AS (SELECT u.*, row_number() OVER (PARTITION BY msa_id ORDER BY row_id) AS rn FROM u JOIN w USING (msa_id) WHERE length(seq) = w) SELECT msa_id, row_id, seq FROM k WHERE rn <= 5""")
def filter_rows_capped(spark, sf):
    a = aligned(spark, sf).withColumn("seq", F.regexp_replace("seq", "A", ""))
    return P.filter_rows(a, max_seqs=5).select("msa_id", "row_id", "seq")


@query("msa09_filter_homologs", """
    WITH wt AS (SELECT lang AS query_id, arg_min(text, doc_id) AS seq FROM documents GROUP BY 1),
    h AS (SELECT DISTINCT lang AS query_id, text AS seq FROM documents WHERE 100 * (length(text) - length(replace(text, ' ', ''))) / length(text) < 16 AND length(text) > 100)
    SELECT query_id, 0 AS is_homolog, md5(seq) AS digest FROM wt UNION ALL SELECT query_id, 1, md5(seq) FROM h WHERE NOT EXISTS (SELECT 1 FROM wt WHERE wt.query_id = h.query_id AND wt.seq = h.seq)""")
def filter_homologs(spark, sf):
    d = table(spark, sf, "documents")
    hits = d.select(F.col("lang").alias("query_id"), F.col("text").alias("hseq"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("identity"), F.length("text").alias("align_len"))
    wt = d.groupBy(F.col("lang").alias("query_id")).agg(F.min_by("text", "doc_id").alias("seq"))
    return P.filter_homologs(hits, wt, max_identity=16.0).select("query_id", "is_homolog", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query("msa10_first_available", """
    SELECT doc_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'local' WHEN item_id IS NOT NULL THEN 'remote' ELSE 'none' END AS provider, coalesce(CAST(quality AS BIGINT), length(b.text), 0) AS value
    FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON item_id = doc_id""")
def first_available(spark, sf):
    d, b, lab = table(spark, sf, "documents"), table(spark, sf, "benchmark"), table(spark, sf, "labels")
    value = lambda c: c.cast("long").alias("value")
    ids = d.select(F.col("doc_id").alias("id"))
    return P.first_available({
        "local": lab.select(F.col("doc_id").alias("id"), value(F.col("quality"))),
        "remote": b.select(F.col("item_id").alias("id"), value(F.length("text"))).join(ids, "id", "left_semi"),
        "none": ids.select("id", value(F.lit(0)))})


@query("msa11_channel_coverage", """
    SELECT label, round(sum(CASE WHEN embedding[d] > 0 THEN 1 ELSE 0 END) / (count(DISTINCT vec_id) * 21), 6) + 0.0 AS coverage FROM (SELECT label, vec_id, embedding, unnest(range(44, 65)) AS d FROM embeddings) GROUP BY 1""")
def channel_coverage(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda v: F.greatest(v, F.lit(0.0))).alias("vec"))
    return P.channel_coverage(e, ["label"]).withColumn("coverage", r6("coverage"))
