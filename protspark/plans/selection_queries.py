"""Top-k, best-of, percentile, dedup and naming."""

from __future__ import annotations

from pyspark.sql import functions as F

from protspark.operators import topk as T
from protspark.plans.registry import query, r6, table
from protspark.plans.stand_ins import PAIRS_SQL, points
from protspark.operators.geometry import closest_contacts

LINE_ORD = "l_orderkey * 10000000000 + l_partkey * 10000 + l_suppkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS INT)"


def line_ord():
    """A number that orders the lines of the table."""
    return F.col("l_orderkey") * 10000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")


def line_hits(spark, sf):
    """Suppliers as queries, parts as subjects."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("subject"), line_ord().alias("ord"),
                     F.when(F.col("l_returnflag") != "R", F.col("l_discount")).alias("evalue"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("bits"))


HITS_SQL = f"h AS (SELECT l_suppkey AS query, l_partkey AS subject, {LINE_ORD} AS ord, CASE WHEN l_returnflag <> 'R' THEN l_discount END AS evalue, CASE WHEN l_linestatus = 'O' THEN l_quantity END AS bits FROM lineitem)"


@query("top01_top_hits", f"""
    WITH {HITS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY query, subject ORDER BY evalue NULLS LAST, bits DESC NULLS LAST, ord) AS r1 FROM h),
    t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY evalue NULLS LAST, bits DESC NULLS LAST, ord) AS rank FROM s WHERE r1 = 1)
    SELECT query, subject, ord, evalue, bits, rank FROM t WHERE rank <= 16""")
def top_hits(spark, sf):
    return T.top_hits(line_hits(spark, sf), 16)


@query("top02_first_subjects", f"""
    WITH {HITS_SQL}, s AS (SELECT query, subject, min(ord) AS ord FROM h GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord) AS rank FROM s) SELECT query, subject, ord FROM t WHERE rank <= 16""")
def first_subjects(spark, sf):
    return T.first_subjects(line_hits(spark, sf), 16).select("query", "subject", "ord")


@query("top03_top_mutations", "SELECT o_orderkey AS ord, o_totalprice AS reward FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_mutations(spark, sf):
    return T.top_mutations(table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("reward")))


@query("top04_top_edges", """
    SELECT l_suppkey AS i, l_partkey AS j, sum(l_extendedprice) AS grad_gmem_A FROM lineitem GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10""".replace("sum(l_extendedprice)", "max(l_extendedprice)").replace("grad_gmem_A", '"grad_gmem_A"'))
def top_edges(spark, sf):
    e = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.max("l_extendedprice").alias("grad_gmem_A"))
    return T.top_edges(e)


@query("top05_best_structure", """
    WITH c AS (SELECT l_partkey AS uniprot, CAST(l_orderkey AS VARCHAR) AS pdb_id, l_returnflag AS chain_id, CASE WHEN l_linestatus = 'O' THEN l_discount END AS coverage, l_quantity AS q FROM lineitem WHERE l_quantity > 30),
    b AS (SELECT *, row_number() OVER (PARTITION BY uniprot ORDER BY coalesce(coverage, 0) DESC, CASE WHEN q > 45 THEN 9.9 ELSE q / 10 END, pdb_id) AS rn FROM c)
    SELECT p_partkey AS uniprot, pdb_id, coverage, CASE WHEN pdb_id IS NULL THEN 'AFDB' ELSE 'PDB' END AS source FROM part LEFT JOIN b ON uniprot = p_partkey AND rn = 1""")
def best_structure(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    res = F.when(F.col("l_quantity") > 45, "n/a").otherwise((F.col("l_quantity") / 10).cast("string"))
    c = li.where("l_quantity > 30").select(F.col("l_partkey").alias("uniprot"), F.col("l_orderkey").cast("string").alias("pdb_id"), F.col("l_returnflag").alias("chain_id"),
                                           F.when(F.col("l_linestatus") == "O", F.col("l_discount")).alias("coverage"), res.alias("resolution"))
    return T.best_structure(c, p.select(F.col("p_partkey").alias("uniprot"), F.lit(0).alias("ord"))).select("uniprot", "pdb_id", "coverage", "source")


@query("top06_topk_pairs", f"""
    WITH {PAIRS_SQL}, n AS (SELECT model_id, count(*) AS len FROM pts GROUP BY 1), s AS (SELECT model_id, i, j, 1 / (1 + dist) AS score FROM pairs WHERE dist <= 0.25),
    k AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY score DESC, i, j) AS rank FROM s)
    SELECT model_id, i, j, round(score, 6) + 0.0 AS score, rank, score >= 0.9 AS pred FROM k JOIN n USING (model_id) WHERE rank <= len""")
def topk_pairs(spark, sf):
    p = points(spark, sf)
    n = p.groupBy("model_id").agg(F.count(F.lit(1)).alias("len"))
    s = closest_contacts(p, n, "len", 0.25).select("model_id", "i", "j", (1 / (1 + F.col("dist"))).alias("score")).join(n, "model_id")
    return T.topk_pairs(s, ["model_id"], length="len", thr=0.9).select("model_id", "i", "j", r6("score").alias("score"), "rank", "pred")


@query("top07_percentile_edges", """
    WITH t AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.95) AS q FROM lineitem GROUP BY 1)
    SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, round(q, 6) + 0.0 AS threshold FROM lineitem JOIN t USING (l_returnflag) WHERE l_extendedprice > q""")
def percentile_edges(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return T.percentile_edges(li, ["l_returnflag"], "l_extendedprice").withColumn("threshold", r6("threshold"))


@query("top07_percentile_endpoints", """
    WITH t AS (SELECT quantile_cont(l_extendedprice, 0.95) AS q FROM lineitem), e AS (SELECT l_suppkey AS i, l_partkey AS j FROM lineitem, t WHERE l_extendedprice > q)
    SELECT i AS id FROM e UNION SELECT j FROM e""")
def percentile_endpoints(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), "l_extendedprice")
    return T.endpoints(T.percentile_edges(li, [], "l_extendedprice"), [])


@query("top08_top_central", """
    WITH d AS (SELECT s_nationkey AS g, l_suppkey AS id, count(*) AS degree FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY degree DESC, id) AS rank FROM d) SELECT g, id, degree, rank FROM k WHERE rank <= 5""")
def top_central(spark, sf):
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    d = li.join(s, li.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("g"), F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    valid = s.where("s_acctbal > 0").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("id"))
    return T.top_central(d, valid, ["g"], "degree", 5)


@query("top09_rank_of", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def rank_of(spark, sf):
    return T.rank_of(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey", "rank")


@query("top09_rank_of_all", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def rank_of_all(spark, sf):
    return T.rank_of(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [], "o_totalprice", "o_orderkey").select("o_orderkey", "rank")


@query("top10_topk_hit_rate", """
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders), f AS (SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS found FROM k WHERE rn <= 10 GROUP BY 1)
    SELECT round(avg(found), 6) + 0.0 AS hit_rate, count(*) AS n FROM f""")
def topk_hit_rate(spark, sf):
    o = table(spark, sf, "orders").withColumn("hit", F.col("o_orderpriority") == "1-URGENT")
    return T.topk_hit_rate(o, ["o_custkey"], "o_totalprice", "hit", "o_orderkey").withColumn("hit_rate", r6("hit_rate"))


@query("top11_dedup_sequences", "SELECT min(doc_id) AS doc_id, length(text) AS n FROM documents GROUP BY text")
def dedup_sequences(spark, sf):
    return T.dedup_sequences(table(spark, sf, "documents"), "text", "doc_id").select("doc_id", F.length("text").cast("long").alias("n"))


@query("top12_collect_accessions", """
    WITH h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) SELECT user_id, min(event_id) AS event_id FROM h WHERE rn <= 5 GROUP BY 1""")
def collect_accessions(spark, sf):
    return T.collect_accessions(table(spark, sf, "events"), "event_type", "user_id", "event_id", 5)


@query("top13_uniquify_names", """
    WITH k AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '_' || k END AS unique_name FROM k""")
def uniquify_names(spark, sf):
    return T.uniquify_names(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("top14_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending(spark, sf):
    return T.pending(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("top15_cap", "SELECT o_orderkey, substr(o_orderpriority, 1, 5) AS o_orderpriority FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def cap(spark, sf):
    return T.crop_len(T.cap(table(spark, sf, "orders"), 100, "o_orderdate", "o_orderkey"), "o_orderpriority", 5).select("o_orderkey", "o_orderpriority")


@query("top16_ordered_sink", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_totalprice AS reward, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def ordered_sink(spark, sf):
    """Written in reward order; the place is counted again from the files, part by part."""
    from protspark.functions.lineage import shared_folder
    from protspark.functions.ordered import ranked
    from protspark.sources.sinks import write_ranked

    path = shared_folder(spark, "ranked")
    write_ranked(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, F.desc("o_totalprice"), "o_orderkey")
    back = spark.read.option("header", True).csv(path).select("o_orderkey", "o_totalprice", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row"))
    placed = ranked(back, [], [F.col("file"), F.col("row")], "place")
    return placed.select("o_orderkey", F.col("o_totalprice").cast("double").alias("reward"), "place")
