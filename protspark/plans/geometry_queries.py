"""Distance joins, mappings, alignments, template priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from protspark.operators import alignments as A
from protspark.operators import geometry as G
from protspark.operators.cleaning import sequence_choice
from protspark.plans.registry import query, r6, table
from protspark.plans.stand_ins import ALIGNED_SQL, PAIRS_SQL, POINTS_SQL, SEQUENCES_SQL, aligned, points, sequences
from protspark.schemas import DISTANCE_EDGES

NEAR = 0.1


@query("geo01_contacts", f"WITH {PAIRS_SQL} SELECT model_id, i, j, round(dist, 6) + 0.0 AS dist FROM pairs WHERE dist <= {NEAR}")
def contacts(spark, sf):
    return G.contacts(points(spark, sf), NEAR).select("model_id", "i", "j", r6("dist").alias("dist"))


@query("geo02_contact_labels", f"""
    WITH {PAIRS_SQL}, good AS (SELECT * FROM pts WHERE x < 0.2),
    near AS (SELECT p.model_id, count(*) AS contacts FROM pairs p JOIN good a ON a.idx = i JOIN good b ON b.idx = j WHERE dist < 0.15 GROUP BY 1),
    n AS (SELECT model_id, count(*) AS n, count(*) FILTER (x < 0.2) AS located FROM pts GROUP BY 1)
    SELECT model_id, n, located, located * (located - 1) // 2 AS valid, coalesce(contacts, 0) AS contacts FROM n LEFT JOIN near USING (model_id)""")
def contact_labels(spark, sf):
    p = points(spark, sf).withColumn("x", F.when(F.col("x") < 0.2, F.col("x")))
    near = G.contact_labels(p, 0.15, closed=False).groupBy("model_id").agg(F.count(F.lit(1)).alias("contacts"))
    return G.valid_pairs(p).join(near, "model_id", "left").na.fill(0, ["contacts"])


def order_points(spark, sf):
    """Orders as models, lines as residues, the return flag as chain; the first line of each number stands."""
    li = table(spark, sf, "lineitem")
    key = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag")
    one = li.groupBy(F.col("l_orderkey").alias("model_id"), F.col("l_linenumber").alias("idx")).agg(F.min(key).alias("r"))
    return one.select("model_id", "idx", F.col("r.l_returnflag").alias("chain"), F.col("r.l_quantity").alias("x"),
                      (F.col("r.l_extendedprice") / 1000).alias("y"), (F.col("r.l_discount") * 100).alias("z"), F.col("r.l_partkey").alias("part"))


ORDER_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_returnflag) AS rn FROM lineitem),
    res AS (SELECT l_orderkey AS model_id, l_linenumber AS idx, l_returnflag AS chain, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_partkey AS part FROM r WHERE rn = 1)"""


@query("geo02_contact_labels_dense", f"""
    WITH {ORDER_SQL} SELECT a.model_id, a.idx AS i, b.idx AS j, CASE WHEN sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 20 THEN 1 ELSE 0 END AS y
    FROM res a JOIN res b ON a.model_id = b.model_id AND a.idx < b.idx""")
def dense_labels(spark, sf):
    return G.contact_labels(order_points(spark, sf), 20.0, dense=True)


@query("geo03_inter_contacts", f"""
    WITH {ORDER_SQL}, d AS (SELECT a.model_id, a.chain AS chain_a, a.idx AS i, b.chain AS chain_b, b.idx AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist
    FROM res a JOIN res b ON a.model_id = b.model_id AND a.chain < b.chain) SELECT model_id, chain_a, i, chain_b, j, round(dist, 6) + 0.0 AS dist FROM d WHERE dist <= 20""")
def inter_contacts(spark, sf):
    return G.inter_contacts(order_points(spark, sf), 20.0).withColumn("dist", r6("dist"))


CHAIN_SQL = ORDER_SQL + """, sizes AS (SELECT model_id, chain, max(idx) + 1 AS len FROM res GROUP BY 1, 2),
    offs AS (SELECT model_id, chain, sum(len) OVER (PARTITION BY model_id ORDER BY chain) - len AS off, row_number() OVER (PARTITION BY model_id ORDER BY chain) - 1 AS chain_no FROM sizes),
    placed AS (SELECT res.*, CAST(off + idx AS BIGINT) AS gidx, CAST(chain_no AS INT) AS chain_no FROM res JOIN offs USING (model_id, chain))"""


@query("geo04_concat_chains", f"WITH {CHAIN_SQL} SELECT model_id, chain, idx, gidx, chain_no FROM placed")
def concat_chains(spark, sf):
    return G.concat_chains(order_points(spark, sf)).select("model_id", "chain", "idx", F.col("gidx").cast("long").alias("gidx"), "chain_no")


@query("geo04_complex_contacts", f"""
    WITH {CHAIN_SQL} SELECT a.model_id, a.gidx AS i, b.gidx AS j FROM placed a JOIN placed b ON a.model_id = b.model_id AND a.chain = b.chain AND a.gidx < b.gidx
    WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 20""")
def complex_contacts(spark, sf):
    c = G.complex_contacts(order_points(spark, sf), 20.0)
    return c.select("model_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


KNN_SQL = PAIRS_SQL + """, ends AS (SELECT model_id, i, j, dist FROM pairs UNION ALL SELECT model_id, j, i, dist FROM pairs),
    near AS (SELECT *, row_number() OVER (PARTITION BY model_id, i ORDER BY dist, j) AS rank FROM ends WHERE abs(i - j) >= 2),
    knn AS (SELECT model_id, least(i, j) AS i, greatest(i, j) AS j, min(dist) AS dist FROM near WHERE rank <= 6 GROUP BY 1, 2, 3)"""


@query("geo05_knn_graph", f"WITH {KNN_SQL} SELECT model_id, i, j, round(dist, 6) + 0.0 AS dist, round(exp(-dist * dist / (2 * 0.25 * 0.25)), 6) + 0.0 AS w FROM knn")
def knn_graph(spark, sf):
    g = G.knn_graph(points(spark, sf), 6, 2, 0.25)
    return g.select("model_id", "i", "j", r6("dist").alias("dist"), r6("w").alias("w"))


@query("geo06_knn_from_scores", """
    WITH s AS (SELECT l_suppkey AS graph_id, l_linenumber AS i, CAST(l_quantity AS INT) AS j, max(l_discount) AS score FROM lineitem GROUP BY 1, 2, 3),
    best AS (SELECT *, row_number() OVER (PARTITION BY graph_id, i ORDER BY score DESC, j) AS rn FROM s WHERE abs(i - j) >= 2)
    SELECT graph_id, least(i, j) AS i, greatest(i, j) AS j, max(score) AS w, round(1.0 / greatest(max(score), 0.000001), 6) + 0.0 AS dist FROM best WHERE rn <= 6 GROUP BY 1, 2, 3""")
def knn_from_scores(spark, sf):
    li = table(spark, sf, "lineitem")
    s = li.groupBy(F.col("l_suppkey").alias("graph_id"), F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("int").alias("j")).agg(F.max("l_discount").alias("score"))
    return G.knn_from_scores(s).withColumn("dist", r6("dist"))


TWO_SETS_SQL = POINTS_SQL + """, ca AS (SELECT * FROM pts WHERE y >= 0), lig AS (SELECT * FROM pts WHERE y < 0)"""


@query("geo07_ligand_contacts", f"""
    WITH {TWO_SETS_SQL} SELECT DISTINCT a.model_id, a.idx FROM ca a JOIN lig b ON a.model_id = b.model_id AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= {NEAR}""")
def ligand_contacts(spark, sf):
    p = points(spark, sf)
    return G.ligand_contacts(p.where("y >= 0"), p.where("y < 0"), NEAR)


@query("geo08_hbond_pairs", f"""
    WITH {TWO_SETS_SQL}, d AS (SELECT b.model_id, b.idx AS ligand_idx, a.idx AS protein_idx, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist
        FROM ca a JOIN lig b ON a.model_id = b.model_id WHERE a.z > -0.1 AND b.z > -0.1)
    SELECT model_id, ligand_idx, protein_idx, round(dist, 6) + 0.0 AS dist FROM d WHERE dist <= 0.15""")
def hbond_pairs(spark, sf):
    p = points(spark, sf).withColumn("element", F.when(F.col("z") > -0.1, F.when(F.col("x") > 0, "n").otherwise("O")).otherwise("C"))
    return G.hbond_pairs(p.where("y >= 0"), p.where("y < 0"), 0.15).withColumn("dist", r6("dist"))


@query("geo11_canonical_positions", f"""
    WITH {PAIRS_SQL}, m AS (SELECT model_id, idx, idx * 10 AS pos FROM pts WHERE x > 0)
    SELECT p.model_id, i, j, coalesce(a.pos, i + 1) AS i_pos, coalesce(b.pos, j + 1) AS j_pos FROM pairs p LEFT JOIN m a ON a.model_id = p.model_id AND a.idx = i
    LEFT JOIN m b ON b.model_id = p.model_id AND b.idx = j WHERE dist <= {NEAR}""")
def canonical_positions(spark, sf):
    p = points(spark, sf)
    mapping = p.where("x > 0").select("model_id", "idx", (F.col("idx") * 10).alias("pos"))
    return G.canonical_positions(G.contacts(p, NEAR), mapping).select("model_id", "i", "j", "i_pos", "j_pos")


# Aligned rows next to the row after them: two gapped strings of equal width.
HITS_SQL = ALIGNED_SQL + """, h AS (SELECT a.row_id AS hit_id, a.seq AS qaln, b.seq AS taln, 3 AS qstart, 5 AS tstart, 50 AS query_len FROM aln a JOIN aln b ON b.row_id = a.row_id + 1),
    cols AS (SELECT *, substr(qaln, c + 1, 1) AS q, substr(taln, c + 1, 1) AS t FROM (SELECT *, unnest(range(0, 64)) AS c FROM h)),
    placed AS (SELECT *, CAST(qstart - 2 + sum(CASE WHEN q <> '-' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS q_idx, CAST(tstart - 2 + sum(CASE WHEN t <> '-' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS t_idx
        FROM cols WINDOW w AS (PARTITION BY hit_id ORDER BY c))"""


def gapped_hits(spark, sf):
    a = aligned(spark, sf)
    nxt = a.select((F.col("row_id") - 1).alias("row_id"), F.col("seq").alias("t_aln"))
    return a.join(nxt, "row_id").select(F.col("row_id").alias("hit_id"), F.col("seq").alias("q_aln"), "t_aln", F.lit("3").alias("q_start"), F.lit("5").alias("t_start"), F.lit(50).alias("query_len"))


@query("geo09_map_aligned", f"WITH {HITS_SQL} SELECT hit_id, q_idx, t_idx FROM placed WHERE q <> '-' AND t <> '-' AND q_idx < 50")
def map_aligned(spark, sf):
    return A.map_aligned(gapped_hits(spark, sf), ["hit_id"])


@query("geo09_mapping_stats", f"""
    WITH {HITS_SQL} SELECT hit_id, round(avg(CASE WHEN q = t THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS identity, round(count(*) FILTER (q_idx < 50) / 50.0, 6) + 0.0 AS coverage
    FROM placed WHERE q <> '-' AND t <> '-' GROUP BY 1""")
def mapping_stats(spark, sf):
    return A.mapping_stats(gapped_hits(spark, sf), ["hit_id"]).select("hit_id", r6("identity").alias("identity"), r6("coverage").alias("coverage"))


@query("msa12_project_to_query", f"""
    WITH {HITS_SQL}, spine AS (SELECT hit_id, unnest(range(0, 50)) AS pos FROM h)
    SELECT s.hit_id, CAST(s.pos AS INT) AS pos, coalesce(p.t, '-') AS ch FROM spine s LEFT JOIN placed p ON p.hit_id = s.hit_id AND p.q_idx = s.pos AND p.q <> '-' AND p.t <> '-'""")
def project_to_query(spark, sf):
    return A.project_to_query(gapped_hits(spark, sf), ["hit_id"])


def neighbour_sequences(spark, sf):
    s = sequences(spark, sf)
    return s.join(s.select((F.col("query_id") - 1).alias("query_id"), F.col("seq").alias("target")), "query_id").withColumnRenamed("seq", "query")


@query("geo10_align_pairs")
def align_pairs(spark, sf):
    """Every sequence aligned with the next one; mapped back to positions."""
    done = A.align_pairs(neighbour_sequences(spark, sf), ["query_id"], "canonical")
    stats = A.mapping_stats(done, ["query_id"])
    return done.join(stats, "query_id").select("query_id", r6("score").alias("score"), F.length("qaln").alias("width"), r6("identity").alias("identity"), r6("coverage").alias("coverage"))


def customer_templates(spark, sf):
    """Customers as queries, their orders as templates, lines as residues."""
    p = order_points(spark, sf)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("template_id"), F.col("o_custkey").alias("query_id"))
    coords = p.select(F.col("model_id").alias("template_id"), F.col("idx").alias("t_idx"), "x", "y", "z")
    mapping = coords.join(o, "template_id").select("query_id", "template_id", F.col("t_idx").alias("q_idx"), "t_idx")
    return mapping, coords


BIN_SQL = "CASE " + " ".join(f"WHEN dist < {DISTANCE_EDGES[k + 1]} THEN {k}" for k in range(len(DISTANCE_EDGES) - 2)) + f" ELSE {len(DISTANCE_EDGES) - 2} END"
TEMPLATE_SQL = ORDER_SQL + """, m AS (SELECT o_custkey AS query_id, res.* FROM res JOIN orders ON o_orderkey = model_id),
    t AS (SELECT query_id, model_id, row_number() OVER (PARTITION BY query_id ORDER BY model_id) AS rn FROM (SELECT DISTINCT query_id, model_id FROM m)),
    tp AS (SELECT a.query_id, a.model_id AS template_id, a.idx AS qi, b.idx AS qj, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist, rn
        FROM m a JOIN m b ON a.model_id = b.model_id AND a.idx < b.idx JOIN t ON t.query_id = a.query_id AND t.model_id = a.model_id)"""


@query("geo12_template_priors", f"""
    WITH {TEMPLATE_SQL}, n AS (SELECT query_id, qi, qj, {BIN_SQL} AS bin, count(*) AS c FROM tp GROUP BY 1, 2, 3, 4)
    SELECT query_id, qi, qj, bin, round(c / sum(c) OVER (PARTITION BY query_id, qi, qj), 6) + 0.0 AS p FROM n""")
def template_priors(spark, sf):
    return A.template_priors(*customer_templates(spark, sf)).withColumn("p", r6("p"))


@query("geo12_templates_used", f"WITH {TEMPLATE_SQL} SELECT query_id, count(DISTINCT model_id) AS templates_used FROM m GROUP BY 1")
def templates_used(spark, sf):
    return A.templates_used(*customer_templates(spark, sf))


@query("geo12_contact_prior", f"""
    WITH {TEMPLATE_SQL} SELECT query_id, qi, qj, round(avg(CASE WHEN {BIN_SQL} <= 2 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS prior FROM tp GROUP BY 1, 2, 3""")
def contact_prior(spark, sf):
    return A.contact_prior(A.template_priors(*customer_templates(spark, sf))).withColumn("prior", r6("prior"))


@query("geo13_soft_prior", f"""
    WITH {TEMPLATE_SQL} SELECT query_id, qi, qj, round(max(1 / (1 + (dist / 8.0) * (dist / 8.0))), 6) + 0.0 AS prior, count(*) FILTER (dist <= 8.0 AND dist > 6.0) AS n3, count(*) FILTER (dist <= 30.0 AND dist > 24.0) AS n10
    FROM tp GROUP BY 1, 2, 3""")
def soft_prior(spark, sf):
    return A.soft_prior(*customer_templates(spark, sf)).select("query_id", "qi", "qj", r6("prior").alias("prior"), "n3", "n10")


@query("geo14_query_sequence", """
    SELECT d.doc_id AS query_id, md5(CASE WHEN lang = 'en' THEN text WHEN item_id IS NOT NULL THEN b.text_b WHEN l.doc_id IS NOT NULL THEN 'ATOM' || d.doc_id ELSE repeat('X', CAST(n_chars AS INT)) END) AS digest,
        CASE WHEN lang = 'en' THEN 'given' WHEN item_id IS NOT NULL THEN 'seqres' WHEN l.doc_id IS NOT NULL THEN 'atom' ELSE 'unknown' END AS source
    FROM documents d LEFT JOIN (SELECT item_id, text AS text_b FROM benchmark) b ON item_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def query_sequence(spark, sf):
    d, b, lab = table(spark, sf, "documents"), table(spark, sf, "benchmark"), table(spark, sf, "labels")
    q = d.select(F.col("doc_id").alias("query_id"), F.when(F.col("lang") == "en", F.col("text")).otherwise("").alias("sequence"), F.col("n_chars").alias("length"))
    chosen = sequence_choice(q, b.select(F.col("item_id").alias("query_id"), F.col("text").alias("seq")),
                             lab.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("ATOM"), "doc_id").alias("seq")))
    return chosen.select("query_id", F.md5(F.col("seq").cast("binary")).alias("digest"), "source")


@query("geo15_usable_hits", """
    WITH h AS (SELECT l_suppkey AS query_id, l_orderkey * 10000000 + l_partkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS INT) AS ord, substr(CAST(10000 + l_partkey AS VARCHAR), 2, 4) AS code, l_returnflag AS chain
        FROM lineitem WHERE l_linestatus = 'O'),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS rn FROM h)
    SELECT query_id, ord, best.code, chain AS template_chain FROM best WHERE rn <= 8 AND code IN (SELECT substr(CAST(10000 + p_partkey AS VARCHAR), 2, 4) FROM part WHERE p_size > 20)""")
def usable_hits(spark, sf):
    """Of the first eight hits of a query those at hand."""
    return A.usable_hits(*supplier_hits(spark, sf), first=8).select("query_id", "ord", "code", "template_chain")


def supplier_hits(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    code = lambda c: F.substring((F.col(c) + 10000).cast("string"), 2, 4)
    subject = F.when(F.col("l_linestatus") == "O", F.concat(code("l_partkey"), F.lit("_"), F.lower("l_returnflag"))).otherwise("not a template")
    ord_ = F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")
    h = li.select(F.col("l_suppkey").alias("query_id"), ord_.alias("ord"), subject.alias("subject"))
    return h, p.where("p_size > 20").select(code("p_partkey").alias("code"))


@query("geo15_all_usable_hits", """
    SELECT l_suppkey AS query_id, l_orderkey * 10000000 + l_partkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS INT) AS ord, substr(CAST(10000 + l_partkey AS VARCHAR), 2, 4) AS code, l_returnflag AS template_chain
    FROM lineitem WHERE l_linestatus = 'O' AND substr(CAST(10000 + l_partkey AS VARCHAR), 2, 4) IN (SELECT substr(CAST(10000 + p_partkey AS VARCHAR), 2, 4) FROM part WHERE p_size > 20)""")
def all_usable_hits(spark, sf):
    """Every hit at hand, without a cap."""
    return A.usable_hits(*supplier_hits(spark, sf)).select("query_id", "ord", "code", "template_chain")


@query("geo10_align_pairs_roundtrip", f"""
    WITH {SEQUENCES_SQL} SELECT a.query_id, a.seq AS query, b.seq AS target, true AS same_width FROM seqs a JOIN seqs b ON b.query_id = a.query_id + 1""")
def align_roundtrip(spark, sf):
    """Aligned strings without their gaps are the input, and both are equally wide."""
    done = A.align_pairs(neighbour_sequences(spark, sf), ["query_id"], "template")
    bare = lambda c: F.translate(c, "-", "")
    return done.select("query_id", bare("qaln").alias("query"), bare("taln").alias("target"), (F.length("qaln") == F.length("taln")).alias("same_width"))


def align_score_sql(match: float, mismatch: float, opening: float, extend: float) -> str:
    """The score recurrence, one anti-diagonal per step. ``lb`` is the score of the cell to the left, by which the next step
    reaches the diagonal."""
    low = "-1e18::DOUBLE"
    return f"""
    WITH RECURSIVE {SEQUENCES_SQL}, pair AS (SELECT a.query_id, a.seq AS q, b.seq AS t FROM seqs a JOIN seqs b ON b.query_id = a.query_id + 1),
    dp AS (SELECT query_id, q, t, 0::BIGINT AS i, 0::BIGINT AS j, 0.0::DOUBLE AS best, {low} AS up, {low} AS side, {low} AS lb FROM pair
        UNION ALL SELECT query_id, q, t, i, j, greatest(diag, up, side) AS best, up, side, lb FROM (
            SELECT query_id, any_value(q) AS q, any_value(t) AS t, i, j, max(up) AS up, max(side) AS side, max(diag) AS diag, max(lb) AS lb FROM (
                SELECT query_id, q, t, i + 1 AS i, j, greatest(best + {opening}, up + {extend}) AS up, {low} AS side,
                    lb + CASE WHEN substr(q, i + 1, 1) = substr(t, j, 1) THEN {match} ELSE {mismatch} END AS diag, {low} AS lb FROM dp WHERE i < length(q)
                UNION ALL SELECT query_id, q, t, i, j + 1, {low}, greatest(best + {opening}, side + {extend}), {low}, best FROM dp WHERE j < length(t))
            GROUP BY query_id, i, j))
    SELECT query_id, round(best, 6) + 0.0 AS score FROM dp WHERE i = length(q) AND j = length(t)"""


@query("geo10_align_scores", align_score_sql(*A.SCHEMES["canonical"]))
def align_scores(spark, sf):
    """The best score of every sequence against the next one."""
    return A.align_pairs(neighbour_sequences(spark, sf), ["query_id"], "canonical").select("query_id", r6("score").alias("score"))
