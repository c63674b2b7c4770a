"""Casts, keys, residue codes, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from protspark.functions import columns as C
from protspark.functions import vectors as V
from protspark.operators import cleaning
from protspark.operators.geometry import contacts
from protspark.plans.registry import query, r6, table
from protspark.plans.stand_ins import PAIRS_SQL, POINTS_SQL, points
from protspark.schemas import AMINO_ACIDS, VARIANT_SYNONYMS
from protspark.sources.entities import apply_mapping, normalize_headers

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CODES = ["ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "MSE", "UNK"]
LETTERS = "ARNDCQEGHILKMFPSTWYVMX"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("prj01_tolerant_cast", """
    WITH t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'view' THEN '' ELSE regexp_extract(props, '([0-9]+)', 1) || '.0' END AS raw FROM events)
    SELECT event_id, CAST(TRY_CAST(raw AS DOUBLE) AS INT) AS year, CASE WHEN raw = 'n/a' THEN raw END AS year_raw FROM t""")
def tolerant_cast(spark, sf):
    e = table(spark, sf, "events")
    raw = (F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "view", "")
           .otherwise(F.concat(F.regexp_extract("props", "([0-9]+)", 1), F.lit(".0"))))
    return C.tolerant_cast(e.select("event_id", raw.alias("year")), {"year": "int"})


@query("prj02_strict_cast", """
    SELECT l_orderkey, CAST(l_linenumber AS INT) AS i, l_quantity AS dist, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount END AS w FROM lineitem""")
def strict_cast(spark, sf):
    li = table(spark, sf, "lineitem")
    text = li.select("l_orderkey", F.concat("l_linenumber", F.lit(".0")).alias("i"), F.col("l_quantity").cast("string").alias("dist"),
                     F.when(F.col("l_returnflag") == "R", "null").otherwise(F.col("l_discount").cast("string")).alias("w"))
    return C.strict_cast(text, {"i": "int", "dist": "double", "w": "double"})


@query("prj03_require_key", "SELECT p_partkey, p_brand FROM part WHERE p_size <= 25")
def require_key(spark, sf):
    p = table(spark, sf, "part").withColumn("p_brand", F.when(F.col("p_size") > 25, "").otherwise(F.col("p_brand")))
    return C.require_key(p, "p_brand").select("p_partkey", "p_brand")


@query("prj04_default_key", """
    SELECT l_orderkey, CASE WHEN l_discount > 0.05 THEN 'assay:' || l_partkey || ':' || l_suppkey || ':' || l_returnflag ELSE CAST(l_orderkey AS VARCHAR) END AS assay_id,
        'tox:' || l_suppkey || ':' || l_returnflag AS tox_id,
        'structure:' || l_partkey || ':' || CASE WHEN l_linestatus = 'O' THEN 'NA' ELSE CAST(l_suppkey AS VARCHAR) END AS structure_id FROM lineitem""")
def default_key(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", F.when(F.col("l_discount") > 0.05, "").otherwise(F.col("l_orderkey").cast("string")).alias("assay_id"),
        F.col("l_partkey").cast("string").alias("uniprot_id"), F.col("l_suppkey").cast("string").alias("ligand_id"), F.col("l_returnflag").alias("metric"),
        F.col("l_returnflag").alias("flag"), F.lit("").alias("tox_id"), "l_linestatus")
    keyed = C.default_key(C.default_key(li, "assays"), "toxicity")
    blank = keyed.withColumn("ligand_id", F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("ligand_id")))
    return C.default_key(blank, "structures").select("l_orderkey", "assay_id", "tox_id", "structure_id")


@query("prj05_coalesce_nonempty", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_totalprice > 200000 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END ELSE o_orderstatus END AS id FROM orders""")
def coalesce_nonempty(spark, sf):
    o = table(spark, sf, "orders")
    first = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    second = F.when(F.col("o_totalprice") > 200000, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", C.coalesce_nonempty(first, second, "o_custkey").alias("id"))


@query("prj06_derive_pdb_id", """
    SELECT page_id, CASE WHEN page_id > 100 THEN CAST(page_id AS VARCHAR) ELSE split_part(split_part(url, '/', -1), '.', 1) END AS pdb_id FROM pages""")
def derive_pdb_id(spark, sf):
    p = table(spark, sf, "pages")
    sid = F.when(F.col("page_id") > 100, F.concat(F.lit("pdb_"), "page_id")).otherwise("x")
    return p.withColumn("sid", sid).select("page_id", C.derive_pdb_id("sid", "url").alias("pdb_id"))


@query("prj07_normalize_headers", "SELECT s_suppkey AS pos, s_name AS wt, s_nationkey AS mut, s_acctbal AS score FROM supplier")
def normalize_header_names(spark, sf):
    s = table(spark, sf, "supplier").toDF("POSITION", "WildType", "Variant", "Fitness")
    return normalize_headers(s, VARIANT_SYNONYMS, ["pos", "wt", "mut", "score"])


@query("prj08_clean_variants", """
    SELECT policy, CAST(user_id AS INT) AS pos, upper(substr(event_type, 1, 1)) AS wt, upper(substr(event_type, 2, 1)) AS mut,
        CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS score
    FROM events JOIN (SELECT unnest(['drop', 'zero']) AS policy) ON policy = 'zero' OR event_type <> 'error'""")
def clean_variants(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("pos"), F.col("event_type").alias("wt"), F.substring("event_type", 2, 9).alias("mut"),
        F.when(F.col("event_type") == "error", "bad").otherwise(F.col("value").cast("string")).alias("score"))
    parts = [cleaning.clean_variants(e, na=p).select(F.lit(p).alias("policy"), "pos", "wt", "mut", "score") for p in ("drop", "zero")]
    return parts[0].unionByName(parts[1])


@query("prj09_clean_fitness", """
    SELECT c_custkey, least(greatest(c_acctbal / 1000, -5.0), 5.0) AS fitness FROM customer WHERE c_mktsegment <> 'FURNITURE'""")
def clean_fitness(spark, sf):
    c = table(spark, sf, "customer")
    raw = F.when(F.col("c_mktsegment") == "FURNITURE", "n/a").otherwise((F.col("c_acctbal") / 1000).cast("string"))
    return cleaning.clean_fitness(c.select("c_custkey", raw.alias("normalized_fitness")))


@query("prj10_label_stability", """
    SELECT substr(s_name, length(s_name) - 3) AS pdb_id, s_nationkey AS position, s_acctbal - 4500 AS "ddG", CASE WHEN s_acctbal - 4500 < 0 THEN 1 ELSE 0 END AS label
    FROM supplier WHERE s_nationkey >= 5""")
def label_stability(spark, sf):
    s = table(spark, sf, "supplier")
    pid = F.when(F.col("s_nationkey") < 5, F.right("s_name", F.lit(5))).otherwise(F.right("s_name", F.lit(4)))
    return cleaning.label_stability(s.select(pid.alias("pdb_id"), F.col("s_nationkey").alias("position"), (F.col("s_acctbal") - 4500).alias("ddG")))


@query("prj11_residue_codes", f"""
    WITH c AS (SELECT p_partkey, {_list(CODES)}[p_size % 22 + 1] AS code FROM part)
    SELECT p_partkey, code, substr('{LETTERS}', list_position({_list(CODES)}, code), 1) AS aa,
        CASE WHEN code IN ('MSE', 'UNK') THEN NULL ELSE substr('{LETTERS}', list_position({_list(CODES)}, code), 1) END AS strict FROM c""")
def residue_codes(spark, sf):
    p = table(spark, sf, "part")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), F.pmod("p_size", F.lit(len(CODES))) + 1)
    return p.select("p_partkey", code.alias("code")).select(
        "p_partkey", "code", C.aa3_to_aa1(F.lower("code")).alias("aa"), C.aa3_to_aa1("code", "standard", None).alias("strict"))


@query("prj11_residue_codes_contact", """
    WITH c AS (SELECT p_partkey, ['SEC', 'PYL', 'ASX', 'GLX', 'XLE', 'XAA', 'UNK', 'ALA', 'TRP', 'MSE'][p_size % 10 + 1] AS code FROM part)
    SELECT p_partkey, code, substr('CKBZJXXAWX', list_position(['SEC', 'PYL', 'ASX', 'GLX', 'XLE', 'XAA', 'UNK', 'ALA', 'TRP', 'MSE'], code), 1) AS aa FROM c""")
def residue_codes_contact(spark, sf):
    names = ["SEC", "PYL", "ASX", "GLX", "XLE", "XAA", "UNK", "ALA", "TRP", "MSE"]
    code = F.element_at(F.array(*[F.lit(c) for c in names]), F.pmod("p_size", F.lit(len(names))) + 1)
    return table(spark, sf, "part").select("p_partkey", code.alias("code")).select(
        "p_partkey", "code", C.aa3_to_aa1("code", "contact").alias("aa"))


@query("prj12_sequence_text", r"""
    WITH t AS (SELECT doc_id, text AS s FROM documents)
    SELECT doc_id, md5(regexp_replace(s, '[OBUZ]', 'X', 'g')) AS normal,
        md5(rtrim(regexp_replace(replace(replace(s, chr(10), '_'), ' ', '_'), '(.)', '\1 ', 'g'), ' ')) AS spaced,
        md5(regexp_replace(s, '[^A-Z]', '', 'g')) AS letters FROM t""")
def sequence_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("s"))
    digest = lambda c: F.md5(c.cast("binary"))
    flat = F.translate(F.regexp_replace("s", "\n", "_"), " ", "_")
    headed = F.concat(F.lit(">HEADER\n"), "s")
    return d.select("doc_id", digest(C.normalize_seq("s")).alias("normal"), digest(C.spaced_seq(flat)).alias("spaced"), digest(C.letters_only(headed)).alias("letters"))


@query("prj13_parse_subject", """
    WITH s AS (SELECT c_custkey, substr(c_name, length(c_name) - 3) || CASE WHEN c_nationkey > 12 THEN '#' ELSE '_' END || lower(substr(c_mktsegment, 1, 1)) AS sid FROM customer)
    SELECT c_custkey, CASE WHEN sid LIKE '%#%' THEN NULL ELSE upper(substr(sid, 1, 4)) END AS code, CASE WHEN sid LIKE '%#%' THEN NULL ELSE upper(substr(sid, 6, 1)) END AS chain FROM s""")
def parse_subject(spark, sf):
    c = table(spark, sf, "customer")
    sid = F.concat(F.right("c_name", F.lit(4)), F.when(F.col("c_nationkey") > 12, "#").otherwise("_"), F.lower(F.substring("c_mktsegment", 1, 1)))
    return c.select("c_custkey", C.parse_subject(sid).alias("p")).select("c_custkey", "p.code", "p.chain")


@query("prj14_residue_labels", """
    SELECT l_orderkey || ':' || l_linenumber AS uid, l_returnflag || '-LEU' || l_linenumber AS label, l_returnflag AS chain, 'LEU' AS resname, CAST(l_linenumber AS INT) AS resnum FROM lineitem""")
def residue_labels(spark, sf):
    li = table(spark, sf, "lineitem").select(C.residue_uid("l_orderkey", "l_linenumber").alias("uid"), C.residue_label("l_returnflag", F.lit("LEU"), "l_linenumber").alias("label"))
    return li.select("uid", "label", C.parse_residue_label("label").alias("p")).select("uid", "label", "p.*")


@query("prj15_one_hot", "SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderpriority = '{p}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS h{k}" for k, p in enumerate(PRIORITIES[:-1])) +
       f", CASE WHEN o_orderpriority NOT IN ({', '.join(repr(p) for p in PRIORITIES[:-1])}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS h4 FROM orders")
def one_hot(spark, sf):
    o = table(spark, sf, "orders").withColumn("p", F.when(F.col("o_orderpriority") == "5-LOW", "?").otherwise(F.col("o_orderpriority")))
    return o.select("o_orderkey", C.one_hot("p", PRIORITIES, default="5-LOW").alias("h")).select("o_orderkey", *[F.col("h")[k].alias(f"h{k}") for k in range(5)])


@query("prj16_node_features", f"""
    WITH {POINTS_SQL}, f AS (SELECT idx, list_concat([x, y, z], list_transform(range(0, 20), lambda k: CASE WHEN k = idx % 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS v FROM pts)
    SELECT idx, CAST(d - 1 AS INT) AS dim, v[d] AS value FROM (SELECT idx, v, unnest(range(1, 24)) AS d FROM f)""")
def node_features(spark, sf):
    by_letter = ["ALA", "CYS", "ASP", "GLU", "PHE", "GLY", "HIS", "ILE", "LYS", "LEU", "MET", "ASN", "PRO", "GLN", "ARG", "SER", "THR", "VAL", "TRP", "TYR"]
    names = F.array(*[F.lit(n) for n in by_letter])
    p = points(spark, sf).withColumn("resname", F.element_at(names, F.pmod("idx", F.lit(20)).cast("int") + 1))
    return V.explode_vector(cleaning.node_features(p), ["idx"], "features")


@query("prj16_edge_features", """
    SELECT l_orderkey, l_quantity AS dist, l_discount AS w, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE l_tax END AS g FROM lineitem""")
def edge_features(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("dist"), F.col("l_discount").alias("w"), F.when(F.col("l_returnflag") != "N", F.col("l_tax")).alias("g_mem"))
    return cleaning.edge_features(li).select("l_orderkey", *[F.col("features")[k].alias(n) for k, n in enumerate(("dist", "w", "g"))])


PAIR_SUM_SQL = """list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) + CAST(p[2] AS DOUBLE)
    + abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) + CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"""


@query("prj17_pair_features", f"""
    WITH {PAIRS_SQL} SELECT i, j, 256 AS width, round({PAIR_SUM_SQL}, 6) + 0.0 AS total
    FROM pairs JOIN embeddings a ON a.vec_id = i JOIN embeddings b ON b.vec_id = j WHERE dist <= 0.1""")
def pair_features(spark, sf):
    e = table(spark, sf, "embeddings")
    known = points(spark, sf).join(e.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("h")), "idx")
    f = contacts(known, 0.1, cols=["h"]).select("i", "j", V.size_and_sum(V.pair_features("h_i", "h_j")).alias("f"))
    return f.select("i", "j", F.col("f.n").alias("width"), r6("f.total").alias("total"))


NORM_SQL = "round(sqrt(list_sum(list_transform({v}, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 6) + 0.0"


@query("prj18_align_dim", f"""
    SELECT vec_id, 70 AS wide, {NORM_SQL.format(v='embedding')} AS wide_norm, 50 AS narrow, {NORM_SQL.format(v='embedding[1:50]')} AS narrow_norm FROM embeddings""")
def align_dim(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.align_dim("embedding", 70).alias("a"), V.align_dim("embedding", 50).alias("b"))
    return e.select("vec_id", F.size("a").alias("wide"), r6(V.l2_norm("a")).alias("wide_norm"), F.size("b").alias("narrow"), r6(V.l2_norm("b")).alias("narrow_norm"))


@query("prj19_concat_features", """
    WITH r AS (SELECT label, vec_id, embedding[1:3] AS v FROM embeddings WHERE embedding[1] > 0 AND label <> 3),
    has AS (SELECT DISTINCT label FROM r),
    j AS (SELECT e.label, e.vec_id, has.label IS NOT NULL AS present, r.v FROM embeddings e LEFT JOIN has ON has.label = e.label LEFT JOIN r ON r.vec_id = e.vec_id)
    SELECT mode, CAST(label AS VARCHAR) AS id, vec_id AS idx, CAST(CASE WHEN present THEN 68 ELSE 64 END AS INT) AS width, present AS right_present,
        round(CASE WHEN v IS NULL THEN 0 ELSE CAST(v[1] AS DOUBLE) + CAST(v[2] AS DOUBLE) + CAST(v[3] AS DOUBLE) + 7 END, 6) + 0.0 AS right_sum
    FROM j JOIN (SELECT unnest(['pad', 'crop']) AS mode) ON mode = 'pad' OR NOT present OR v IS NOT NULL""")
def concat_features(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("id"), F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    right = e.where((F.col("vec")[0] > 0) & (F.col("id") != "3")).withColumn("vec", F.slice("vec", 1, 3))
    depth = right.select("id").distinct().withColumn("depth", F.lit(7))
    tail = F.aggregate(F.slice("vec", 65, 99), F.lit(0.0), lambda s, x: s + x)
    parts = [cleaning.concat_features(e, right, mode, 3, depth).select(F.lit(mode).alias("mode"), "id", "idx", F.size("vec").alias("width"), "right_present", r6(tail).alias("right_sum"))
             for mode in ("pad", "crop")]
    return parts[0].unionByName(parts[1])


@query("prj20_mean_pool", """
    SELECT label, CAST(d - 1 AS INT) AS dim, round(avg(CAST(embedding[d] AS DOUBLE)), 6) + 0.0 AS value
    FROM (SELECT label, embedding, unnest(range(1, 65)) AS d FROM embeddings) GROUP BY 1, 2""")
def mean_pool(spark, sf):
    m = V.mean_pool(table(spark, sf, "embeddings"), ["label"], "embedding")
    return V.explode_vector(m, ["label"], "vec").withColumn("value", r6("value"))


@query("prj21_content_key", "SELECT substr(sha1('model::' || text), 1, 16) AS key, count(*) AS copies FROM documents GROUP BY 1")
def content_key(spark, sf):
    return table(spark, sf, "documents").groupBy(C.content_key(F.lit("model"), "text").alias("key")).agg(F.count(F.lit(1)).alias("copies"))


@query("prj22_render_prompt", """
    SELECT doc_id, md5('Target ' || doc_id || ' in ' || lang || ': {"text": "' || text || '"} end ' || doc_id) AS digest FROM documents""")
def render_prompt(spark, sf):
    text = C.render_prompt('Target {{id}} in {{lang}}: {"text": "{{snapshot_json}}"} end {{id}}', {"id": "doc_id", "lang": "lang", "snapshot_json": "text"})
    return table(spark, sf, "documents").select("doc_id", F.md5(text.cast("binary")).alias("digest"))


@query("prj23_instruction_rows", r"""
    SELECT d.doc_id, md5('Predict fitness for sequence: ' || text || '\nAnswer:') AS digest, CAST(quality AS VARCHAR) AS labels FROM documents d JOIN labels USING (doc_id)""")
def instruction_rows(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lab, "doc_id").select("doc_id", F.md5(C.instruction_text("text").cast("binary")).alias("digest"), F.col("quality").cast("string").alias("labels"))


@query("prj24_binarize_scores", """
    WITH s AS (SELECT l_suppkey AS g, l_linenumber AS i, CAST(l_quantity % 7 AS INT) + 1 AS j, l_discount AS score FROM lineitem)
    SELECT g, least(i, j) AS i, greatest(i, j) AS j, round(sum(score) / 2, 6) + 0.0 AS score, CASE WHEN sum(score) / 2 >= 0.3 THEN 1 ELSE 0 END AS contact FROM s WHERE i <> j GROUP BY 1, 2, 3""")
def binarize_scores(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("i"), (F.pmod("l_quantity", F.lit(7)).cast("int") + 1).alias("j"), F.col("l_discount").alias("score"))
    return cleaning.binarize_scores(li, ["g"], 0.3).withColumn("score", r6("score"))


@query("prj25_apply_mapping", """
    SELECT CAST(s_suppkey AS VARCHAR) AS protein_id, 'A' AS chain_id, s_nationkey - 1 AS pos, s_name AS wt, NULL::VARCHAR AS mut, NULL::VARCHAR AS distal, 'survey' AS evidence, 1.0::DOUBLE AS weight FROM supplier""")
def mapping(spark, sf):
    return apply_mapping(table(spark, sf, "supplier"), {
        "protein_id": "s_suppkey", "chain_id": "chain", "default_chain": "A", "residue_index": "s_nationkey", "indexing": "1-based",
        "wt_col": "s_name", "mut_col": "none", "evidence_source": "survey", "default_weight": 1.0})


@query("prj26_fuse_logits", """
    SELECT l_orderkey, round(CASE WHEN l_returnflag = 'N' THEN l_discount ELSE 0.7 * l_discount + 0.3 * l_tax END, 6) + 0.0 AS fused, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS parts FROM lineitem""")
def fuse_logits(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("b", F.when(F.col("l_returnflag") != "N", F.col("l_tax")))
    both = V.fuse_vectors(F.array("l_discount"), F.when(F.col("b").isNotNull(), F.array("b")))
    return li.select("l_orderkey", r6(V.logit_blend("l_discount", "b", 0.3)).alias("fused"), F.size(both).alias("parts"))
