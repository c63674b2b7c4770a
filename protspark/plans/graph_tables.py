"""Keyed upserts: the given tables as a property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from protspark.operators import upserts as U
from protspark.plans.registry import ORACLES, query, table


def proteins(spark, sf):
    """Parts as proteins."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("uniprot_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("family"), F.col("p_type").alias("organism"), F.lit(0).alias("ord"))


def ligands(spark, sf):
    """Suppliers as ligands."""
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("ligand_id"), F.col("s_name").alias("name"), F.lit(0).alias("ord"))


def prop(name: str):
    return F.col("props")[name].alias(name)


@query("ups01_upsert_nodes", """
    WITH last AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
    SELECT 'Ligand:' || c_custkey AS id, c_name AS name, CASE WHEN rn IS NULL THEN c_mktsegment WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS scaffold_id,
        CASE WHEN rn IS NULL THEN 'base' WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS source
    FROM customer LEFT JOIN last ON o_custkey = c_custkey AND rn = 1""")
def upsert_nodes(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    base = c.select(F.col("c_custkey").alias("ligand_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("scaffold_id"), F.lit("base").alias("source"), F.lit(0).alias("ord"))
    batch = o.select(F.col("o_custkey").alias("ligand_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("scaffold_id"),
                     F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("source"), F.col("o_orderkey").alias("ord"))
    nodes = U.upsert_nodes(U.upsert_nodes(U.empty_nodes(spark), base, "Ligand"), batch, "Ligand")
    return nodes.select("id", prop("name"), prop("scaffold_id"), prop("source"))


CONTACT_SQL = """rows AS (SELECT o_orderkey AS ord, o_custkey AS uniprot_id, month(o_orderdate) AS i, month(o_orderdate) + length(o_orderpriority) AS j,
    o_orderstatus AS aa_i, substr(o_orderpriority, 1, 1) AS aa_j, o_totalprice AS dist, CAST(o_orderkey % 3 AS VARCHAR) AS model_id FROM orders)"""


def contact_batch(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").cast("string").alias("uniprot_id"), F.lit("A").alias("chain"), F.month("o_orderdate").alias("i"),
                    F.col("o_orderstatus").alias("aa_i"), (F.month("o_orderdate") + F.length("o_orderpriority")).alias("j"), F.substring("o_orderpriority", 1, 1).alias("aa_j"),
                    F.lit(1.0).alias("w"), F.col("o_totalprice").alias("dist"), F.pmod("o_orderkey", F.lit(3)).cast("string").alias("model_id"), F.lit("intra").alias("contact_type"))


@query("ups02_upsert_contacts_edges", f"""
    WITH {CONTACT_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY uniprot_id, i, j ORDER BY ord DESC) AS rn FROM rows)
    SELECT 'CONTACTS' AS type, 'Residue:' || uniprot_id || ':' || i AS src, 'Residue:' || uniprot_id || ':' || j AS dst, dist, model_id FROM best WHERE rn = 1
    UNION ALL SELECT DISTINCT 'HAS_RESIDUE', 'Protein:' || uniprot_id, 'Residue:' || uniprot_id || ':' || p, NULL::DOUBLE, NULL
    FROM (SELECT uniprot_id, i AS p FROM rows UNION ALL SELECT uniprot_id, j FROM rows)""")
def contact_edges(spark, sf):
    _, edges = U.upsert_contacts(U.empty_nodes(spark), U.empty_edges(spark), contact_batch(spark, sf))
    return edges.select("type", "src", "dst", F.col("props")["dist"].cast("double").alias("dist"), prop("model_id"))


@query("ups02_upsert_contacts_nodes", f"""
    WITH {CONTACT_SQL}, ends AS (SELECT uniprot_id, i AS pos, aa_i AS aa, ord * 2 AS o FROM rows UNION ALL SELECT uniprot_id, j, aa_j, ord * 2 + 1 FROM rows)
    SELECT 'Residue:' || uniprot_id || ':' || pos AS id, CAST(pos AS VARCHAR) AS pos, arg_max(aa, o) AS aa FROM ends GROUP BY uniprot_id, pos
    UNION ALL SELECT DISTINCT 'Protein:' || uniprot_id, NULL, NULL FROM rows""")
def contact_nodes(spark, sf):
    nodes, _ = U.upsert_contacts(U.empty_nodes(spark), U.empty_edges(spark), contact_batch(spark, sf))
    return nodes.select("id", prop("pos"), prop("aa"))


@query("ups02_upsert_contacts_by_model", f"""
    WITH {CONTACT_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY uniprot_id, i, j, model_id ORDER BY ord DESC) AS rn FROM rows)
    SELECT 'Residue:' || uniprot_id || ':' || i AS src, 'Residue:' || uniprot_id || ':' || j AS dst, dist, model_id FROM best WHERE rn = 1""")
def contact_edges_by_model(spark, sf):
    _, edges = U.upsert_contacts(U.empty_nodes(spark), U.empty_edges(spark), contact_batch(spark, sf), key_by_model=True)
    return edges.where(F.col("type") == "CONTACTS").select("src", "dst", F.col("props")["dist"].cast("double").alias("dist"), prop("model_id"))


@query("ups03_upsert_assays", """
    WITH rows AS (SELECT o_orderkey AS ord, o_custkey AS p, o_custkey % 150 AS l, o_orderstatus AS metric, o_totalprice AS value,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'assay:' || o_custkey || ':' || (o_custkey % 150) || ':' || o_orderstatus ELSE CAST(o_orderkey AS VARCHAR) END AS a FROM orders),
    linked AS (SELECT rows.* FROM rows JOIN part ON p_partkey = p JOIN supplier ON s_suppkey = l),
    best AS (SELECT *, row_number() OVER (PARTITION BY l, p ORDER BY ord DESC) AS rn FROM linked)
    SELECT 'BINDS' AS type, 'Ligand:' || l AS src, 'Protein:' || p AS dst, metric, value FROM best WHERE rn = 1
    UNION ALL SELECT DISTINCT 'TARGETS', 'Ligand:' || l, 'Protein:' || p, NULL, NULL FROM linked
    UNION ALL SELECT DISTINCT 'HAS_ASSAY', 'Ligand:' || l, 'AssayResult:' || a, NULL, NULL FROM linked""")
def upsert_assays(spark, sf):
    _, edges = U.upsert_assays(partners(spark, sf), U.empty_edges(spark), assay_batch(spark, sf))
    return edges.select("type", "src", "dst", prop("metric"), F.col("props")["value"].cast("double").alias("value"))


def partners(spark, sf):
    return U.upsert_nodes(U.upsert_nodes(U.empty_nodes(spark), proteins(spark, sf), "Protein"), ligands(spark, sf), "Ligand")


def assay_batch(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey").cast("string")).otherwise("").alias("assay_id"),
                     F.col("o_custkey").cast("string").alias("uniprot_id"), F.pmod("o_custkey", F.lit(150)).cast("string").alias("ligand_id"), F.col("o_orderstatus").alias("metric"), F.col("o_totalprice").alias("value"))


@query("ups03_assays_applied_twice", ORACLES["ups03_upsert_assays"])
def assays_twice(spark, sf):
    """A batch applied again changes nothing."""
    nodes, edges = partners(spark, sf), U.empty_edges(spark)
    for _ in range(2):
        nodes, edges = U.upsert_assays(nodes, edges, assay_batch(spark, sf))
    return edges.select("type", "src", "dst", prop("metric"), F.col("props")["value"].cast("double").alias("value"))


@query("ups02_contacts_applied_twice", ORACLES["ups02_upsert_contacts_edges"])
def contacts_twice(spark, sf):
    """A batch applied again changes nothing."""
    nodes, edges = U.empty_nodes(spark), U.empty_edges(spark)
    for _ in range(2):
        nodes, edges = U.upsert_contacts(nodes, edges, contact_batch(spark, sf))
    return edges.select("type", "src", "dst", F.col("props")["dist"].cast("double").alias("dist"), prop("model_id"))


@query("ups04_upsert_toxicity", """
    SELECT 'Ligand:' || doc_id AS src, 'ToxicityEvent:tox:' || doc_id || ':' || CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS dst
    FROM labels JOIN documents USING (doc_id) WHERE lang = 'en'""")
def upsert_toxicity(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    nodes = U.upsert_nodes(U.empty_nodes(spark), d.where("lang = 'en'").select(F.col("doc_id").alias("ligand_id"), F.lit(0).alias("ord")), "Ligand")
    batch = lab.select(F.col("doc_id").alias("ord"), F.lit("").alias("tox_id"), F.col("doc_id").cast("string").alias("ligand_id"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("flag"))
    _, edges = U.upsert_toxicity(nodes, U.empty_edges(spark), batch)
    return edges.select("src", "dst")


@query("ups05_upsert_structures", """
    WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE CAST(o_orderkey % 150 AS VARCHAR) END AS l,
        CASE WHEN o_orderstatus = 'F' THEN 'structure:' || o_custkey || ':' || (o_orderkey % 150) ELSE CAST(o_orderkey AS VARCHAR) END AS s FROM orders)
    SELECT DISTINCT 'Protein:' || o_custkey AS src, 'Structure:' || s AS dst FROM r JOIN part ON p_partkey = o_custkey
    UNION SELECT DISTINCT 'Ligand:' || l, 'Structure:' || s FROM r JOIN supplier ON CAST(s_suppkey AS VARCHAR) = l
    UNION SELECT DISTINCT 'node', 'Structure:' || s FROM r""")
def upsert_structures(spark, sf):
    nodes = U.upsert_nodes(U.upsert_nodes(U.empty_nodes(spark), proteins(spark, sf), "Protein"), ligands(spark, sf), "Ligand")
    o = table(spark, sf, "orders")
    batch = o.select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey").cast("string")).otherwise("").alias("model_id"),
                     F.col("o_custkey").cast("string").alias("uniprot_id"),
                     F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.pmod("o_orderkey", F.lit(150)).cast("string")).alias("ligand_id"), F.lit("/x/a.pdb").alias("pdb_path"))
    all_nodes, edges = U.upsert_structures(nodes, U.empty_edges(spark), batch)
    made = all_nodes.where(F.array_contains("labels", "Structure")).select(F.lit("node").alias("src"), F.col("id").alias("dst"))
    return edges.select("src", "dst").union(made)


@query("ups06_check_unique", """
    SELECT 'Protein' AS label, c_nationkey || '-' || c_mktsegment AS key, count(*) AS n FROM customer GROUP BY 2 HAVING count(*) > 1""")
def check_unique(spark, sf):
    c = table(spark, sf, "customer")
    nodes = c.select(F.concat(F.lit("Protein:"), "c_custkey").alias("id"), F.array(F.lit("Protein")).alias("labels"),
                     F.create_map(F.lit("uniprot_id"), F.concat_ws("-", "c_nationkey", "c_mktsegment")).alias("props"))
    return U.check_unique(nodes)


@query("ups07_check_endpoints", """
    SELECT 'Ligand:' || l_suppkey AS src, 'Protein:' || l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'BINDS' WHEN 'R' THEN 'HAS_ASSAY' ELSE 'LIKES' END AS type,
        CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 'unknown type' WHEN s_suppkey IS NULL THEN 'source' ELSE 'target' END AS reason
    FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10
    WHERE l_returnflag <> 'A' OR s_suppkey IS NULL OR p_partkey IS NULL""")
def check_endpoints(spark, sf):
    s, p, li = table(spark, sf, "supplier"), table(spark, sf, "part"), table(spark, sf, "lineitem")
    nodes = (s.where("s_acctbal > 0").select(F.concat(F.lit("Ligand:"), "s_suppkey").alias("id"), F.array(F.lit("Ligand")).alias("labels"))
             .union(p.where("p_size > 10").select(F.concat(F.lit("Protein:"), "p_partkey"), F.array(F.lit("Protein")))))
    kind = F.when(F.col("l_returnflag") == "A", "BINDS").when(F.col("l_returnflag") == "R", "HAS_ASSAY").otherwise("LIKES")
    edges = li.select(F.concat(F.lit("Ligand:"), "l_suppkey").alias("src"), F.concat(F.lit("Protein:"), "l_partkey").alias("dst"), kind.alias("type"))
    return U.check_endpoints(nodes, edges)
