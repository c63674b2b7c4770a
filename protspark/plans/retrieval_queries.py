"""Search, expansion, pruning and ranking on the given tables as a graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from protspark.operators import retrieval as R
from protspark.plans.registry import query, r6, table


def _node(df, label: str, key: str, **props):
    entries = [x for k, c in props.items() for x in (F.lit(k), F.col(c).cast("string"))]
    return df.select(F.concat(F.lit(f"{label}:"), key).alias("id"), F.array(F.lit(label)).alias("labels"), F.create_map(*entries).alias("props"))


def _edge(df, src_label, src, dst_label, dst, kind, **props):
    entries = [x for k, c in props.items() for x in (F.lit(k), F.col(c).cast("string"))]
    made = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return df.select(F.concat(F.lit(f"{src_label}:"), src).alias("src"), F.concat(F.lit(f"{dst_label}:"), dst).alias("dst"), F.lit(kind).alias("type"), made.alias("props"))


def trade_graph(spark, sf):
    """Regions, nations, customers, orders; suppliers under nations."""
    t = lambda n: table(spark, sf, n)
    nodes = (_node(t("region"), "Region", "r_regionkey", name="r_name").unionByName(_node(t("nation"), "Nation", "n_nationkey", name="n_name"))
             .unionByName(_node(t("customer"), "Customer", "c_custkey", name="c_name", title="c_mktsegment")).unionByName(_node(t("orders"), "Order", "o_orderkey", title="o_orderstatus"))
             .unionByName(_node(t("supplier"), "Supplier", "s_suppkey", name="s_name")))
    edges = (_edge(t("nation"), "Nation", "n_nationkey", "Region", "n_regionkey", "IN").unionByName(_edge(t("customer"), "Customer", "c_custkey", "Nation", "c_nationkey", "LIVES"))
             .unionByName(_edge(t("orders"), "Customer", "o_custkey", "Order", "o_orderkey", "PLACED")).unionByName(_edge(t("supplier"), "Supplier", "s_suppkey", "Nation", "s_nationkey", "SITS")))
    return nodes, edges


TRADE_SQL = """edges AS (SELECT 'Nation:' || n_nationkey AS src, 'Region:' || n_regionkey AS dst, 'IN' AS type FROM nation
    UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'LIVES' FROM customer
    UNION ALL SELECT 'Customer:' || o_custkey, 'Order:' || o_orderkey, 'PLACED' FROM orders
    UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'SITS' FROM supplier)"""


@query("ret01_seed_nodes", """
    SELECT 'Part:' || p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) LIKE '%widget%' OR lower(p_name) LIKE '%blue%' OR lower(p_type) LIKE '%widget%' OR lower(p_type) LIKE '%blue%'
    ORDER BY 'Part:' || p_partkey LIMIT 50""")
def seeds(spark, sf):
    nodes = _node(table(spark, sf, "part"), "Part", "p_partkey", name="p_name", title="p_type", brand="p_brand")
    return R.seed_nodes(nodes, "Widget  BLUE", k=50).select("id", F.col("props")["name"].alias("name"))


@query("ret01_seed_nodes_all", "SELECT 'Customer:' || c_custkey AS id FROM customer WHERE lower(c_name) LIKE '%99%' OR lower(c_mktsegment) LIKE '%mach%'")
def all_seeds(spark, sf):
    nodes, _ = trade_graph(spark, sf)
    return R.seed_nodes(nodes.where(F.array_contains("labels", "Customer")), "99 mach", k=None).select("id")


@query("ret02_expand_nodes", f"""
    WITH {TRADE_SQL}, seeds AS (SELECT 'Customer:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY')
    SELECT id FROM seeds UNION SELECT dst FROM edges JOIN seeds ON src = id UNION SELECT src FROM edges JOIN seeds ON dst = id""")
def expand_nodes(spark, sf):
    nodes, edges = trade_graph(spark, sf)
    start = nodes.where(F.col("props")["title"] == "MACHINERY")
    return R.expand(nodes, edges, start)[0].select("id")


@query("ret02_expand_edges", f"""
    WITH {TRADE_SQL}, seeds AS (SELECT 'Customer:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY')
    SELECT DISTINCT src, dst, type FROM edges WHERE src IN (SELECT id FROM seeds) OR dst IN (SELECT id FROM seeds)""")
def expand_edges(spark, sf):
    nodes, edges = trade_graph(spark, sf)
    start = nodes.where(F.col("props")["title"] == "MACHINERY")
    return R.expand(nodes, edges, start)[1].select("src", "dst", "type")


@query("ret03_khop", f"""
    WITH {TRADE_SQL}, step AS (SELECT src AS a, dst AS b FROM edges WHERE type <> 'SITS' UNION SELECT dst, src FROM edges WHERE type <> 'SITS'),
    h0 AS (SELECT 'Region:1' AS id, 0 AS hop), h1 AS (SELECT DISTINCT b AS id FROM step JOIN h0 ON a = id), v1 AS (SELECT * FROM h0 UNION ALL SELECT id, 1 FROM h1 WHERE id NOT IN (SELECT id FROM h0)),
    h2 AS (SELECT DISTINCT b AS id FROM step JOIN v1 ON a = id WHERE hop = 1), v2 AS (SELECT * FROM v1 UNION ALL SELECT id, 2 FROM h2 WHERE id NOT IN (SELECT id FROM v1)),
    h3 AS (SELECT DISTINCT b AS id FROM step JOIN v2 ON a = id WHERE hop = 2)
    SELECT id, hop FROM v2 UNION ALL SELECT id, 3 FROM h3 WHERE id NOT IN (SELECT id FROM v2)""")
def khop(spark, sf):
    nodes, edges = trade_graph(spark, sf)
    return R.khop(edges, nodes.where(F.col("id") == "Region:1"), 3, types=["IN", "LIVES", "PLACED"])


@query("ret04_paths", """
    SELECT 'Region:' || n_regionkey || '>Nation:' || n_nationkey || '>Supplier:' || s_suppkey || '>Part:' || l_partkey AS path, round(0.5 * 0.25 * l_discount, 6) + 0.0 AS score,
        round(0.75 + l_discount, 6) + 0.0 AS length
    FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey""")
def graph_paths(spark, sf):
    t = lambda n: table(spark, sf, n)
    one = lambda df, a, an, b, bn, kind, w: df.select(F.concat(F.lit(f"{an}:"), a).alias("src"), F.concat(F.lit(f"{bn}:"), b).alias("dst"), F.lit(kind).alias("type"), w.alias("weight"))
    edges = (one(t("nation"), "n_nationkey", "Nation", "n_regionkey", "Region", "IN", F.lit(0.5)).unionByName(one(t("supplier"), "s_suppkey", "Supplier", "s_nationkey", "Nation", "SITS", F.lit(0.25)))
             .unionByName(one(t("lineitem"), "l_suppkey", "Supplier", "l_partkey", "Part", "SELLS", F.col("l_discount"))))
    starts = t("region").select(F.concat(F.lit("Region:"), "r_regionkey").alias("id"))
    found = R.paths(edges, starts, [("IN", "in"), ("SITS", "in"), ("SELLS", "out")])
    return found.select(F.array_join("path", ">").alias("path"), r6("score").alias("score"), r6("length").alias("length"))


@query("ret05_rank_trim", """
    SELECT o_orderkey AS id, round(o_totalprice * 0.001 + year(o_orderdate) * 0.5, 6) + 0.0 AS score FROM orders ORDER BY o_totalprice * 0.001 + year(o_orderdate) * 0.5 DESC, o_orderkey LIMIT 100""")
def rank_trim(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("evidence"), F.year("o_orderdate").alias("recency"))
    return R.rank_trim(o, {"evidence": 0.001, "recency": 0.5}, 100).select("id", r6("score").alias("score"))


def line_graph(spark, sf):
    """Orders as structures whose lines are contacts between the residues of a supplier-protein."""
    li = table(spark, sf, "lineitem")
    own = lambda p: F.concat(F.lit("Residue:"), "l_suppkey", F.lit(":"), p)
    i, j = F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_quantity").cast("int")
    rows = li.withColumns({"i": i, "j": j})
    contact = rows.select(own("i").alias("src"), own("j").alias("dst"), F.lit("CONTACTS").alias("type"), F.create_map(
        F.lit("model_id"), F.col("l_returnflag"), F.lit("contact_type"), F.col("l_linestatus"), F.lit("w"), F.col("l_discount").cast("string"), F.lit("dist"), F.col("l_extendedprice").cast("string")).alias("props"))
    has = rows.select(F.concat(F.lit("Protein:"), "l_suppkey").alias("src"), F.explode(F.array(own("i"), own("j"))).alias("dst")).distinct().select(
        "src", "dst", F.lit("HAS_RESIDUE").alias("type"), F.create_map().cast("map<string,string>").alias("props"))
    structures = rows.select(F.concat(F.lit("Protein:"), "l_suppkey").alias("src"), F.concat(F.lit("Structure:"), "l_returnflag").alias("dst")).distinct().select(
        "src", "dst", F.lit("HAS_STRUCTURE").alias("type"), F.create_map().cast("map<string,string>").alias("props"))
    none = F.create_map().cast("map<string,string>")
    nodes = (has.select(F.col("dst").alias("id")).distinct().select("id", F.array(F.lit("Residue")).alias("labels"), F.create_map(F.lit("pos"), F.substring_index("id", ":", -1), F.lit("sasa"), F.lit("1")).alias("props"))
             .unionByName(structures.select(F.col("src").alias("id")).distinct().select("id", F.array(F.lit("Protein")).alias("labels"), F.create_map(F.lit("name"), F.col("id"), F.lit("sequence"), F.lit("MK")).alias("props")))
             .unionByName(structures.select(F.col("dst").alias("id")).distinct().select("id", F.array(F.lit("Structure")).alias("labels"), none.alias("props"))))
    return nodes, contact.unionByName(has).unionByName(structures)


LINE_SQL = """c AS (SELECT l_suppkey AS p, 'Residue:' || l_suppkey || ':' || l_linenumber AS src, 'Residue:' || l_suppkey || ':' || (l_linenumber + CAST(l_quantity AS INT)) AS dst,
    l_linenumber AS i, l_linenumber + CAST(l_quantity AS INT) AS j, l_discount AS w, l_extendedprice AS dist, l_returnflag AS model_id, l_linestatus AS contact_type FROM lineitem)"""


@query("ret06_structure_subgraph_edges", f"""
    WITH {LINE_SQL}, m AS (SELECT * FROM c WHERE p = 1 AND model_id = 'R'), r AS (SELECT DISTINCT id, pos FROM (SELECT src AS id, i AS pos FROM m UNION ALL SELECT dst, j FROM m) ORDER BY pos, id LIMIT 40)
    SELECT src, dst, w, dist FROM m WHERE src IN (SELECT id FROM r) AND dst IN (SELECT id FROM r) ORDER BY w DESC, dist, src, dst LIMIT 100""")
def subgraph_edges(spark, sf):
    nodes, edges = line_graph(spark, sf)
    _, sub = R.structure_subgraph(nodes, edges, "1", "R", max_residues=40, max_edges=100)
    return sub.where(F.col("type") == "CONTACTS").select("src", "dst", F.col("props")["w"].cast("double").alias("w"), F.col("props")["dist"].cast("double").alias("dist"))


@query("ret06_structure_subgraph_nodes", f"""
    WITH {LINE_SQL}, m AS (SELECT * FROM c WHERE p = 1 AND model_id = 'R'), r AS (SELECT DISTINCT id, pos FROM (SELECT src AS id, i AS pos FROM m UNION ALL SELECT dst, j FROM m) ORDER BY pos, id LIMIT 40)
    SELECT id, 'Residue' AS label FROM r UNION ALL SELECT 'Protein:1', 'Protein' UNION ALL SELECT 'Structure:R', 'Structure'""")
def subgraph_nodes(spark, sf):
    nodes, edges = line_graph(spark, sf)
    sub, _ = R.structure_subgraph(nodes, edges, "1", "R", max_residues=40, max_edges=100)
    return sub.select("id", F.col("labels")[0].alias("label"))


DEGREE_SQL = LINE_SQL + """, deg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM c UNION ALL SELECT dst FROM c) GROUP BY 1),
    others AS (SELECT 'Protein:' || l_suppkey AS id FROM lineitem UNION SELECT 'Structure:' || l_returnflag FROM lineitem),
    kept AS (SELECT id FROM (SELECT id FROM deg ORDER BY d DESC, id LIMIT greatest(0, 1220 - (SELECT count(*) FROM others))) UNION ALL SELECT id FROM others)"""


@query("ret07_prune_by_degree", f"WITH {DEGREE_SQL} SELECT id FROM kept")
def prune_nodes(spark, sf):
    nodes, edges = line_graph(spark, sf)
    return R.prune_by_degree(nodes, edges, max_nodes=1220)[0].select("id")


@query("ret07_prune_edges", f"""
    WITH {DEGREE_SQL} SELECT 'CONTACTS' AS type, count(*) AS n FROM c WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)
    UNION ALL SELECT 'HAS_RESIDUE', count(*) FROM (SELECT DISTINCT p, id FROM (SELECT p, src AS id FROM c UNION ALL SELECT p, dst FROM c)) WHERE id IN (SELECT id FROM kept)
    UNION ALL SELECT 'HAS_STRUCTURE', count(*) FROM (SELECT DISTINCT p, model_id FROM c)""")
def prune_edges(spark, sf):
    nodes, edges = line_graph(spark, sf)
    return R.prune_by_degree(nodes, edges, max_nodes=1220)[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("ret08_cap_edges", f"""
    WITH {LINE_SQL}, best AS (SELECT src, dst, w, dist FROM c ORDER BY CASE WHEN w = 0 THEN 1.0 ELSE w END DESC, dist, src, dst LIMIT 800)
    SELECT 'CONTACTS' AS type, src, dst, w, dist FROM best UNION ALL SELECT DISTINCT 'HAS_RESIDUE', 'Protein:' || p, id, NULL, NULL FROM (SELECT p, src AS id FROM c UNION ALL SELECT p, dst FROM c)
    UNION ALL SELECT DISTINCT 'HAS_STRUCTURE', 'Protein:' || p, 'Structure:' || model_id, NULL, NULL FROM c""")
def cap_edges(spark, sf):
    _, edges = line_graph(spark, sf)
    return R.cap_edges(edges, 800).select("type", "src", "dst", F.col("props")["w"].cast("double").alias("w"), F.col("props")["dist"].cast("double").alias("dist"))


@query("ret09_short_ids", f"""
    WITH {TRADE_SQL}, n AS (SELECT id, 'n' || (row_number() OVER (ORDER BY id) - 1) AS short FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges
        UNION SELECT 'Customer:' || c_custkey FROM customer UNION SELECT 'Region:' || r_regionkey FROM region))
    SELECT a.short AS src, b.short AS dst, type FROM edges JOIN n a ON a.id = src JOIN n b ON b.id = dst""")
def short_ids(spark, sf):
    nodes, edges = trade_graph(spark, sf)
    return R.short_ids(nodes, edges)[1].select("src", "dst", "type")


@query("ret10_slim_props", f"""
    WITH {LINE_SQL} SELECT DISTINCT id, 'pos' AS k, CAST(pos AS VARCHAR) AS v FROM (SELECT src AS id, i AS pos FROM c UNION ALL SELECT dst, j FROM c)
    UNION ALL SELECT DISTINCT 'Protein:' || p, 'name', 'Protein:' || p FROM c""")
def slim_props(spark, sf):
    nodes, _ = line_graph(spark, sf)
    return R.slim_props(nodes).select("id", F.explode("props").alias("k", "v"))


@query("ret11_pack_snapshot", f"""
    WITH {DEGREE_SQL}, e AS (SELECT * FROM c WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept) ORDER BY CASE WHEN w = 0 THEN 1.0 ELSE w END DESC, dist, src, dst LIMIT 800)
    SELECT 'graph' AS query, (SELECT count(*) FROM kept) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT min(src || dst) FROM e) AS first_edge""")
def pack_snapshot(spark, sf):
    nodes, edges = line_graph(spark, sf)
    kept, inner = R.prune_by_degree(nodes, edges, max_nodes=1220)
    capped = R.cap_edges(inner.where(F.col("type") == "CONTACTS"), 800)
    packed = R.pack_snapshot(R.slim_props(kept), capped, query="graph", k=50)
    parsed = packed.select(F.from_json("snapshot_json", "query string, k int, nodes array<struct<id:string>>, edges array<struct<src:string,dst:string>>").alias("s"))
    first = F.array_min(F.transform("s.edges", lambda e: F.concat(e["src"], e["dst"])))
    return parsed.select("s.query", F.size("s.nodes").cast("long").alias("nodes"), F.size("s.edges").cast("long").alias("edges"), first.alias("first_edge"))


@query("ret12_label_counts", """
    SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
    UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Supplier', count(*) FROM supplier""")
def label_counts(spark, sf):
    return R.label_counts(trade_graph(spark, sf)[0])


@query("ret13_contact_stats", f"WITH {LINE_SQL} SELECT model_id, contact_type, count(*) AS n FROM c GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def contact_stats(spark, sf):
    return R.contact_stats(line_graph(spark, sf)[1], 20)


@query("ret13_all_contact_stats", f"WITH {LINE_SQL} SELECT model_id, contact_type, count(*) AS n FROM c GROUP BY 1, 2")
def all_contact_stats(spark, sf):
    return R.contact_stats(line_graph(spark, sf)[1])


@query("ret14_rank_candidates", """
    WITH a AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
    t AS (SELECT l_suppkey, string_agg(DISTINCT l_returnflag || ':' || l_linestatus, ',' ORDER BY l_returnflag || ':' || l_linestatus) AS risks, count(DISTINCT l_returnflag || l_linestatus) AS k
        FROM lineitem GROUP BY 1)
    SELECT CAST(l_partkey AS VARCHAR) AS uniprot_id, CAST(a.l_suppkey AS VARCHAR) AS ligand_id, round(v, 8) + 0.0 AS best_value, n AS n_assays, coalesce(risks, '') AS risks,
        row_number() OVER (PARTITION BY l_partkey ORDER BY v, coalesce(k, 0), CAST(a.l_suppkey AS VARCHAR)) AS rank
    FROM a LEFT JOIN t ON t.l_suppkey = a.l_suppkey""")
def rank_candidates(spark, sf):
    """Flagship: suppliers per part by best unit price, with their return flags as risks."""
    li = table(spark, sf, "lineitem")
    assays = li.select(F.col("l_partkey").cast("string").alias("uniprot_id"), F.col("l_suppkey").cast("string").alias("ligand_id"), F.lit("price").alias("metric"),
                       (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"), F.lit("usd").alias("units"))
    tox = li.select(F.col("l_suppkey").cast("string").alias("ligand_id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("severity"))
    ranked = R.rank_candidates(assays, tox)
    return ranked.select("uniprot_id", "ligand_id", (F.round("best_value", 8) + F.lit(0.0)).alias("best_value"), "n_assays", F.array_join("risks", ",").alias("risks"), "rank")
