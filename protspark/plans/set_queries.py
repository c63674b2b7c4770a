"""Set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from protspark.operators import retrieval, sets
from protspark.plans.registry import query, table
from protspark.plans.retrieval_queries import trade_graph


@query("set01_union_ids", "SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier")
def union_ids(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return sets.union_ids(c.select(F.col("c_nationkey").alias("id")), s.select("s_nationkey"))


@query("set01_concat_nodes", "SELECT c_nationkey AS id, c_name AS name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier")
def concat_nodes(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return sets.concat_nodes(c.select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name")), s.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("id")))


@query("set02_restrict_edges", """
    SELECT 'Customer:' || o_custkey AS src, 'Order:' || o_orderkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'""")
def restrict_edges(spark, sf):
    nodes, edges = trade_graph(spark, sf)
    kept = nodes.where(F.col("props")["title"].isin("BUILDING", "F"))
    return retrieval.restrict_edges(edges, kept).select("src", "dst")


@query("set02_common", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def common(spark, sf):
    return sets.common(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("set03_minus", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def minus(spark, sf):
    return sets.minus(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("set04_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, sf):
    return sets.distinct_values(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
