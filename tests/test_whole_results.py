"""Results are whole by default: no cap that the caller did not ask for."""

import json

from pyspark.sql import functions as F

from protspark.operators import alignments as A
from protspark.operators import retrieval as R
from protspark.operators import topk as T


def test_usable_hits_come_before_the_cap(spark):
    hits = spark.createDataFrame([("q", k, f"{1000 + k}_A") for k in range(30)], "query_id string, ord int, subject string")
    have = spark.createDataFrame([(str(1000 + k),) for k in range(10, 30)], "code string")
    assert A.usable_hits(hits, have).count() == 20
    assert sorted(r.ord for r in A.usable_hits(hits, have, 8).collect()) == list(range(10, 18))
    assert A.usable_hits(hits, have, first=8).count() == 0


def test_large_graphs_keep_all(spark):
    props = F.create_map(F.lit("model_id"), F.lit("m"), F.lit("pos"), F.col("id").cast("string"))
    nodes = spark.range(2_000).select(F.concat(F.lit("r"), "id").alias("id"), F.array(F.lit("Residue")).alias("labels"), props.alias("props"))
    edges = spark.range(1_999).select(F.concat(F.lit("r"), "id").alias("src"), F.concat(F.lit("r"), F.col("id") + 1).alias("dst"), F.lit("CONTACTS").alias("type"), props.alias("props"))
    owns = nodes.select(F.lit("Protein:P").alias("src"), F.col("id").alias("dst"), F.lit("HAS_RESIDUE").alias("type"), "props")
    head = spark.range(1).select(F.lit("Protein:P").alias("id"), F.array(F.lit("Protein")).alias("labels"), props.alias("props"))
    n, e = R.structure_subgraph(nodes.union(head), edges.union(owns), "P", "m")
    assert (n.count(), e.count()) == (2_001, 1_999)
    kept, inner = R.prune_by_degree(nodes, edges)
    assert (kept.count(), inner.count(), R.cap_edges(edges).count()) == (2_000, 1_999, 1_999)
    df = R.snapshot(nodes, edges, query="q")
    whole = json.loads(df.select(R.cap_snapshot_json(df)).first()[0])
    assert (len(whole["nodes"]), len(whole["edges"])) == (2_000, 1_999)


def test_all_top_hits(spark):
    h = spark.range(40).select(F.lit("q").alias("query"), F.concat(F.lit("s"), "id").alias("subject"), F.col("id").cast("int").alias("ord"), F.lit(0.1).alias("evalue"), F.lit(1.0).alias("bits"))
    assert sorted(r["rank"] for r in T.top_hits(h).collect()) == list(range(1, 41))
