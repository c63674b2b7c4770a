import os

from pyspark.sql import functions as F

from support import rows
from protspark.operators import upserts as U
from protspark.streaming import store as S
from protspark.streaming.ingest import entity_stream, fold_log, ingest_stream


def test_late_file_does_not_win_and_restart_adds_nothing(spark, tmp_path):
    arrivals, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    os.makedirs(arrivals)
    schema = "ligand_id string, name string, ord long"

    def arrive(name, text):
        (tmp_path / "in" / name).write_text("ligand_id,name,ord\n" + text)
        ingest_stream(entity_stream(spark, arrivals, schema, 1), log, state).awaitTermination()
        return fold_log(spark, log, lambda r: U.upsert_nodes(U.empty_nodes(spark), r, "Ligand"))

    arrive("a.csv", "L1,newest,9\nL2,only,3\n")
    nodes = arrive("b.csv", "L1,older,1\n")
    ingest_stream(entity_stream(spark, arrivals, schema, 1), log, state).awaitTermination()
    assert rows(nodes, "id", F.col("props")["name"].alias("n")) == [("Ligand:L1", "newest"), ("Ligand:L2", "only")]
    assert spark.read.parquet(log).count() == 3


def test_joins_with_known_nodes_are_made_once(spark, tmp_path):
    """No semi join is left that the optimizer moves into each part of a union, and a bucket is written by several tasks."""
    batch = spark.range(40).selectExpr("id ord", "string(id) assay_id", "string(id % 7) uniprot_id", "string(id % 5) ligand_id", "'m' metric", "1.0 value")
    nodes = [spark.range(n).selectExpr(f"string(id) {key}", "0 ord") for n, key in ((6, "uniprot_id"), (4, "ligand_id"))]
    store = S.GraphStore(spark, str(tmp_path / "graph"), buckets=1)
    for k in range(2):
        store.append(*U.assay_changes(batch.where(f"ord % 2 = {k}")), k, "assays")
    for feed, (df, label) in zip("pl", zip(nodes, ("Protein", "Ligand"))):
        store.append(*U.node_changes(df, label), 0, feed)
    edges = store.edges()
    whole = U.upsert_nodes(U.upsert_nodes(U.empty_nodes(spark), nodes[0], "Protein"), nodes[1], "Ligand")
    _, at_once = U.upsert_assays(whole, U.empty_edges(spark), batch)
    key = lambda df: sorted((r.src, r.dst, r.type, str(r.props)) for r in df.collect())
    assert key(edges) == key(at_once) and edges.count() > 0
    rows = batch.selectExpr("ord", "assay_id model_id", "uniprot_id", "ligand_id", "'/x/a.pdb' pdb_path")
    _, linked = U.upsert_structures(whole, U.empty_edges(spark), rows)
    assert linked.count() == 40 * 2 - 5 - 8
    for df in (edges, linked):
        assert "LeftSemi" not in df._jdf.queryExecution().optimizedPlan().toString()
