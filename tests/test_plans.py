"""Joins that must not send a table of the size of the result to the driver."""

from protspark.operators import variants as V


def test_scans_are_not_broadcast(spark, tmp_path):
    """A scan has 19 rows a letter; Spark's estimate is that of its sequences."""
    spark.createDataFrame([(1, "ACD"), (2, "WY")], "graph_id long, seq string").write.parquet(f"{tmp_path}/seqs")
    seqs = spark.read.parquet(f"{tmp_path}/seqs")
    scan = V.scan_space(seqs, with_sequences=False)
    scores = scan.selectExpr("graph_id", "pos", "mut", "1D AS A_hat", "0.5D AS ddG_hat")
    out = V.scan_rewards(scan, scores, seqs.selectExpr("graph_id", "0.5D AS A0"))
    joins = [line for line in out._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in line and "pos#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins), joins
    assert out.count() == 19 * 5


def test_stored_edges_are_read_not_built_again(spark):
    """Building the edges is two shuffles; weights and potentials need them several times."""
    from protspark.plans import residue_graph_queries as Q

    for query in (Q.normalize_weights, Q.potentials):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan


def test_pairs_bring_their_vectors_and_meet_no_table(spark):
    """Pairs grow with the square of a label's points; joining vectors to them shuffled each pair twice."""
    from protspark.plans import projections

    plan = projections.pair_features(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.split("\n") if "Join" in line)
    assert "_salt" in top, top
