"""Chain order by file, several labels of a node, repeated batches, weights that are no lengths, and curves with billions of
rows per score."""

import pytest

from protspark.operators.centrality import betweenness, closeness
from protspark.operators.evaluation import average_precision, roc_auc
from protspark.operators.upserts import empty_edges, empty_nodes, upsert_assays, upsert_contacts, upsert_nodes
from protspark.sources.structures import choose_chain


def test_a_batch_applied_twice_adds_nothing(spark):
    contacts = spark.createDataFrame(
        [("P", 1, 2, "A", "G", 5.0, 1.0, "A", m, "cb", k) for k, m in enumerate(["m1", "m2"])],
        "uniprot_id string, i int, j int, aa_i string, aa_j string, dist double, w double, chain string, model_id string, contact_type string, ord long")
    nodes, edges = empty_nodes(spark), empty_edges(spark)
    for _ in range(2):
        nodes, edges = upsert_contacts(nodes, edges, contacts, key_by_model=True)
        assert sorted(r.props["model_id"] for r in edges.where("type = 'CONTACTS'").collect()) == ["m1", "m2"]
    nodes = spark.createDataFrame([("Protein:P", ["Protein"], {"uniprot_id": "P"}), ("Ligand:L", ["Ligand"], {"ligand_id": "L"})],
                                  "id string, labels array<string>, props map<string,string>")
    assays = spark.createDataFrame([(a, "P", "L", "Kd", "nM", 1.0, "s", 2000, k) for k, a in enumerate(["a1", "a2"])],
                                   "assay_id string, uniprot_id string, ligand_id string, metric string, units string, value double, source string, year int, ord long")
    edges = empty_edges(spark)
    for _ in range(2):
        nodes, edges = upsert_assays(nodes, edges, assays, key_by_assay=True)
        assert sorted(r.props["assay_id"] for r in edges.where("type = 'BINDS'").collect()) == ["a1", "a2"]


def test_edges_without_a_positive_length_are_left_out(spark):
    schema = "graph_id string, i int, j int, w double"
    good = [("g", 0, 1, 1.0), ("g", 1, 2, 1.0), ("g", 2, 3, 1.0)]
    bad = [("g", 0, 2, 0.0), ("g", 1, 3, None), ("g", 0, 3, -1.0), ("g", 0, 3, float("nan"))]
    clean, dirty = spark.createDataFrame(good, schema), spark.createDataFrame(good + bad, schema)
    for f in (betweenness, closeness):
        assert sorted(f(dirty, weight="w").collect()) == sorted(f(clean, weight="w").collect())
    tiny = spark.createDataFrame([("g", 0, 1, 1e30), ("g", 1, 2, 1e-30)], schema)
    with pytest.raises(ValueError):
        betweenness(tiny, weight="w")


def test_first_chain_is_the_first_in_the_file(spark):
    df = spark.createDataFrame([("m", "B", 0, 1), ("m", "A", 0, 5), ("m", "A", 1, 6)], "model_id string, chain string, idx int, ord long")
    assert {r.chain for r in choose_chain(df, "first").collect()} == {"B"}
    assert {r.chain for r in choose_chain(df, "requested", requested="Z").collect()} == {"B"}
    assert {r.chain for r in choose_chain(df, "longest").collect()} == {"A"}


def test_a_node_keeps_its_labels(spark):
    old = spark.createDataFrame([("Protein:P1", ["Protein", "Antibody"], {"name": "x"})], "id string, labels array<string>, props map<string,string>")
    batch = spark.createDataFrame([("P1", "y", 0)], "uniprot_id string, name string, ord long")
    out = upsert_nodes(old, batch, "Protein", key="uniprot_id").collect()
    row = [r for r in out if "Antibody" in r.labels]
    assert len(row) == 1 and set(row[0].labels) == {"Protein", "Antibody"}


def test_curves_beyond_longs(spark):
    curve = spark.createDataFrame([(0.9, 5 * 10**9, 4 * 10**9, 4 * 10**9, 5 * 10**9), (0.1, 5 * 10**9, 10**9, 5 * 10**9, 10**10)],
                                  "score double, n long, pos long, tp long, seen long")
    assert abs(roc_auc(None, "score", "label", curve=curve).first()["auc"] - 0.8) < 1e-9
    assert abs(average_precision(None, "score", "label", curve=curve).first()["ap"] - (0.8 * 0.8 + 0.2 * 0.5)) < 1e-9
