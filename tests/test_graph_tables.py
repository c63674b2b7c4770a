import json
import random

import pytest
from pyspark.sql import functions as F

from support import rows
from protspark.functions.columns import render_prompt
from protspark.operators import retrieval as R
from protspark.operators import upserts as U

TARGETS = "uniprot_id string, name string, gene string, ord long"


def props(df):
    return {r["id"]: r["props"] for r in df.collect()}


def test_last_row_wins_per_property(spark):
    a = spark.createDataFrame([("P1", "old", "G1", 0), ("P2", "x", "G2", 1)], TARGETS)
    b = spark.createDataFrame([("P1", "", None, 5), ("P1", "mid", "G9", 4)], TARGETS)
    nodes = U.upsert_nodes(U.upsert_nodes(U.empty_nodes(spark), a, "Protein"), b, "Protein")
    assert props(nodes) == {"Protein:P1": {"uniprot_id": "P1", "name": ""}, "Protein:P2": {"uniprot_id": "P2", "name": "x", "gene": "G2"}}
    again = U.upsert_nodes(nodes, b, "Protein")
    assert props(again) == props(nodes)


def test_upsert_does_not_depend_on_row_order(spark):
    data = [(f"P{k % 5}", f"n{k}", None if k % 3 else f"g{k}", k) for k in range(40)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(data)
        got = props(U.upsert_nodes(U.empty_nodes(spark), spark.createDataFrame(data, TARGETS).repartition(5), "Protein"))
        want = want or got
        assert got == want


def world(spark):
    nodes = U.upsert_nodes(U.empty_nodes(spark), spark.createDataFrame([("P1", "kinase", "K", 0)], TARGETS), "Protein")
    return U.upsert_nodes(nodes, spark.createDataFrame([("L1", 0), ("L2", 1)], "ligand_id string, ord long"), "Ligand")


def test_assays_need_both_partners(spark):
    batch = spark.createDataFrame([("", "L1", "P1", "Ki", "5.0", 0), ("a2", "L1", "P1", "IC50", "35", 1), ("a3", "L9", "P1", "Ki", "1", 2)],
                                  "assay_id string, ligand_id string, uniprot_id string, metric string, value string, ord long")
    nodes, edges = U.upsert_assays(world(spark), U.empty_edges(spark), batch)
    e = {(r["type"], r["dst"]): r["props"] for r in edges.collect()}
    assert e[("BINDS", "Protein:P1")] == {"metric": "IC50", "value": "35"}
    assert set(e) == {("BINDS", "Protein:P1"), ("TARGETS", "Protein:P1"), ("HAS_ASSAY", "AssayResult:assay:P1:L1:Ki"), ("HAS_ASSAY", "AssayResult:a2")}
    _, by_assay = U.upsert_assays(world(spark), U.empty_edges(spark), batch, key_by_assay=True)
    assert by_assay.where("type = 'BINDS'").count() == 2


def test_structures_always_make_a_node(spark):
    batch = spark.createDataFrame([("pdb_6AL4", "P1", " ", "x/6AL4.pdb", 0), ("", "P7", "L2", "", 1)], "model_id string, uniprot_id string, ligand_id string, pdb_path string, ord long")
    nodes, edges = U.upsert_structures(world(spark), U.empty_edges(spark), batch)
    made = {i: p for i, p in props(nodes).items() if i.startswith("Structure")}
    assert made["Structure:pdb_6AL4"]["pdb_id"] == "6AL4" and "Structure:structure:P7:L2" in made
    assert rows(edges, "src", "dst") == [("Ligand:L2", "Structure:structure:P7:L2"), ("Protein:P1", "Structure:pdb_6AL4")]


def contact_world(spark):
    batch = spark.createDataFrame([("P1", "A", 1, "M", 2, "K", 1.0, 5.0, "m1", "intra", 0), ("P1", "A", 1, "M", 2, "K", 0.0, 9.0, "m2", "intra", 1),
                                   ("P1", "A", 2, "R", 3, "T", 0.5, 0.0, "m2", None, 2), ("", "A", 7, "R", 8, "T", 0.5, 6.0, "m2", "x", 3)],
                                  "uniprot_id string, chain string, i int, aa_i string, j int, aa_j string, w double, dist double, model_id string, contact_type string, ord long")
    return U.upsert_contacts(U.empty_nodes(spark), U.empty_edges(spark), batch)


def test_contacts_collapse_and_aa_last_wins(spark):
    nodes, edges = contact_world(spark)
    p = props(nodes)
    assert p["Residue:P1:2"]["aa"] == "R" and len(p) == 4
    c = {(r["src"], r["dst"]): r["props"] for r in edges.where("type = 'CONTACTS'").collect()}
    assert c[("Residue:P1:1", "Residue:P1:2")]["model_id"] == "m2" and len(c) == 2
    assert c[("Residue:P1:2", "Residue:P1:3")]["contact_type"] == ""


def test_zero_weight_counts_as_missing(spark):
    _, edges = contact_world(spark)
    best = R.cap_edges(edges, 1).where("type = 'CONTACTS'").first()
    assert best["src"] == "Residue:P1:1"  # weight 0 acts as 1
    assert R.cap_edges(edges, 1).where("type = 'HAS_RESIDUE'").count() == 3


def test_prune_keeps_others_and_packs(spark):
    nodes, edges = contact_world(spark)
    kept, inner = R.prune_by_degree(nodes, edges, max_nodes=2)
    assert rows(kept, "id") == [("Protein:P1",), ("Residue:P1:2",)]
    assert rows(inner, "type") == [("HAS_RESIDUE",)]
    short, renamed = R.short_ids(kept, inner)
    assert rows(short, "id") == [("n0",), ("n1",)] and rows(renamed, "src", "dst") == [("n0", "n1")]
    doc = json.loads(R.pack_snapshot(R.slim_props(short), renamed, query="q", k=5).first()[0])
    assert doc["query"] == "q" and [n["id"] for n in doc["nodes"]] == ["n0", "n1"] and doc["edges"][0]["dst"] == "n1"


def test_structure_subgraph(spark):
    nodes, edges = contact_world(spark)
    sub, e = R.structure_subgraph(nodes, edges, "P1", "m2", max_residues=2)
    assert rows(sub, "id") == [("Protein:P1",), ("Residue:P1:1",), ("Residue:P1:2",)]
    assert rows(e, "src", "dst") == [("Residue:P1:1", "Residue:P1:2")]
    none, _ = R.structure_subgraph(nodes, edges, "nobody", "m2")
    assert none.count() == 0


def test_seed_expand_khop(spark):
    nodes, edges = contact_world(spark)
    found = R.seed_nodes(nodes, "p1:3  nothing")
    assert found.count() == 0  # residue_uid is not searched
    seeds = nodes.where("id = 'Residue:P1:1'")
    n, e = R.expand(nodes, edges, seeds)
    assert rows(n, "id") == [("Protein:P1",), ("Residue:P1:1",), ("Residue:P1:2",)] and e.count() == 2
    assert rows(R.khop(edges, seeds, 5, ["CONTACTS"])) == [("Residue:P1:1", 0), ("Residue:P1:2", 1), ("Residue:P1:3", 2)]


def test_slim_keeps_all_keys_unless_asked(spark):
    df = spark.createDataFrame([("x", ["Paper"], {f"k{n:02d}": "v" for n in range(40)})], "id string, labels array<string>, props map<string,string>")
    assert len(R.slim_props(df).first()["props"]) == 40
    assert sorted(R.slim_props(df, others=25).first()["props"]) == [f"k{n:02d}" for n in range(25)]


def test_checks(spark):
    nodes, edges = contact_world(spark)
    assert U.check_unique(nodes).count() == 0 and U.check_endpoints(nodes, edges).count() == 0
    bad = edges.withColumn("type", F.lit("BINDS"))
    assert {r["reason"] for r in U.check_endpoints(nodes, bad).collect()} == {"source"}


def test_candidates(spark):
    assays = spark.createDataFrame([("L1", "P", "Ki", 5.0, "nM"), ("L1", "P", "IC50", 3.0, "nM"), ("L2", "P", "Ki", 3.0, "nM")], "ligand_id string, uniprot_id string, metric string, value double, units string")
    tox = spark.createDataFrame([("L1", "hERG", "high"), ("L1", "hERG", "high")], "ligand_id string, flag string, severity string")
    got = R.rank_candidates(assays, tox).orderBy("rank").collect()
    assert [(r["ligand_id"], r["risks"], r["why"][0]) for r in got] == [("L2", [], "Ki 3.0 nM"), ("L1", ["hERG:high"], "IC50 3.0 nM")]
    assert R.rank_candidates(assays, tox, ["P"], top=1).count() == 1


def test_prompt_placeholder_must_exist(spark):
    with pytest.raises(KeyError, match="target"):
        render_prompt("x {{target}}", {"other": "a"})


def test_big_snapshot_is_cut(spark):
    node = F.struct(F.lit("n" * 50).alias("id"))
    df = spark.range(1).select(F.lit("q").alias("query"), F.array_repeat(node, 9).alias("nodes"), F.array_repeat(node, 9).alias("edges"))
    small = json.loads(df.select(R.cap_snapshot_json(df, limit=100, max_nodes=2, max_edges=3)).first()[0])
    assert len(small["nodes"]) == 2 and len(small["edges"]) == 3
