import json

from pyspark.sql import functions as F

from support import rows
from protspark.functions.lineage import cut
from protspark.operators import upserts as U
from protspark.operators.workflows import contact_rows, question_prompt

LINE = "ATOM  {n:>5}  CA  {res} {chain}{num:>4}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           C\n"


def test_structures_to_graph_to_prompt(spark, tmp_path):
    chain = [("MET", 0.0), ("LYS", 5.0), ("THR", 9.0), ("TYR", 40.0)]
    text = "".join(LINE.format(n=k, res=r, chain="A", num=10 + k, x=x, y=0.0, z=0.0) for k, (r, x) in enumerate(chain))
    (tmp_path / "m1.pdb").write_text(text + LINE.format(n=9, res="GLY", chain="B", num=1, x=1.0, y=0.0, z=0.0))
    structures = spark.createDataFrame([("m1", "P1")], "model_id string, uniprot_id string")
    known = spark.createDataFrame([("P1", "GGMKTY")], "uniprot_id string, sequence string")
    blank = spark.createDataFrame([("P1", " ")], known.schema)
    assert rows(contact_rows(spark, str(tmp_path), structures, known), "i", "aa_i", "j", "aa_j", "dist") == [(3, "M", 4, "K", 5.0), (4, "K", 5, "T", 4.0)]
    plain = contact_rows(spark, str(tmp_path), structures, blank)
    assert rows(plain, "i", "j") == [(1, 2), (2, 3)]
    nodes, edges = U.upsert_contacts(U.empty_nodes(spark), U.empty_edges(spark), plain.withColumn("ord", F.lit(0)))
    out = question_prompt(cut(nodes), cut(edges), "p1", "Q: {{question}} G: {{snapshot_json}}").first()
    doc = json.loads(out["snapshot_json"])
    assert out["prompt"].startswith("Q: p1 G: {") and len(doc["nodes"]) == 4 and {e["type"] for e in doc["edges"]} >= {"HAS_RESIDUE"}
