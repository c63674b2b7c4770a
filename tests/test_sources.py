import pytest
from pyspark.sql import functions as F

from support import rows
from protspark.schemas import VARIANT_SYNONYMS
from protspark.sources import entities, hits, sequences, sinks, snapshots, structures


def put(folder, name, text):
    p = folder / name
    p.write_text(text)
    return str(p)


def test_entity_csv_blanks_quotes_and_order(spark, tmp_path):
    path = put(tmp_path, "ligands.csv", 'name,ligand_id,mw,note\n"a, ""b""",L1,,x\n ,L2,3.5,\n\n')
    df = entities.read_entity_csv(spark, path, "ligands")
    assert df.columns == ["ligand_id", "name", "mw", "note"]
    assert rows(df) == [("L1", 'a, "b"', "", "x"), ("L2", " ", "3.5", "")]


def test_table_auto(spark, tmp_path):
    assert entities.read_table_auto(spark, put(tmp_path, "a.tsv", "x\ty\n1\t2\n")).columns == ["x", "y"]
    assert entities.read_table_auto(spark, put(tmp_path, "a.csv", "x,y\n1,2\n")).columns == ["x", "y"]
    assert entities.read_table_auto(spark, put(tmp_path, "odd", "x;y;z\n1;2;3\n"), sniff=True).columns == ["x", "y", "z"]


def test_headers(spark):
    df = spark.createDataFrame([(1, "A", "C", 0.5)], "` Position` int, AA_WT string, ALT string, ddG double")
    assert entities.normalize_headers(df, VARIANT_SYNONYMS, ["pos", "wt", "mut", "score"]).columns == ["pos", "wt", "mut", "score"]
    with pytest.raises(ValueError, match="score"):
        entities.normalize_headers(df.drop("ddG"), VARIANT_SYNONYMS, ["pos", "wt", "mut", "score"])


def test_fasta(spark, tmp_path):
    put(tmp_path, "a.fasta", ">one first\r\nMK\r\n\r\nTA\n>\nGG\n>empty\n>two\nC")
    df = sequences.read_fasta(spark, str(tmp_path))
    assert rows(df, "name", "seq") == [("one first", "MKTA"), ("seq_2", "GG"), ("two", "C")]
    assert rows(sequences.read_fasta(spark, str(tmp_path), id_mode="token"), "name")[0] == ("one",)


def test_fasta_split_over_blocks(spark, tmp_path):
    recs = [(f"r{k}", "ACDEFGHIKL" * (k % 7 + 1)) for k in range(400)]
    put(tmp_path, "big.fasta", "".join(f">{n}\n{s}\n" for n, s in recs))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = sequences.read_fasta(spark, str(tmp_path))
        assert [tuple(r) for r in df.orderBy("path", "ord").select("name", "seq").collect()] == recs
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a3m_and_aligned(spark, tmp_path):
    path = put(tmp_path, "q.a3m", ">q\nMK-T\n>h1\nMaaKGT\n>short\nMK\n>h2\nm.KK-T.\n")
    assert rows(sequences.read_a3m(spark, path), "msa_id", "name", "seq") == [("q", "h1", "MKGT"), ("q", "h2", "KK-T"), ("q", "q", "MK-T")]
    aln = put(tmp_path, "q.afa", ">q\nmk.t\n>h\nMK_T\n>long\nMKTTT\n>z\nAAAA\n")
    assert rows(sequences.read_aligned_fasta(spark, aln, max_seqs=2), "name", "seq") == [("h", "MK-T"), ("q", "MK-T")]


PDB = """SEQRES   1 A    3  ALA GLY XYZ
SEQRES   1      2  SEC MSE
ATOM      1  N   ALA A   1       9.000   0.000   0.000  1.00  0.00           N
ATOM      2  CA AALA A   1       1.000   2.000   3.000  0.30  0.00           C
ATOM      3  CA BALA A   1       1.500   2.000   3.000  0.70  0.00           C
ATOM      4  CB  ALA A   1       1.000   9.000   3.000  1.00  0.00           C
ATOM      5  CA  GLY A   2       4.000   5.000   6.000  1.00  0.00           C
ATOM      6  CA  ALA A   2A      7.000   5.000   6.000  1.00  0.00           C
HETATM    7  CA  MSE B   5       1.000   1.000   1.000  1.00  0.00           C
HETATM    8  O   HOH B   9       1.000   1.000   1.000  1.00  0.00           O
HETATM    9  C1  LIG B  10       1.000   1.000   1.000  1.00  0.00           C
ENDMDL
ATOM     10  CA  ALA A   7       4.000   5.000   6.000  1.00  0.00           C
"""
CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.pdbx_PDB_model_num
ATOM 1 C CA . ALA A 4 1.0 2.0 3.0 1
ATOM 2 C CB . ALA A 4 1.0 2.5 3.0 1
ATOM 3 C CA . GLY A 5 4.0 5.0 6.0 1
ATOM 4 C CA . GLY A 5 9.0 9.0 9.0 2
#
"""


def test_structures(spark, tmp_path, tmp_path_factory):
    put(tmp_path, "1abc.pdb", PDB)
    put(tmp_path, "2xyz.cif", CIF)
    ca = rows(structures.read_residues(spark, str(tmp_path)), "model_id", "chain", "idx", "resseq", "icode", "aa", "x")
    assert ca == [("1abc", "A", 0, 1, "", "A", 1.5), ("1abc", "A", 1, 2, "", "G", 4.0), ("1abc", "A", 2, 2, "A", "A", 7.0), ("1abc", "B", 0, 5, "", "M", 1.0),
                  ("2xyz", "A", 0, 4, "", "A", 1.0), ("2xyz", "A", 1, 5, "", "G", 4.0)]
    cb = {(r["model_id"], r["idx"]): r["y"] for r in structures.read_residues(spark, str(tmp_path), "CB").where("chain = 'A'").collect()}
    assert cb == {("1abc", 0): 9.0, ("1abc", 1): 5.0, ("1abc", 2): None, ("2xyz", 0): 2.5, ("2xyz", 1): 5.0}
    other = tmp_path_factory.mktemp("odd")
    put(other, "3odd.pdb", PDB.replace("CA  GLY A   2 ", "CA  QQQ A   2 ").replace("CA  ALA A   2A", "CA  SEC A   2A"))
    odd = structures.read_residues(spark, str(other), table="contact", unknown="X")
    assert rows(odd, "chain", "idx", "aa") == [("A", 0, "A"), ("A", 1, "X"), ("A", 2, "C")]  # hetero atoms are no residues
    assert rows(structures.read_residues(spark, str(other)), "chain", "idx", "aa") == [("A", 0, "A"), ("B", 0, "M")]
    simple = structures.read_pdb_ca(spark, str(tmp_path / "1abc.pdb"))
    assert rows(simple, "resseq", "x", "idx") == [(1, 1.0, 0), (2, 4.0, 1), (7, 4.0, 2)]
    assert rows(structures.read_seqres(spark, str(tmp_path / "1abc.pdb")), "chain", "seq") == [("A", "AGU")]
    assert rows(structures.read_seqres(spark, str(tmp_path / "1abc.pdb"), unknown="X", blank_chain="Z"), "chain", "seq") == [("A", "AGX"), ("Z", "UM")]
    listed = structures.list_structures(spark, str(tmp_path), limit=1)
    assert rows(listed, "stem") == [("1abc",)]


def test_chain_choice_and_report(spark):
    r = spark.createDataFrame([("m", "B", k, "A") for k in range(3)] + [("m", "A", 0, "C"), ("n", "A", 0, "D")], "model_id string, chain string, idx int, aa string")
    assert {x["chain"] for x in structures.choose_chain(r, "longest").where("model_id = 'm'").collect()} == {"B"}
    assert {x["chain"] for x in structures.choose_chain(r, "first").where("model_id = 'm'").collect()} == {"A"}
    assert rows(structures.choose_chain(r, "all"), "model_id", "chain")[0] == ("m", "B")
    seqs = structures.chain_sequences(r, spark.createDataFrame([("m",), ("gone",)], "model_id string"))
    rep = {x["model_id"]: (x["chains"], x["error"]) for x in structures.chain_report(seqs).collect()}
    assert rep["gone"] == ({}, "missing_file")
    assert rep["m"][0]["B"]["sequence"] == "AAA" and rep["m"][0]["B"]["n_res"] == 3


def test_m8_quirks(spark, tmp_path):
    path = put(tmp_path, "h.m8", "# c\nq s1 90 10 0 0 1 10 1 10 1e-5 50\nq s2 90 10.5 0 0 1 10 1 10 1e-5 50\nonly two\nsingle\n\n")
    got = rows(hits.read_m8(spark, path), "subject", "pident", "alnlen", "evalue")
    assert sorted(got, key=str) == sorted([("s1", 90.0, 10, 1e-5), ("s2", None, None, None), ("two", None, None, None), ("single", None, None, None)], key=str)


def test_blast_text_and_xml(spark, tmp_path):
    text = "BLASTP\nQuery  1  XX  2\n>s1 x\n\nQuery  1  MK.a  4\nSbjct  1  MKGA  4\n\nQuery  5  TT  6\nSbjct  5  T_  6\n>s2\nQuery  1  MKA  3\nSbjct  1  MK  2\n"
    assert rows(hits.read_blast_text(spark, put(tmp_path, "q.txt", text)), "subject", "qaln", "saln") == [("s1", "MK-ATT", "MKGAT-")]
    xml = "<B><Hit><Hsp><Hsp_identity>9</Hsp_identity><Hsp_align-len>10</Hsp_align-len><Hsp_qseq>M</Hsp_qseq><Hsp_hseq> MK </Hsp_hseq></Hsp><Hsp><Hsp_identity>1</Hsp_identity></Hsp></Hit></B>"
    assert rows(hits.read_blast_xml(spark, put(tmp_path, "q.xml", xml))) == [("MK", "M", 9, 10)]


def test_json_documents(spark, tmp_path):
    doc = '{"meta": {"db": "x"},\n "queries": [{"query_id": "q", "length": 3, "hits": [{"subject": "s", "bits": 1.5}]}, {"query_id": "e", "hits": [], "error": "timeout"}]}'
    got = rows(hits.read_hits_json(spark, put(tmp_path, "h.json", doc), multi_line=True), "query_id", "subject", "bits", "error")
    assert got == [("e", None, None, "timeout"), ("q", "s", 1.5, None)]
    snap = '{"query": "CD19", "k": 50, "nodes": [{"id": "1", "labels": ["Protein"], "props": {"length": 5}}],\n "edges": []}'
    n = snapshots.snapshot_nodes(snapshots.read_snapshot(spark, put(tmp_path, "s.json", snap), multi_line=True)).first()
    assert (n["query"], n["labels"], n["props"]) == ("CD19", ["Protein"], {"length": "5"})


def test_position_vectors_prune_folders(spark, tmp_path):
    df = spark.createDataFrame([(f"p{k}", 0, [float(k)]) for k in range(20)], "id string, idx int, vec array<double>")
    sinks.write_position_vectors(df, str(tmp_path / "v"), buckets=8)
    assert rows(sinks.read_position_vectors(spark, str(tmp_path / "v"), ["p3", "p9"], buckets=8), "id") == [("p3",), ("p9",)]
