"""Sources and sinks: tables are written as files by Spark, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from protspark.functions.lineage import shared_folder
from protspark.operators.geometry import contacts
from protspark.plans.registry import query, r6, table
from protspark.plans.stand_ins import ALIGNED_SQL, PAIRS_SQL, POINTS_SQL, SEQUENCES_SQL, aligned, points, sequences
from protspark.schemas import AA3_STANDARD, AMINO_ACIDS
from protspark.sources import entities, hits, sequences as seqfiles, sinks, snapshots, structures
from protspark.functions.vectors import l2_norm

FILE_ROWS = 9_999  # residues of one rendered file: four-digit numbers
CHAINS = 26


def write_ordered(rows, path: str, group: str, *order: str) -> None:
    """One text file per group value, lines in order; groups are bounded by how they were cut."""
    (rows.repartition(group).sortWithinPartitions(group, *order).select(group, "value")
     .write.mode("overwrite").partitionBy(group).text(path))


@query("src01_entity_csv", """
    SELECT CAST(o_orderkey AS VARCHAR) AS assay_id, CAST(o_custkey AS VARCHAR) AS ligand_id, o_orderstatus AS metric,
        o_totalprice AS value, o_orderpriority AS units, '' AS source FROM orders""")
def entity_csv(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("assay_id"), F.col("o_custkey").alias("ligand_id"), F.col("o_orderstatus").alias("metric"),
        F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("units"), F.lit("").alias("source"))
    path = shared_folder(spark, "csv")
    sinks.write_entity_csv(o, path)
    return entities.read_entity_csv(spark, path, "assays").withColumn("value", F.col("value").cast("double"))


@query("src02_table_auto", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def table_auto(spark, sf):
    path = shared_folder(spark, "tsv") + ".tsv"
    sinks.write_entity_csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, "\t")
    return entities.read_table_auto(spark, path)


@query("src02_table_sniffed", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand FROM part")
def table_sniffed(spark, sf):
    path = shared_folder(spark, "sniffed")
    sinks.write_entity_csv(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), path, ";")
    return entities.read_table_auto(spark, path, sniff=True)


@query("src03_fasta", r"""
    WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS name, regexp_replace(text, '[^A-Za-z]', '', 'g') AS seq FROM documents)
    SELECT name, length(seq) AS n, md5(seq) AS digest FROM s WHERE seq <> ''""")
def fasta(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("name"), F.regexp_replace("text", "[^A-Za-z]", "").alias("s"))
    path = shared_folder(spark, "fasta")
    wrapped = F.regexp_replace("s", "(.{60})", "$1\n")
    sinks.write_fasta(d.select(F.concat("name", F.lit(" src")).alias("name"), wrapped.alias("seq")), path)
    return seqfiles.read_fasta(spark, path, id_mode="token").select("name", F.length("seq").cast("long").alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


MSA_FILES_SQL = ALIGNED_SQL + """, raw AS (SELECT msa_id, row_id // 10000 AS chunk, row_id,
    CASE WHEN starts_with(seq, 'A') THEN left(seq, 63) ELSE seq END AS seq FROM aln),
    width AS (SELECT msa_id, chunk, arg_min(length(seq), row_id) AS w FROM raw GROUP BY 1, 2)"""


def _msa_rows(spark, sf):
    a = aligned(spark, sf).withColumn("chunk", F.concat_ws("_", "msa_id", F.floor(F.col("row_id") / 10000)))
    return a.withColumn("seq", F.when(F.col("seq").startswith("A"), F.substring("seq", 1, 63)).otherwise(F.col("seq")))


@query("src04_a3m", f"""
    WITH {MSA_FILES_SQL}
    SELECT CAST(row_id AS VARCHAR) AS name, seq FROM raw JOIN width USING (msa_id, chunk) WHERE length(seq) = w""")
def a3m(spark, sf):
    rows = _msa_rows(spark, sf)
    inserted = F.concat(F.substring("seq", 1, 10), F.lit("acd"), F.substring("seq", 11, 100))
    path = shared_folder(spark, "a3m")
    write_ordered(rows.withColumn("value", F.concat(F.lit(">"), "row_id", F.lit("\n"), inserted)), path, "chunk", "row_id")
    return seqfiles.read_a3m(spark, path).select("name", "seq")


@query("src05_aligned_fasta", f"""
    WITH {MSA_FILES_SQL}
    SELECT CAST(row_id AS VARCHAR) AS name, seq FROM raw JOIN width USING (msa_id, chunk) WHERE length(seq) = w""")
def aligned_fasta(spark, sf):
    rows = _msa_rows(spark, sf)
    path = shared_folder(spark, "afa")
    dotted = F.lower(F.translate("seq", "-", "."))
    write_ordered(rows.withColumn("value", F.concat(F.lit(">"), "row_id", F.lit("\n"), dotted)), path, "chunk", "row_id")
    return seqfiles.read_aligned_fasta(spark, path).select("name", "seq")


def pdb_line(record: str, atom: str, resname, chain, resseq, x, y, z, element: str, occupancy: float = 1.0):
    fmt = f"{record:<6}%5d {atom:<4} %3s %1s%4d    %8.3f%8.3f%8.3f{occupancy:6.2f}  0.00          {element:>2}"
    return F.format_string(fmt, F.lit(1), resname, chain, resseq, x, y, z)


def structure_points(spark, sf):
    """Points with one decimal, cut into files of at most 9 999 residues; the label is the chain."""
    p = points(spark, sf)
    return p.select((F.col("idx") / FILE_ROWS).cast("long").alias("file"), F.element_at(F.split(F.lit("A,B,C,D,E,F,G,H,I,J"), ","), F.col("model_id") + 1).alias("chain"),
                    F.pmod("idx", F.lit(FILE_ROWS)).cast("int").alias("resseq"), *[(F.floor(F.col(a) * 1000) / 10).alias(a) for a in "xyz"])


STRUCTURE_SQL = POINTS_SQL + f""", st AS (SELECT idx // {FILE_ROWS} AS file, substr('ABCDEFGHIJ', model_id + 1, 1) AS chain,
    CAST(idx % {FILE_ROWS} AS INT) AS resseq, floor(x * 1000) / 10 AS x, floor(y * 1000) / 10 AS y, floor(z * 1000) / 10 AS z FROM pts)"""


def write_pdb(spark, sf) -> str:
    p = structure_points(spark, sf)
    at = lambda dx: [F.col("x") + dx, F.col("y"), F.col("z")]
    lines = [
        (1, pdb_line("ATOM", " N", F.lit("LEU"), F.col("chain"), F.col("resseq"), *at(0.5), "N")),
        (2, pdb_line("ATOM", " CA", F.lit("LEU"), F.col("chain"), F.col("resseq"), *at(0.0), "C")),
        (3, pdb_line("ATOM", " CB", F.lit("LEU"), F.col("chain"), F.col("resseq"), *at(1.0), "C")),
        (4, pdb_line("HETATM", " O", F.lit("HOH"), F.col("chain"), F.col("resseq"), *at(2.0), "O")),
    ]
    body = p.select("file", "resseq", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("value")) for k, v in lines])).alias("l"))
    end = p.select("file").distinct().select("file", F.lit(1_000_000).alias("resseq"), F.explode(F.array(
        F.struct(F.lit(5).alias("k"), F.lit("ENDMDL").alias("value")),
        F.struct(F.lit(6).alias("k"), pdb_line("ATOM", " CA", F.lit("LEU"), F.lit("A"), F.lit(1), F.lit(0.0), F.lit(0.0), F.lit(0.0), "C").alias("value")))).alias("l"))
    path = shared_folder(spark, "pdb")
    write_ordered(body.unionByName(end).select("file", "resseq", "l.k", "l.value"), path, "file", "resseq", "k")
    return path


@query("src06_pdb_ca", f"""
    WITH {STRUCTURE_SQL} SELECT resseq, x, y, z, row_number() OVER (PARTITION BY file ORDER BY resseq) - 1 AS idx FROM st""")
def pdb_ca(spark, sf):
    return structures.read_pdb_ca(spark, write_pdb(spark, sf)).select("resseq", "x", "y", "z", F.col("idx").cast("long").alias("idx"))


def write_seqres(spark, sf) -> str:
    """Each aligned row is one chain of 64 residues, 26 chains per file; a gap is an unknown residue."""
    to3 = F.create_map(*[F.lit(x) for name, one in AA3_STANDARD.items() for x in (one, name)])
    a = aligned(spark, sf).select((F.col("row_id") / CHAINS).cast("long").alias("file"), "row_id",
                                  F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.pmod("row_id", F.lit(CHAINS)).cast("int") + 1, F.lit(1)).alias("chain"),
                                  F.transform(F.split("seq", ""), lambda c: F.coalesce(F.try_element_at(to3, c), F.lit("UNK"))).alias("codes"))
    parts = a.select("file", "row_id", "chain", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.array_join(F.slice("codes", k * 13 + 1, 13), " "))).alias("k", "text"))
    path = shared_folder(spark, "seqres")
    write_ordered(parts.withColumn("value", F.format_string("SEQRES %3d %s   64  %s", F.col("k") + 1, "chain", "text")), path, "file", "row_id", "k")
    return path


@query("src07_seqres_skip", f"WITH {SEQUENCES_SQL} SELECT substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(query_id % 26 AS INT) + 1, 1) AS chain, seq FROM seqs WHERE length(seq) >= 10")
def seqres_skip(spark, sf):
    return structures.read_seqres(spark, write_seqres(spark, sf), unknown="skip", min_len=10).select("chain", "seq")


@query("src07_seqres_x", f"WITH {ALIGNED_SQL} SELECT substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(row_id % 26 AS INT) + 1, 1) AS chain, replace(seq, '-', 'X') AS seq FROM aln")
def seqres_x(spark, sf):
    return structures.read_seqres(spark, write_seqres(spark, sf), unknown="X").select("chain", "seq")


@query("src08_list_structures", "SELECT count(DISTINCT vec_id // 26) AS files FROM embeddings")
def list_files(spark, sf):
    found = structures.list_structures(spark, write_seqres(spark, sf), exts="txt")
    return found.agg(F.count("path").alias("files"))


@query("src09_residues", f"""
    WITH {STRUCTURE_SQL} SELECT chain, resseq, 'L' AS aa, round(x + 1.0, 6) + 0.0 AS x, y, z, row_number() OVER (PARTITION BY file, chain ORDER BY resseq) - 1 AS idx FROM st""")
def residues_cb(spark, sf):
    r = structures.read_residues(spark, write_pdb(spark, sf), atom="CB")
    return r.select("chain", "resseq", "aa", r6("x").alias("x"), "y", "z", F.col("idx").cast("long").alias("idx"))


def line_residues(spark, sf):
    """Order lines as residues of chains named by the return flag."""
    letter = F.substring(F.lit(AMINO_ACIDS), F.pmod("l_quantity", F.lit(20)).cast("int") + 1, F.lit(1))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("model_id"), F.col("l_returnflag").alias("chain"),
                                               F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("part"), letter.alias("aa"))


@query("src10_choose_chain_longest", """
    WITH n AS (SELECT l_orderkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, l_returnflag) AS rn FROM n)
    SELECT l_orderkey AS model_id, l_returnflag AS chain, l_linenumber AS idx, l_partkey AS part
    FROM lineitem JOIN best USING (l_orderkey, l_returnflag) WHERE rn = 1""")
def chain_longest(spark, sf):
    return structures.choose_chain(line_residues(spark, sf), "longest").drop("aa")


@query("src10_choose_chain_requested", """
    WITH n AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem),
    best AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_returnflag) AS rn FROM n)
    SELECT l_orderkey AS model_id, l_returnflag AS chain, count(*) AS residues
    FROM lineitem JOIN best USING (l_orderkey, l_returnflag) WHERE rn = 1 GROUP BY 1, 2""")
def chain_requested(spark, sf):
    kept = structures.choose_chain(line_residues(spark, sf), "requested", requested="R")
    return kept.groupBy("model_id", "chain").agg(F.count(F.lit(1)).alias("residues"))


@query("src10_choose_chain_all", """
    SELECT l_orderkey AS model_id, l_returnflag AS chain, count(*) AS residues FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2""")
def chain_all(spark, sf):
    kept = structures.choose_chain(line_residues(spark, sf), "all")
    return kept.groupBy("model_id", "chain").agg(F.count(F.lit(1)).alias("residues"))


@query("src11_m8", """
    SELECT CAST(l_orderkey AS VARCHAR) AS query, CAST(l_partkey AS VARCHAR) AS subject,
        CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_quantity END AS pident,
        CASE WHEN l_linestatus = 'O' THEN NULL ELSE CAST(l_linenumber AS INT) END AS alnlen,
        CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_discount END AS evalue,
        CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_extendedprice END AS bits
    FROM lineitem WHERE l_returnflag <> 'R'
    UNION ALL SELECT NULL, CAST(l_partkey AS VARCHAR), NULL, NULL, NULL, NULL FROM lineitem WHERE l_returnflag = 'R'""")
def m8(spark, sf):
    li = table(spark, sf, "lineitem")
    count = F.when(F.col("l_linestatus") == "O", F.lit("n/a")).otherwise(F.col("l_linenumber").cast("string"))
    full = F.concat_ws("\t", "l_orderkey", "l_partkey", "l_quantity", count, F.lit("0"), F.lit("0"), F.lit("1"), F.lit("9"), F.lit("1"), F.lit("9"), "l_discount", "l_extendedprice")
    short = F.concat_ws("\t", F.lit("q"), "l_partkey", F.lit("partial"))
    line = F.when(F.col("l_returnflag") == "R", short).otherwise(full)
    path = shared_folder(spark, "m8")
    li.select(F.explode(F.array(line, F.lit("# comment"))).alias("value")).write.text(path)
    return hits.read_m8(spark, path).select("query", "subject", "pident", "alnlen", "evalue", "bits")


@query("src12_blast_text", f"""
    WITH {ALIGNED_SQL} SELECT CAST(row_id AS VARCHAR) AS subject, upper(seq) AS saln FROM aln WHERE NOT starts_with(seq, 'A')""")
def blast_text(spark, sf):
    a = aligned(spark, sf).withColumn("chunk", F.floor(F.col("row_id") / 10000))
    tail = F.when(F.col("seq").startswith("A"), F.substring("seq", 33, 31)).otherwise(F.substring("seq", 33, 32))
    dots = lambda c: F.translate(c, "-", ".")
    hit = F.concat(F.lit(">"), "row_id", F.lit(" hit\n\nQuery  1   "), F.substring("seq", 1, 32), F.lit("   32\nSbjct  1   "), dots(F.substring("seq", 1, 32)),
                   F.lit("   32\n\nQuery  33  "), F.substring("seq", 33, 32), F.lit("   64\nSbjct  33  "), dots(tail), F.lit("   64"))
    head = a.select("chunk").distinct().select("chunk", F.lit(-1).cast("long").alias("row_id"), F.lit("BLASTP report\nQuery  1   AAA   3").alias("value"))
    path = shared_folder(spark, "blast")
    write_ordered(a.select("chunk", "row_id", hit.alias("value")).unionByName(head), path, "chunk", "row_id")
    return hits.read_blast_text(spark, path).select("subject", "saln")


@query("src13_blast_xml", "SELECT p_name AS hseq, p_brand AS qseq, CAST(p_size AS INT) AS identity, CAST(p_partkey AS INT) AS align_len FROM part")
def blast_xml(spark, sf):
    p = table(spark, sf, "part").withColumn("chunk", F.floor(F.col("p_partkey") / 10000))
    xml = F.format_string("<Hsp><Hsp_qseq>%s</Hsp_qseq><Hsp_hseq>%s</Hsp_hseq><Hsp_identity>%d</Hsp_identity><Hsp_align-len>%d</Hsp_align-len></Hsp>",
                          "p_brand", "p_name", "p_size", "p_partkey")
    rows = p.select("chunk", "p_partkey", xml.alias("value"))
    frame = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(v).alias("v")) for k, v in ((-1, "<Hit_hsps>"), (2 ** 62, "</Hit_hsps>"))]))
    ends = p.select("chunk").distinct().select("chunk", frame.alias("f")).select("chunk", F.col("f.k").alias("p_partkey"), F.col("f.v").alias("value"))
    path = shared_folder(spark, "xml")
    write_ordered(rows.unionByName(ends), path, "chunk", "p_partkey")
    return hits.read_blast_xml(spark, path)


@query("src14_hits_json", """
    SELECT CAST(o_orderkey AS VARCHAR) AS query_id, CAST(o_custkey AS INT) AS length, CAST(l_partkey AS VARCHAR) AS subject, l_quantity AS pident,
        CAST(l_linenumber AS INT) AS alnlen, l_discount AS evalue, l_extendedprice AS bits
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def hits_json(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    rows = o.join(li, o.o_orderkey == li.l_orderkey, "left").select(
        F.col("o_orderkey").cast("string").alias("query_id"), F.col("o_custkey").cast("int").alias("length"), F.col("l_linenumber").alias("ord"),
        F.col("l_partkey").cast("string").alias("subject"), F.col("l_quantity").alias("pident"), F.col("l_linenumber").alias("alnlen"),
        F.lit(1).alias("qstart"), F.lit(2).alias("qend"), F.col("l_discount").alias("evalue"), F.col("l_extendedprice").alias("bits"))
    path = shared_folder(spark, "hits")
    hits.write_hits_json(rows, path)
    return hits.read_hits_json(spark, path).select("query_id", "length", "subject", "pident", "alnlen", "evalue", "bits")


@query("src15_snapshot_json", """
    SELECT CAST(l_orderkey AS VARCHAR) AS query, 'Residue:' || l_partkey AS id, 'Residue' AS label, CAST(l_linenumber AS VARCHAR) AS pos, 'CONTACTS' AS type
    FROM lineitem""")
def snapshot_json(spark, sf):
    li = table(spark, sf, "lineitem")
    uid = F.concat(F.lit("Residue:"), F.col("l_partkey"))
    node = F.struct(uid.alias("id"), F.array(F.lit("Residue")).alias("labels"), F.create_map(F.lit("pos"), F.col("l_linenumber").cast("string")).alias("props"))
    edge = F.struct(uid.alias("src"), F.lit("Structure:1").alias("dst"), F.lit("CONTACTS").alias("type"), F.create_map(F.lit("w"), F.lit("1")).alias("props"))
    snaps = li.groupBy(F.col("l_orderkey").cast("string").alias("query")).agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges")).withColumn("k", F.lit(50))
    path = shared_folder(spark, "snapshots")
    snapshots.write_snapshot(snaps, path)
    read = snapshots.read_snapshot(spark, path)
    ns, es = snapshots.snapshot_nodes(read), snapshots.snapshot_edges(read).select("query", "ord", F.col("type"))
    return ns.join(es, ["query", "ord"]).select("query", "id", F.col("labels")[0].alias("label"), F.col("props")["pos"].alias("pos"), "type")


@query("src16_chain_sequences", f"""
    WITH s AS (SELECT l_orderkey, l_returnflag, string_agg(substr('{AMINO_ACIDS}', CAST(l_quantity % 20 AS INT) + 1, 1), '' ORDER BY l_linenumber, substr('{AMINO_ACIDS}', CAST(l_quantity % 20 AS INT) + 1, 1)) AS sequence,
        CAST(count(*) AS INT) AS n_res FROM lineitem GROUP BY 1, 2)
    SELECT o_orderkey AS model_id, l_returnflag AS chain, sequence, n_res, CASE WHEN l_returnflag IS NULL THEN 'missing_file' END AS error
    FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def chain_sequences(spark, sf):
    return structures.chain_sequences(line_residues(spark, sf), table(spark, sf, "orders").select(F.col("o_orderkey").alias("model_id")))


@query("src17_position_vectors", """
    SELECT CAST(label AS VARCHAR) AS id, vec_id AS idx, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 6) + 0.0 AS norm FROM embeddings""")
def position_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("id"), F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    path = shared_folder(spark, "vectors")
    sinks.write_position_vectors(e, path)
    return sinks.read_position_vectors(spark, path).select("id", "idx", r6(l2_norm("vec")).alias("norm"))


@query("src18_contacts_sink", f"""
    WITH {PAIRS_SQL} SELECT CAST(model_id AS VARCHAR) AS model_id, count(*) AS n, round(sum(dist), 6) + 0.0 AS total FROM pairs WHERE dist <= 0.1 GROUP BY 1""")
def contacts_sink(spark, sf):
    c = contacts(points(spark, sf), 0.1)
    rows = c.select(F.lit("P1").alias("uniprot_id"), F.lit("A").alias("chain"), "i", F.lit("L").alias("aa_i"), "j", F.lit("L").alias("aa_j"), "w", "dist", "model_id", "contact_type")
    path = shared_folder(spark, "contacts")
    sinks.write_contacts(rows, path)
    back = entities.read_entity_csv(spark, path, "contacts")
    return back.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("dist").cast("double"))).alias("total"))
