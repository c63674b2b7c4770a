"""Idempotent keyed upserts into a property graph kept as a node and an edge table.

Nodes are ``(id, labels, props)`` with ``id = label:key``; edges are ``(src, dst, type, props)``. A batch
carries ``ord``, the order of its rows. The latest row wins per property (nodes) or per edge. All rows of a label carry the
same columns, so a batch is reduced to the last row per key, partially before the shuffle, and then merged with the stored
table by one outer join that reads it once. The batch is written once to the checkpoint folder, because its keys,
nodes and edges are all made from it. For many small batches on a large graph see ``streaming/store.py``, which does not
touch the stored table.

``*_changes`` functions turn a batch into node rows ``(id, label, ord, row, need)`` and edge rows ``(src, dst, type, props,
ord, need)``; ``need`` are the ids of nodes that must exist for the row to count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protspark.functions.columns import coalesce_nonempty, default_key, derive_pdb_id, require_key
from protspark.functions.lineage import cut
from protspark.functions.skew import spread
from protspark.schemas import ENDPOINTS, LABEL_KEYS


def _no_props() -> Column:
    return F.create_map().cast("map<string,string>")


def node_id(label: str, key: str | Column) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"{label}:"), c.cast("string"))


def empty_nodes(spark) -> DataFrame:
    return spark.createDataFrame([], "id string, labels array<string>, props map<string,string>")


def empty_edges(spark) -> DataFrame:
    return spark.createDataFrame([], "src string, dst string, type string, props map<string,string>")


def _needs(*ids: Column) -> Column:
    return (F.array(*ids) if ids else F.array()).cast("array<string>").alias("need")


def _rows(batch: DataFrame, label: str, key: str, cols: list[str], *need: Column) -> DataFrame:
    """One node row per batch row: its columns as a map, null values kept."""
    entries = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))]) if cols else _no_props()
    return batch.select(node_id(label, key).alias("id"), F.lit(label).alias("label"), F.col("ord").cast("long").alias("ord"),
                        entries.cast("map<string,string>").alias("row"), _needs(*need))


def node_changes(batch: DataFrame, label: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One node per key, no edges."""
    rows = _rows(batch, label, key or LABEL_KEYS[label], [c for c in batch.columns if c != "ord"])
    return rows, _link(batch.where(F.lit(False)), F.lit(""), F.lit(""), "")


def upsert_nodes(nodes: DataFrame, batch: DataFrame, label: str, key: str | None = None) -> DataFrame:
    """Merge rows by key; the last row wins per property, null removes it, blank overwrites it."""
    return _merge_nodes(nodes, node_changes(batch, label, key)[0])


def _merge_nodes(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The stored nodes with the last row of each id; a null value removes a property, and labels are kept."""
    last = rows.groupBy("id").agg(F.max_by("row", "ord").alias("row"), F.first("label").alias("label"))
    both = nodes.select("id", "labels", "props").join(last, "id", "full_outer")
    labels = F.expr("CASE WHEN label IS NULL THEN labels ELSE array_sort(array_union(coalesce(labels, array()), array(label))) END")
    props = F.expr("""CASE WHEN row IS NULL THEN coalesce(props, CAST(map() AS map<string,string>)) ELSE map_concat(
        map_filter(coalesce(props, CAST(map() AS map<string,string>)), (k, v) -> NOT map_contains_key(row, k)), map_filter(row, (k, v) -> v IS NOT NULL)) END""")
    return both.select("id", labels.alias("labels"), props.alias("props"))


def merge_edges(edges: DataFrame, *batches: DataFrame) -> DataFrame:
    """One edge per (src, dst, type). Batches carry ``ord`` and ``props``; null ``props`` leaves old ones."""
    new = None
    for b in batches:
        part = b.select("src", "dst", "type", F.col("props").cast("map<string,string>"), F.col("ord").cast("long"))
        new = part if new is None else new.unionByName(part)
    key = ["src", "dst", "type"]
    given = F.when(F.col("props").isNotNull(), F.col("ord"))
    last = new.groupBy(*key).agg(F.max_by("props", given).alias("_new"), F.lit(True).alias("_touched"))
    both = edges.select(*key, "props").join(last, key, "full_outer")
    merged = F.when(F.col("_touched"), F.coalesce("_new", "props", _no_props())).otherwise(F.col("props"))
    return both.select(*key, merged.alias("props"))


def _link(batch: DataFrame, src: Column, dst: Column, kind: str, props: Column | None = None, need: tuple[Column, ...] = ()) -> DataFrame:
    p = F.lit(None).cast("map<string,string>") if props is None else props
    return batch.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), p.alias("props"), F.col("ord").cast("long").alias("ord"), _needs(*need))


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _per(edges: DataFrame, kind: str, prop: str) -> DataFrame:
    """Edges of one type under ``type@property``, so that a merge keeps one for each value of a stored property."""
    keyed = F.concat_ws("@", F.lit(kind), F.coalesce(F.try_element_at("props", F.lit(prop)), F.lit("")))
    return edges.withColumn("type", F.when(F.col("type") == kind, keyed).otherwise(F.col("type")))


def _props(cols: dict[str, Column]) -> Column:
    """Property map without null entries."""
    full = F.create_map(*[x for k, c in cols.items() for x in (F.lit(k), c.cast("string"))])
    return F.map_filter(full, lambda k, v: v.isNotNull())


def _existing(batch: DataFrame, nodes: DataFrame, label: str, key: str) -> DataFrame:
    """Rows whose partner node exists."""
    ids = nodes.where(F.array_contains("labels", label)).select(F.col("id").alias("_id"))
    return batch.join(ids, node_id(label, key) == F.col("_id"), "left_semi")


def contact_changes(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Residue contacts: protein, both residues, HAS_RESIDUE edges and one directed CONTACTS edge per pair."""
    rows = require_key(batch, "uniprot_id").withColumns({
        "model_id": F.coalesce(F.col("model_id"), F.lit("")), "contact_type": F.coalesce(F.col("contact_type"), F.lit(""))})
    uid = lambda p: F.concat_ws(":", F.col("uniprot_id"), F.col(p).cast("string"))
    protein = node_id("Protein", "uniprot_id")
    ends = [rows.select((F.col("ord") * 2 + k).alias("ord"), uid(p).alias("residue_uid"), "uniprot_id",
                        F.col(p).alias("pos"), F.col(f"aa_{p}").alias("aa")) for k, p in enumerate("ij")]
    residues = [_rows(e, "Residue", "residue_uid", ["residue_uid", "uniprot_id", "pos", "aa"]) for e in ends]
    has = [_link(rows, protein, node_id("Residue", uid(p)), "HAS_RESIDUE") for p in "ij"]
    props = _props({c: F.col(c) for c in ("dist", "w", "chain", "model_id", "contact_type")})
    pair = _link(rows, node_id("Residue", uid("i")), node_id("Residue", uid("j")), "CONTACTS", props)
    return _all(_rows(rows, "Protein", "uniprot_id", ["uniprot_id"]), *residues), _all(*has, pair)


def _merged(nodes: DataFrame, edges: DataFrame, rows: DataFrame, links: DataFrame, per: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables with a batch's changes; ``per`` (type, property) keeps one edge of the type per value of the property."""
    if per:
        links, edges = _per(links, *per), _per(edges, *per)
    merged = merge_edges(edges, links)
    if per:
        merged = merged.withColumn("type", F.substring_index("type", "@", 1))
    return _merge_nodes(nodes, rows), merged


def upsert_contacts(nodes: DataFrame, edges: DataFrame, batch: DataFrame, key_by_model: bool = False) -> tuple[DataFrame, DataFrame]:
    """``contact_changes`` merged. By default a later model overwrites the edge of an earlier one; ``key_by_model`` keeps
    one per model.
    """
    return _merged(nodes, edges, *contact_changes(cut(batch)), ("CONTACTS", "model_id") if key_by_model else None)


def assay_changes(batch: DataFrame, key_by_assay: bool = False) -> tuple[DataFrame, DataFrame]:
    """The assay node, HAS_ASSAY, TARGETS and BINDS; all need the protein and the ligand."""
    rows = default_key(batch, "assays")
    ligand, protein = node_id("Ligand", "ligand_id"), node_id("Protein", "uniprot_id")
    need = (ligand, protein)
    cols = [c for c in rows.columns if c != "ord"]
    said = ("metric", "units", "value", "source", "year", *(["assay_id"] if key_by_assay else []))
    props = _props({c: F.col(c) if c in rows.columns else F.lit(None) for c in said})
    links = _all(_link(rows, ligand, node_id("AssayResult", "assay_id"), "HAS_ASSAY", need=need),
                 _link(rows, ligand, protein, "TARGETS", need=need), _link(rows, ligand, protein, "BINDS", props, need))
    return _rows(rows, "AssayResult", "assay_id", cols, *need), links


def upsert_assays(nodes: DataFrame, edges: DataFrame, batch: DataFrame, key_by_assay: bool = False) -> tuple[DataFrame, DataFrame]:
    """Assay rows whose protein and ligand both exist: the assay node, HAS_ASSAY, TARGETS and BINDS.

    There is one BINDS per ligand and protein and the last assay wins, unless ``key_by_assay``, which stores
    ``assay_id`` on the edge and keeps one per assay.
    """
    linked = cut(_existing(_existing(default_key(batch, "assays"), nodes, "Protein", "uniprot_id"), nodes, "Ligand", "ligand_id"))
    return _merged(nodes, edges, *assay_changes(linked, key_by_assay), ("BINDS", "assay_id") if key_by_assay else None)


def toxicity_changes(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The event node and HAS_TOXICITY; both need the ligand."""
    rows = default_key(require_key(batch, "ligand_id"), "toxicity")
    ligand = node_id("Ligand", "ligand_id")
    cols = [c for c in rows.columns if c != "ord"]
    return (_rows(rows, "ToxicityEvent", "tox_id", cols, ligand),
            _link(rows, ligand, node_id("ToxicityEvent", "tox_id"), "HAS_TOXICITY", need=(ligand,)))


def upsert_toxicity(nodes: DataFrame, edges: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Toxicity rows whose ligand exists: the event node and HAS_TOXICITY."""
    return _merged(nodes, edges, *toxicity_changes(cut(_existing(batch, nodes, "Ligand", "ligand_id"))))


PARTNERS = {"uniprot_id": "Protein", "ligand_id": "Ligand", "antibody_id": "Antibody", "peptide_id": "Peptide"}


def normalize_structures(batch: DataFrame) -> DataFrame:
    """``structure_id``, ``path`` and ``pdb_id`` from whichever columns carry them."""
    have = lambda *names: [c for c in names if c in batch.columns]
    sid = coalesce_nonempty(*have("structure_id", "model_id", "pdb_id"))
    path = F.coalesce(coalesce_nonempty(*have("path", "pdb_path", "mmcif_path")), F.lit("")) if have("path", "pdb_path", "mmcif_path") else F.lit("")
    rows = default_key(batch.withColumns({"structure_id": sid, "path": path}), "structures")
    given = coalesce_nonempty("pdb_id") if "pdb_id" in batch.columns else F.lit(None).cast("string")
    return rows.withColumn("pdb_id", F.coalesce(given, derive_pdb_id("structure_id", "path")))


def structure_changes(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The structure node always; HAS_STRUCTURE from each partner, which it needs."""
    rows = normalize_structures(batch)
    cols = [c for c in rows.columns if c != "ord"]
    links = [_link(rows, node_id(label, key), node_id("Structure", "structure_id"), "HAS_STRUCTURE", need=(node_id(label, key),))
             for key, label in PARTNERS.items() if key in rows.columns]
    none = _link(rows.where(F.lit(False)), F.lit(""), F.lit(""), "HAS_STRUCTURE")
    return _rows(rows, "Structure", "structure_id", cols), _all(none, *links)


def upsert_structures(nodes: DataFrame, edges: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The structure node always; HAS_STRUCTURE from each partner that exists."""
    rows, links = structure_changes(cut(batch))
    known = nodes.select(F.col("id").alias("_id"), F.explode("labels").alias("_label")).where(F.col("_id").startswith(F.concat("_label", F.lit(":")))).select("_id").distinct()
    # An inner join with distinct ids: a semi join would be pushed below the union of the links, and a task would sort every part at once.
    needy = spread(links.withColumn("_need", F.get("need", F.lit(0))), "_need").join(known, F.col("_need") == F.col("_id"))
    return _merged(nodes, edges, rows, needy.drop("_need", "_id"))


def check_unique(nodes: DataFrame) -> DataFrame:
    """Violations of key uniqueness: ``(label, key, n)`` with ``n > 1``."""
    keys = F.create_map(*[x for label, key in LABEL_KEYS.items() for x in (F.lit(label), F.lit(key))])
    rows = nodes.select(F.explode("labels").alias("label"), "props")
    keyed = rows.withColumn("key", F.try_element_at("props", F.try_element_at(keys, F.col("label")))).where(F.col("key").isNotNull())
    return keyed.groupBy("label", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_endpoints(nodes: DataFrame, edges: DataFrame, spec: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Edges whose type is unknown, whose ends are missing, or whose end labels the type does not allow."""
    spec = spec or ENDPOINTS
    at = lambda k: F.create_map(*[x for t, ends in spec.items() for x in (F.lit(t), F.lit(ends[k]))])
    labels = nodes.select("id", "labels")
    joined = (edges.join(labels.select(F.col("id").alias("src"), F.col("labels").alias("src_labels")), "src", "left")
              .join(labels.select(F.col("id").alias("dst"), F.col("labels").alias("dst_labels")), "dst", "left")
              .withColumns({"want_src": F.try_element_at(at(0), F.col("type")), "want_dst": F.try_element_at(at(1), F.col("type"))}))
    fits = lambda want, have: F.col(have).isNotNull() & ((F.col(want) == "any") | F.array_contains(have, F.col(want)))
    reason = (F.when(F.col("want_src").isNull(), "unknown type").when(~fits("want_src", "src_labels"), "source")
              .when(~fits("want_dst", "dst_labels"), "target"))
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("src", "dst", "type", "reason")
