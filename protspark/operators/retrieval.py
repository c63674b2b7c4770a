"""Seed search, expansion, pruning and compaction of the property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protspark.functions.lineage import cut
from protspark.functions.ordered import ranked
from protspark.functions.skew import first_n
from protspark.schemas import SEARCH_PROPERTIES, SLIM_KEYS


def seed_nodes(nodes: DataFrame, query: str, k: int | None = None, properties: list[str] | None = None) -> DataFrame:
    """Nodes with any query word as a case-insensitive substring of any searched property.

    The first ``k`` by (label, id): a fixed order makes the result repeatable. ``k=None`` keeps all.
    """
    terms = [t.lower() for t in query.split()]
    wanted = F.map_filter("props", lambda name, _: name.isin(properties or SEARCH_PROPERTIES))
    words = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    hit = F.exists(F.map_values(wanted), lambda v: F.exists(words, lambda t: F.lower(v).contains(t)))
    found = nodes.where(hit)
    return found.orderBy(F.element_at("labels", 1), "id").limit(k) if k else found


def _first(df: DataFrame, order: list, n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once per end: ``(id, other)`` plus the edge's own columns."""
    out = edges.withColumns({"id": F.col("src"), "other": F.col("dst")})
    back = edges.where(F.col("src") != F.col("dst")).withColumns({"id": F.col("dst"), "other": F.col("src")})
    return out.unionByName(back)


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds plus their neighbours, and every edge that touches a seed; each node and edge once."""
    ids = seeds.select("id").distinct()
    touching = undirected(edges).join(ids, "id", "left_semi")
    found = touching.groupBy("src", "dst", "type").agg(F.first("props").alias("props"))
    keep = ids.union(touching.select("other")).distinct()
    return nodes.join(keep, "id", "left_semi"), found


def khop(edges: DataFrame, seeds: DataFrame, k: int, types: list[str] | None = None) -> DataFrame:
    """``(id, hop)`` of all nodes within ``k`` undirected hops, by frontier joins.

    Every round joins the frontier only and ends in a checkpoint, so the plan does not grow with ``k``.
    """
    allowed = edges.where(F.col("type").isin(types)) if types else edges
    steps = undirected(allowed.select("src", "dst")).select("id", "other").distinct()
    visited = cut(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    frontier = visited
    for hop in range(1, k + 1):
        reached = steps.join(frontier.select("id"), "id", "left_semi").select(F.col("other").alias("id")).distinct()
        frontier = cut(reached.join(visited.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def paths(edges: DataFrame, starts: DataFrame, pattern: list[tuple[str, str]], weight: str = "weight") -> DataFrame:
    """Simple paths along ``pattern`` = [(edge type, "out" or "in"), ...] from ``starts``.

    One equi-join per step; ``score`` is the product and ``length`` the sum of the edge weights.
    """
    walk = starts.select(F.array("id").alias("path"), F.col("id").alias("_at"), F.lit(1.0).alias("score"), F.lit(0.0).alias("length"))
    for kind, way in pattern:
        a, b = ("src", "dst") if way == "out" else ("dst", "src")
        step = edges.where(F.col("type") == kind).select(F.col(a).alias("_at"), F.col(b).alias("_to"), F.col(weight).cast("double").alias("_w"))
        walk = (walk.join(step, "_at").where(~F.array_contains("path", F.col("_to")))
                .select(F.concat("path", F.array("_to")).alias("path"), F.col("_to").alias("_at"),
                        (F.col("score") * F.col("_w")).alias("score"), (F.col("length") + F.col("_w")).alias("length")))
    return walk.drop("_at")


def rank_trim(df: DataFrame, weights: dict[str, float], n: int, key: str = "id") -> DataFrame:
    """Top ``n`` rows by the weighted sum of the given columns; missing values count 0."""
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("score", score).orderBy(F.desc("score"), key).limit(n)


def contact_order(edges: DataFrame) -> list[Column]:
    """Weight descending (missing 1), distance ascending (missing last), then the ends."""
    w = F.coalesce(F.element_at("props", "w").try_cast("double"), F.lit(1.0))
    dist = F.coalesce(F.element_at("props", "dist").try_cast("double"), F.lit(999999.0))
    return [w.desc(), dist.asc(), F.col("src"), F.col("dst")]


def structure_subgraph(nodes: DataFrame, edges: DataFrame, protein: str, model: str, max_residues: int | None = None,
                       max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A protein, its structure if there is one, the residues of that model's contacts (up to ``max_residues``), and the
    contacts among them (the best ``max_edges``). Residues are made distinct before a cap; without one all are returned.
    """
    pid, sid = f"Protein:{protein}", f"Structure:{model}"
    own = edges.where((F.col("type") == "HAS_RESIDUE") & (F.col("src") == pid)).select(F.col("dst").alias("src"))
    contacts = (edges.where((F.col("type") == "CONTACTS") & (F.element_at("props", "model_id") == model))
                .join(own, "src", "left_semi"))
    ends = contacts.select(F.col("src").alias("id")).union(contacts.select("dst")).distinct()
    residues = _first(nodes.where(F.array_contains("labels", "Residue")).join(ends, "id", "left_semi"),
                      [F.element_at("props", "pos").try_cast("int").asc_nulls_last(), "id"], max_residues)
    kept = residues.select("id")
    inside = (contacts.join(kept.withColumnRenamed("id", "src"), "src", "left_semi")
              .join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    best = _first(inside, contact_order(inside), max_edges)
    link = edges.where((F.col("type") == "HAS_STRUCTURE") & (F.col("src") == pid) & (F.col("dst") == sid))
    linked = link.select(F.col("dst").alias("id"))
    structure = nodes.where(F.col("id") == sid).join(linked, "id", "left_semi")
    head = nodes.where(F.col("id") == pid)
    none = F.create_map().cast("map<string,string>")
    shown = ["model_id", "contact_type", "chain", "w", "dist"]
    slim = best.withColumn("props", F.map_filter("props", lambda k, _: k.isin(shown)))
    sub_nodes, sub_edges = slim_props(head.unionByName(residues).unionByName(structure)), slim.unionByName(link.withColumn("props", none))
    if head.isEmpty():  # without the protein there is no result at all
        return sub_nodes.where(F.lit(False)), sub_edges.where(F.lit(False))
    return sub_nodes, sub_edges


def residue_degrees(edges: DataFrame) -> DataFrame:
    """Contacts per residue, both ends counted."""
    contacts = edges.where(F.col("type") == "CONTACTS")
    ends = contacts.select(F.col("src").alias("id")).unionAll(contacts.select("dst"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def prune_by_degree(nodes: DataFrame, edges: DataFrame, max_nodes: int | None = None, ord_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """All other nodes, then residues by contact degree until ``max_nodes``, if given; edges between kept nodes.

    Ties keep ``ord_col`` order.
    """
    if max_nodes is None:
        return nodes, restrict_edges(edges, nodes)
    is_residue = F.array_contains("labels", "Residue")
    others = nodes.where(~is_residue)
    budget = max(0, max_nodes - others.count())
    residues = (nodes.where(is_residue).join(residue_degrees(edges), "id", "left")
                .withColumn("degree", F.coalesce("degree", F.lit(0)))
                .orderBy(F.desc("degree"), ord_col).limit(budget).drop("degree"))
    kept = others.unionByName(residues)
    return kept, restrict_edges(edges, kept)


def restrict_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("id").distinct()
    return (edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
            .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))


def cap_edges(edges: DataFrame, max_edges: int | None = None) -> DataFrame:
    """Every other edge, and all contacts or the best ``max_edges``; weight or distance 0 counts as missing."""
    number = lambda name, missing: F.coalesce(F.nullif(F.element_at("props", name).try_cast("double"), F.lit(0.0)), F.lit(missing))
    contacts = edges.where(F.col("type") == "CONTACTS")
    best = _first(contacts, [number("w", 1.0).desc(), number("dist", 999999.0).asc(), "src", "dst"], max_edges)
    return edges.where(F.col("type") != "CONTACTS").unionByName(best)


def short_ids(nodes: DataFrame, edges: DataFrame, order: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Rename ids to ``n0, n1, ...`` in node order, in both tables."""
    placed = ranked(nodes, [], order or [F.col("id")], "_n")
    ids = placed.select("id", F.concat(F.lit("n"), F.col("_n") - 1).alias("short"))
    renamed = placed.join(ids, "id").drop("id", "_n").withColumnRenamed("short", "id").select(*nodes.columns)
    out = edges
    for end in ("src", "dst"):
        out = (out.join(ids.select(F.col("id").alias(end), F.col("short").alias(f"_{end}")), end, "left")
               .withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}"))
    return renamed, out.select(*edges.columns)


def slim_props(nodes: DataFrame, others: int | None = None) -> DataFrame:
    """Known labels keep their listed properties; others all of them, or the first ``others`` by name."""
    names = F.array_sort(F.map_keys("props"))
    keep = names if others is None else F.slice(names, 1, others)
    for label, keys in reversed(list(SLIM_KEYS.items())):
        keep = F.when(F.array_contains("labels", label), F.array(*[F.lit(k) for k in keys])).otherwise(keep)
    kept = nodes.withColumn("_keep", keep)
    return kept.withColumn("props", F.map_filter("props", lambda k, _: F.array_contains("_keep", k))).drop("_keep")


def snapshot(nodes: DataFrame, edges: DataFrame, **meta) -> DataFrame:
    """One nested row from node and edge tables, which bound its size."""
    node, edge = F.struct("id", "labels", "props"), F.struct("src", "dst", "type", "props")
    n_type = "struct<id:string,labels:array<string>,props:map<string,string>>"
    e_type = "struct<src:string,dst:string,type:string,props:map<string,string>>"
    rows = (nodes.select(node.cast(n_type).alias("n"), F.lit(None).cast(e_type).alias("e"))
            .unionByName(edges.select(F.lit(None).cast(n_type).alias("n"), edge.cast(e_type).alias("e"))))
    # Maps cannot be compared, so the lists are sorted by their text fields.
    packed = rows.agg(F.array_sort(F.collect_list("n"), _by_id).alias("nodes"), F.array_sort(F.collect_list("e"), _by_ends).alias("edges"))
    return packed.select(*[F.lit(v).alias(k) for k, v in meta.items()], "nodes", "edges")


def _compare(*pairs):
    out = F.lit(0)
    for a, b in reversed(pairs):
        out = F.when(a < b, -1).when(a > b, 1).otherwise(out)
    return out


def _by_id(a, b):
    return _compare((a["id"], b["id"]))


def _by_ends(a, b):
    return _compare((a["src"], b["src"]), (a["dst"], b["dst"]), (a["type"], b["type"]))


def pack_snapshot(nodes: DataFrame, edges: DataFrame, **meta) -> DataFrame:
    """The snapshot as one compact JSON text in ``snapshot_json``."""
    row = snapshot(nodes, edges, **meta)
    return row.select(F.to_json(F.struct(*row.columns)).alias("snapshot_json"))


def cap_snapshot_json(snapshots: DataFrame, limit: int | None = None, max_nodes: int | None = None, max_edges: int | None = None) -> Column:
    """Compact JSON of snapshot rows, whole; if a caller gives limits, documents above ``limit`` characters keep their first nodes and edges."""
    rest = [c for c in snapshots.columns if c not in ("nodes", "edges")]
    full = F.to_json(F.struct(*rest, "nodes", "edges"))
    if limit is None:
        return full
    part = lambda name, n: (F.col(name) if n is None else F.slice(name, 1, n)).alias(name)
    slim = F.to_json(F.struct(*rest, part("nodes", max_nodes), part("edges", max_edges)))
    return F.when(F.length(full) > limit, slim).otherwise(full)


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def contact_stats(edges: DataFrame, n: int | None = None) -> DataFrame:
    """Contacts per model and contact type, largest first: all groups, or the first ``n``."""
    known = lambda k: F.coalesce(F.element_at("props", k), F.lit("unknown")).alias(k)
    out = (edges.where(F.col("type") == "CONTACTS").groupBy(known("model_id"), known("contact_type"))
           .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "model_id", "contact_type"))
    return out if n is None else out.limit(n)


def rank_candidates(assays: DataFrame, toxicity: DataFrame, target: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Ligands per target by best (lowest) assay value, with reasons and risks.

    ``assays``: ligand_id, uniprot_id, metric, value, units. ``toxicity``: ligand_id, flag, severity.
    Ligands without flags come first among equal values; risks are one text per distinct flag.
    """
    rows = assays.where(F.col("uniprot_id").isin(target)) if target else assays
    best = (rows.where(F.col("value").isNotNull()).groupBy("uniprot_id", "ligand_id")
            .agg(F.min_by(F.struct("metric", "value", "units"), F.struct("value", "metric")).alias("b"), F.count(F.lit(1)).alias("n_assays")))
    # Distinct (flag, severity) pairs first: the risk list is bounded by the flag vocabulary.
    flags = toxicity.select("ligand_id", F.concat_ws(":", "flag", "severity").alias("risk")).distinct()
    risks = flags.groupBy("ligand_id").agg(F.array_sort(F.collect_list("risk")).alias("risks"))
    why = F.array(F.concat_ws(" ", "b.metric", F.col("b.value").cast("string"), "b.units"), F.concat(F.col("n_assays"), F.lit(" assays")))
    joined = best.join(risks, "ligand_id", "left").select(
        "uniprot_id", "ligand_id", F.col("b.value").alias("best_value"), "n_assays", why.alias("why"),
        F.coalesce("risks", F.array().cast("array<string>")).alias("risks"))
    order = [F.col("best_value"), F.size("risks"), F.col("ligand_id")]
    if top:
        return first_n(joined, ["uniprot_id"], order, top, "rank")
    # Written once, because ranking measures the groups first.
    return ranked(cut(joined), ["uniprot_id"], order, "rank")
