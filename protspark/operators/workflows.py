"""The two question-to-answer chains, as compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from protspark.functions.columns import render_prompt
from protspark.functions.lineage import cut
from protspark.operators import retrieval as R
from protspark.operators.alignments import align_pairs, map_aligned
from protspark.operators.geometry import canonical_positions, contacts
from protspark.sources.structures import chain_sequences, choose_chain, read_residues


def contact_rows(spark: SparkSession, root: str, structures: DataFrame, targets: DataFrame, cutoff: float = 8.0) -> DataFrame:
    """Structure files to contact rows of their longest chains, on canonical positions where the target
    sequence is known and on chain positions elsewhere.

    ``structures``: model_id, uniprot_id. ``targets``: uniprot_id, sequence.
    """
    residues = cut(read_residues(spark, root))
    longest = cut(choose_chain(residues, "longest"))
    placed = longest.where(F.col("x").isNotNull()).join(structures.select("model_id", "uniprot_id"), "model_id")
    # Positions count the located residues of one chain.
    w = Window.partitionBy("model_id").orderBy("idx")
    located = cut(placed.withColumn("idx", F.row_number().over(w) - 1))
    known = targets.where((F.trim("sequence") != "") & (F.lower("sequence") != "nan")).select("uniprot_id", F.trim("sequence").alias("target"))
    seqs = chain_sequences(longest).join(structures, "model_id").join(known, "uniprot_id").select("model_id", F.col("sequence").alias("query"), "target")
    mapping = map_aligned(align_pairs(seqs, ["model_id"], "canonical"), ["model_id"]).select("model_id", F.col("q_idx").alias("idx"), (F.col("t_idx") + 1).alias("pos"))
    rows = canonical_positions(contacts(located, cutoff), mapping)
    end = lambda e: located.select("model_id", F.col("idx").alias(e), F.col("aa").alias(f"aa_{e}"))
    heads = located.select("model_id", "uniprot_id", "chain").distinct()
    named = rows.join(end("i"), ["model_id", "i"]).join(end("j"), ["model_id", "j"]).join(heads, "model_id")
    return named.select("uniprot_id", "chain", F.col("i_pos").alias("i"), "aa_i", F.col("j_pos").alias("j"), "aa_j", "w", "dist", "model_id", "contact_type")


def question_prompt(nodes: DataFrame, edges: DataFrame, question: str, template: str, k: int | None = None, max_nodes: int | None = None,
                    max_edges: int | None = None) -> DataFrame:
    """Search, expand, prune and cap (as far as limits are given), shorten and pack the graph, and fill ``{{question}}`` and ``{{snapshot_json}}``.

    ``nodes`` and ``edges`` are stored tables. What follows the search is read several times by the next
    steps and is written once each.
    """
    found, touching = (cut(t) for t in R.expand(nodes, edges, cut(R.seed_nodes(nodes, question, k))))
    kept, inner = (cut(t) for t in R.prune_by_degree(found, touching, max_nodes))
    short, renamed = R.short_ids(R.slim_props(kept), R.cap_edges(inner, max_edges))
    packed = R.pack_snapshot(short, renamed, query=question, k=k)
    return packed.select("snapshot_json", render_prompt(template, {"question": F.lit(question), "snapshot_json": "snapshot_json"}).alias("prompt"))
