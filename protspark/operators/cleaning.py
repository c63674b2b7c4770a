"""Cleaning of variant, fitness and label tables, and per-position features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protspark.functions.columns import aa3_to_aa1, aa_one_hot, clip, coalesce_nonempty, one_hot
from protspark.functions.vectors import as_double
from protspark.schemas import DDG_ALIASES


def clean_variants(df: DataFrame, na: str = "drop", first_letter: bool = True) -> DataFrame:
    """``pos`` to int, residue letters upper, and a policy for missing scores.

    ``drop`` the row, fill ``zero``, or ``dropany`` row with any missing field.
    """
    letter = (lambda c: F.substring(F.upper(c), 1, 1)) if first_letter else F.upper
    score = F.col("score").cast("string").try_cast("double")
    score = F.when(~F.isnan(score), score)
    rows = df.withColumns({"pos": F.col("pos").cast("string").try_cast("double").try_cast("int"),
                           "wt": letter(F.col("wt")), "mut": letter(F.col("mut")), "score": score})
    if "uniprot" not in rows.columns:
        rows = rows.withColumn("uniprot", F.lit(None).cast("string"))
    if na == "zero":
        rows = rows.na.fill(0.0, ["score"])
    elif na == "dropany":
        rows = rows.na.drop(subset=["pos", "wt", "mut", "score"])
    else:
        rows = rows.na.drop(subset=["score"])
    return rows.select("uniprot", "pos", "wt", "mut", "score")


def clean_fitness(df: DataFrame, source: str = "normalized_fitness", lo: float = -5.0, hi: float = 5.0) -> DataFrame:
    """Rename to ``fitness``, drop what is no number, clip."""
    renamed = df.withColumnRenamed(source, "fitness")
    number = F.col("fitness").cast("string").try_cast("double")
    return renamed.withColumn("fitness", number).where(F.col("fitness").isNotNull() & ~F.isnan("fitness")).withColumn("fitness", clip("fitness", lo, hi))


def label_stability(df: DataFrame) -> DataFrame:
    """``pdb_id, position, ddG`` without nulls, four-letter ids, and ``label`` 1 where ddG is negative."""
    kept = df.select("pdb_id", "position", "ddG").na.drop().where(F.length("pdb_id") == 4)
    return kept.withColumn("label", F.when(F.col("ddG") < 0, 1).otherwise(0))


def node_features(nodes: DataFrame) -> DataFrame:
    """``features`` = coordinates followed by the residue one-hot; unknown residues act as glycine."""
    aa = aa3_to_aa1("resname", "standard", "G")
    return nodes.withColumn("features", F.concat(as_double(F.array("x", "y", "z")), aa_one_hot(aa)))


def demo_node_features(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """``features`` = residue one-hot, position fraction, degree fraction, radius from the centroid, z."""
    ends = edges.select(*by, F.col("i").alias("idx")).unionByName(edges.select(*by, F.col("j").alias("idx")))
    degree = ends.groupBy(*by, "idx").agg(F.count(F.lit(1)).alias("deg"))
    center = nodes.groupBy(*by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"),
                                    F.max("idx").alias("last"))
    joined = nodes.join(degree, [*by, "idx"], "left").join(center, by).withColumn("deg", F.coalesce("deg", F.lit(0)))
    n_1 = F.greatest(F.col("last"), F.lit(1))
    radius = F.sqrt(sum(((F.col(a) - F.col(f"c{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    extra = as_double(F.array(F.col("idx") / n_1, F.col("deg") / n_1, radius, F.col("z")))
    return joined.withColumn("features", F.concat(aa_one_hot("aa"), extra)).drop("deg", "cx", "cy", "cz", "last")


def edge_features(edges: DataFrame) -> DataFrame:
    """``features`` = ``[dist, w, g_mem]``, missing entries 1."""
    return edges.withColumn("features", as_double(F.array(*[F.coalesce(F.col(c), F.lit(1.0)) for c in ("dist", "w", "g_mem")])))


def concat_features(left: DataFrame, right: DataFrame, mode: str = "pad", right_dim: int | None = None,
                    depth: DataFrame | None = None) -> DataFrame:
    """Join two ``(id, idx, vec)`` tables per position and concatenate their vectors.

    ``pad`` keeps the left positions and fills zeros, ``crop`` keeps common positions, ``strict`` fails
    when the lengths of an id differ. An id without any right row keeps its left vector, with
    ``right_present`` false. ``depth`` (id, depth) adds one more channel.
    """
    r = right.withColumnRenamed("vec", "_r")
    if depth is not None:
        r = r.join(depth, "id").withColumn("_r", F.concat(as_double("_r"), F.array(F.col("depth").cast("double")))).drop("depth")
        right_dim = right_dim + 1 if right_dim is not None else None
    present = right.groupBy("id").agg(F.count(F.lit(1)).alias("_nr"))
    base = left.join(present, "id", "left")
    if mode == "strict":
        lengths = left.groupBy("id").agg(F.count(F.lit(1)).alias("_nl"))
        base = base.join(lengths, "id").withColumn("_ok", F.assert_true(F.col("_nr").isNull() | (F.col("_nr") == F.col("_nl")), "length mismatch"))
        base = base.where(F.col("_ok").isNull()).drop("_ok", "_nl")
    joined = base.join(r, ["id", "idx"], "left")
    if mode == "crop":
        joined = joined.where(F.col("_nr").isNull() | F.col("_r").isNotNull())
    if mode != "crop" and right_dim is None:
        raise ValueError("pad and strict need right_dim")
    zeros = F.array_repeat(F.lit(0.0), right_dim or 0)
    if depth is not None and right_dim:
        zeros = F.array_repeat(F.lit(0.0), right_dim)
    fill = F.coalesce(as_double("_r"), zeros)
    vec = F.when(F.col("_nr").isNull(), as_double("vec")).otherwise(F.concat(as_double("vec"), fill))
    return joined.select("id", "idx", vec.alias("vec"), F.col("_nr").isNotNull().alias("right_present"))


def binarize_scores(scores: DataFrame, by: list[str], thr: float = 0.5) -> DataFrame:
    """Mean of (i,j) and (j,i) with a zero diagonal, and a flag at ``thr``.

    Both directions are folded onto ``i < j`` and combined by aggregation; a missing direction counts 0.
    """
    i, j = F.least("i", "j"), F.greatest("i", "j")
    folded = scores.where(F.col("i") != F.col("j")).groupBy(*by, i.alias("i"), j.alias("j")).agg((F.sum("score") / 2).alias("score"))
    return folded.withColumn("contact", (F.col("score") >= thr).cast("int"))


def sequence_choice(queries: DataFrame, seqres: DataFrame, atom: DataFrame) -> DataFrame:
    """Query sequence: given, else SEQRES, else ATOM, else ``X`` repeated ``length`` times."""
    joined = (queries.join(seqres.select("query_id", F.col("seq").alias("_s")), "query_id", "left")
              .join(atom.select("query_id", F.col("seq").alias("_a")), "query_id", "left"))
    seq = F.coalesce(coalesce_nonempty("sequence", "_s", "_a"), F.expr("repeat('X', int(coalesce(length, 0)))"))
    source = (F.when(coalesce_nonempty("sequence").isNotNull(), "given").when(coalesce_nonempty("_s").isNotNull(), "seqres")
              .when(coalesce_nonempty("_a").isNotNull(), "atom").otherwise("unknown"))
    return joined.select("query_id", seq.alias("seq"), source.alias("source"))


def graph_targets(proteins: DataFrame, scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Per protein: mean finite score and mean of the first known stability column, 0 where missing."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    number = lambda c: finite(F.col(c).cast("string").try_cast("double"))
    activity = scores.groupBy("uniprot").agg(F.avg(number("score")).alias("A_target"))
    by_lower = {c.lower(): c for c in labels.columns}
    alias = next((by_lower[a.lower()] for a in DDG_ALIASES if a.lower() in by_lower), None)
    stability = labels.groupBy("uniprot").agg((F.avg(number(alias)) if alias else F.lit(0.0)).alias("ddG_target"))
    return (proteins.join(activity, "uniprot", "left").join(stability, "uniprot", "left")
            .na.fill(0.0, ["A_target", "ddG_target"]))


def position_features(positions: DataFrame, annotations: DataFrame, centralities: DataFrame, labels: DataFrame,
                      key: list[str] = ["pdb_id", "position"]) -> DataFrame:
    """Labelled feature rows: position/1000, secondary-structure one-hot (coil default), area, centralities."""
    joined = (labels.join(positions, key).join(annotations, key, "left").join(centralities, key, "left"))
    ss = one_hot("ss", ["H", "E", "C"], default="C")
    filled = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return joined.select(
        *key, "ddG", (F.col("position") / 1000).alias("position_frac"),
        *[F.element_at(ss, k + 1).alias(f"ss_{s.lower()}") for k, s in enumerate("HEC")],
        *[filled(c).alias(c) for c in ("sasa", "memory", "betweenness", "closeness", "eigen")])


def drop_malformed(df: DataFrame, required: list[str], same_length: tuple[Column, Column] | None = None) -> DataFrame:
    """Add ``reason`` (null = good): first missing required field, or lengths that disagree."""
    reason = F.lit(None).cast("string")
    if same_length:
        reason = F.when(same_length[0] != same_length[1], "length mismatch")
    for c in reversed(required):
        reason = F.when(F.col(c).isNull(), f"missing {c}").otherwise(reason)
    return df.withColumn("reason", reason)
