"""Mutant generation and scoring tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protspark.functions.columns import sigmoid
from protspark.functions.skew import spread
from protspark.schemas import AMINO_ACIDS


def _letters_but(wt: Column) -> Column:
    return F.filter(F.array(*[F.lit(a) for a in AMINO_ACIDS]), lambda a: a != wt)


def _placed(seq: Column, letter: Column, pos0: Column) -> Column:
    """``seq`` with one letter replaced at a 0-based position."""
    return F.overlay(seq, letter, pos0.cast("int") + 1, 1)


def point_mutants(seqs: DataFrame, positions: DataFrame, k: int = 5) -> DataFrame:
    """For each ranked position the first ``k`` letters other than the wild type, with the mutated sequence.

    ``seqs``: query_id, seq. ``positions``: query_id, ord, pos (0-based).
    """
    joined = positions.join(seqs, "query_id").where((F.col("pos") >= 0) & (F.col("pos") < F.length("seq")))
    wt = F.substring("seq", F.col("pos").cast("int") + 1, 1)
    rows = joined.select("query_id", "ord", "pos", "seq", wt.alias("wt_aa"), F.explode(F.slice(_letters_but(wt), 1, k)).alias("mut_aa"))
    return rows.select("query_id", "ord", "pos", "mut_aa", "wt_aa", _placed(F.col("seq"), F.col("mut_aa"), F.col("pos")).alias("mut_seq"))


def apply_mutations(seq: str | Column, mutations: str | Column) -> Column:
    """Apply ``A12V,K30R``: 1-based; malformed, out-of-range and stop mutations are ignored, later ones win."""
    s = F.col(seq) if isinstance(seq, str) else seq
    m = F.col(mutations) if isinstance(mutations, str) else mutations
    parts = F.transform(F.split(m, ","), lambda p: F.trim(p))
    usable = F.filter(parts, lambda p: p.rlike(r"^.\d+[^*]$"))

    def change(acc: Column, p: Column) -> Column:
        pos = F.substring(p, F.lit(2), F.length(p) - 2).try_cast("int")
        inside = (pos >= 1) & (pos <= F.length(acc))
        return F.when(inside, F.overlay(acc, F.right(p, F.lit(1)), pos, 1)).otherwise(acc)

    return F.aggregate(usable, s, change)


def mutate_table(wild_types: DataFrame, mutations: DataFrame) -> DataFrame:
    """One mutated sequence per mutation row; positions out of range are error rows; without rows, the wild type.

    ``wild_types``: query_id, seq. ``mutations``: query_id, position (1-based), new_aa.
    """
    joined = wild_types.join(mutations, "query_id", "left")
    inside = (F.col("position") >= 1) & (F.col("position") <= F.length("seq"))
    message = F.format_string("Position %d is out of range for sequence length %d", F.col("position"), F.length("seq"))
    sequence = (F.when(F.col("position").isNull(), F.col("seq"))
                .when(inside, _placed(F.col("seq"), F.trim("new_aa"), F.col("position") - 1)))
    return joined.select("query_id", "position", sequence.alias("sequence"), F.when(~inside, message).alias("error"))


def scan_space(seqs: DataFrame, with_sequences: bool = True) -> DataFrame:
    """Every position times the 19 other letters: ``(graph_id, pos, wt, mut[, seq_before, seq_after])``."""
    # A sequence grows to 19 L rows: spread the sequences first.
    chars = spread(seqs, "graph_id").select("graph_id", "seq", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("pos", "wt"))
    rows = chars.select("graph_id", "seq", "pos", "wt", F.explode(_letters_but(F.col("wt"))).alias("mut"))
    if not with_sequences:
        return rows.drop("seq")
    return rows.select("graph_id", "pos", "wt", "mut", F.col("seq").alias("seq_before"), _placed(F.col("seq"), F.col("mut"), F.col("pos")).alias("seq_after"))


def scan_rewards(scan: DataFrame, scores: DataFrame, baseline: DataFrame, w: tuple[float, float, float] = (1.0, 0.5, 0.05)) -> DataFrame:
    """Rewards of scanned variants, best first.

    ``scores``: graph_id, pos, mut, A_hat, ddG_hat. ``baseline``: graph_id, A0.
    """
    # Spark takes a scan for as small as its sequences and would send all of it to every executor.
    joined = scan.join(scores.hint("merge"), ["graph_id", "pos", "mut"]).join(baseline, "graph_id")
    delta = F.col("A_hat") - F.col("A0")
    penalty = F.greatest(F.lit(0.0), F.col("ddG_hat"))
    return (joined.withColumns({"delta_A": delta, "stability_penalty": penalty, "reward": w[0] * delta - w[1] * penalty - w[2]})
            .drop("A0").orderBy(F.desc("reward"), "graph_id", "pos", "mut"))


def score_variants(df: DataFrame, logit: Column, out: str = "predicted_score") -> DataFrame:
    """Sigmoid of a logit rounded to four places; ``logit`` may be the result of a pandas function."""
    return df.withColumn(out, F.round(sigmoid(logit), 4))


def prediction_summary(df: DataFrame, by: str, wild_type: str, score: str, ord_col: str) -> DataFrame:
    """Per request: wild-type length, number of mutants, and the predictions in order.

    A request is one row of the answer, so its list is as long as the request.
    """
    entry = F.array_sort(F.collect_list(F.struct(ord_col, score)))
    return df.groupBy(by).agg(F.max(F.length(wild_type)).alias("wt_length"), F.count(score).alias("num_mutants"),
                              F.transform(entry, lambda e: e[score]).alias("predictions"))
