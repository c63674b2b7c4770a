"""Best-of, first-of, percentile and dedup operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protspark.functions.lineage import cut
from protspark.functions.ordered import exact_quantiles, ranked, running_totals
from protspark.functions.skew import first_n

STATS = ["pident", "alnlen", "qstart", "qend", "evalue", "bits"]


def top_hits(hits: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Best row per (query, subject), then all subjects per query or the best ``max_hits``, with ``rank``.

    Lowest e-value first, then highest bits, then input order; missing values last.
    """
    order = [F.col("evalue").asc_nulls_last(), F.col("bits").desc_nulls_last(), F.col("ord")]
    # The best row of a subject is a combinable minimum: nulls become the largest sort values.
    key = F.struct(F.coalesce("evalue", F.lit(float("inf"))), F.coalesce(-F.col("bits"), F.lit(1e9)), F.col("ord"))
    rest = [c for c in hits.columns if c not in ("query", "subject")]
    best = hits.groupBy("query", "subject").agg(F.min_by(F.struct(*rest), key).alias("_r")).select("query", "subject", "_r.*")
    if max_hits is None:
        return ranked(cut(best), ["query"], order, "rank")
    return first_n(best, ["query"], order, max_hits, "rank")


def first_subjects(hits: DataFrame, n: int) -> DataFrame:
    """First ``n`` distinct subjects per query in input order; statistics are unknown (null)."""
    seen = hits.groupBy("query", "subject").agg(F.min("ord").alias("ord"))
    kept = first_n(seen, ["query"], ["ord"], n, "rank")
    return kept.select("*", *[F.lit(None).cast("double").alias(s) for s in STATS])


def top_mutations(scan: DataFrame, k: int = 10, by: str = "reward", ord_col: str = "ord") -> DataFrame:
    """The ``k`` largest rewards; ties keep input order."""
    return scan.orderBy(F.col(by).desc_nulls_last(), ord_col).limit(k)


def top_edges(edges: DataFrame, k: int = 10, by: str = "grad_gmem_A") -> DataFrame:
    return edges.orderBy(F.col(by).desc_nulls_last(), "i", "j").limit(k)


def best_structure(candidates: DataFrame, accessions: DataFrame, cap: int | None = None) -> DataFrame:
    """Best structure per accession by coverage, then resolution; accessions without one fall back.

    Missing coverage is 0 and an unreadable resolution 9.9. ``accessions``: uniprot, ord; with ``cap``
    only the first ones by ``ord`` are looked up.
    """
    accs = accessions.orderBy("ord", "uniprot").limit(cap) if cap else accessions
    cov = F.coalesce(F.col("coverage").cast("double"), F.lit(0.0))
    res = F.coalesce(F.col("resolution").cast("string").try_cast("double"), F.lit(9.9))
    score = F.struct(-cov, res, F.col("pdb_id"))
    row = F.struct(F.upper("pdb_id").alias("pdb_id"), "chain_id", "coverage", "resolution", F.lit("PDB").alias("source"))
    best = candidates.groupBy("uniprot").agg(F.min_by(row, score).alias("b"))
    return accs.join(best, "uniprot", "left").select(
        "uniprot", "b.pdb_id", F.coalesce("b.chain_id", F.lit("")).alias("chain_id"), "b.coverage", "b.resolution",
        F.coalesce("b.source", F.lit("AFDB")).alias("source"))


def topk_pairs(scores: DataFrame, by: list[str], k: int | None = None, length: str | None = None, thr: float = 0.5) -> DataFrame:
    """Best pairs ``i < j`` per id with a thresholded ``pred``; ``k`` fixed, or the id's ``length`` column.

    ``k`` is at least 1; the number of pairs bounds it by itself.
    """
    upper = scores.where(F.col("i") < F.col("j"))
    order = [F.desc("score"), F.col("i"), F.col("j")]
    if k is not None:
        kept = first_n(upper, by, order, max(1, k), "rank")
    else:
        kept = ranked(upper, by, order, "rank").where(F.col("rank") <= F.greatest(F.col(length), F.lit(1)))
    return kept.withColumn("pred", F.col("score") >= thr)


def percentile_edges(edges: DataFrame, by: list[str], weight: str = "weight", q: float = 0.95) -> DataFrame:
    """Edges strictly above the group's ``q`` quantile (linear interpolation), with the ``threshold``."""
    limits = exact_quantiles(edges, by, weight, [q]).withColumnRenamed("q0", "threshold")
    if by:
        return edges.join(limits, by).where(F.col(weight) > F.col("threshold"))
    value = limits.first()[0]
    return edges.where(F.col(weight) > value).withColumn("threshold", F.lit(value))


def endpoints(edges: DataFrame, by: list[str]) -> DataFrame:
    """Distinct end nodes."""
    return edges.select(*by, F.col("i").alias("id")).union(edges.select(*by, "j")).distinct()


def top_central(scores: DataFrame, valid: DataFrame, by: list[str], metric: str, k: int = 5) -> DataFrame:
    """Top ``k`` nodes of a metric among the valid ids."""
    usable = scores.join(valid.select(*by, "id").distinct(), [*by, "id"], "left_semi")
    return first_n(usable, by, [F.desc(metric), F.col("id")], k, "rank")


def rank_of(df: DataFrame, by: list[str], score: str, key: str = "id", order: Column | None = None) -> DataFrame:
    """1-based place of each row in the group's descending score list; ties by ``key``."""
    return ranked(df, by, [F.desc(score), order if order is not None else F.col(key)], "rank")


def topk_hit_rate(df: DataFrame, by: list[str], metric: str, hit: str, key: str, k: int = 10) -> DataFrame:
    """Share of groups whose ``hit`` row is among the first ``k`` of the metric."""
    top = first_n(df, by, [F.desc(metric), F.col(key)], k)
    found = top.groupBy(*by).agg(F.max(F.col(hit).cast("int")).alias("found"))
    return found.agg(F.avg("found").alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def dedup_sequences(df: DataFrame, seq: str = "seq", ord_col: str = "ord") -> DataFrame:
    """First row of each distinct sequence.

    Copies are found by digest, so whole texts are moved once per kept row and a text with very many
    copies is reduced before the shuffle. The digest is 256 bits wide.
    """
    digest = F.sha2(F.col(seq), 256)
    first = df.groupBy(digest.alias("_d")).agg(F.min(ord_col).alias(ord_col)).select(ord_col)
    return df.join(first, ord_col, "left_semi")


def collect_accessions(hits: DataFrame, term: str, key: str, ord_col: str, n: int | None = None) -> DataFrame:
    """Each key once at its first place, of all hits or of the first ``n`` per term."""
    head = hits if n is None else first_n(hits, [term], [ord_col], n)
    return head.groupBy(key).agg(F.min(ord_col).alias(ord_col))


def uniquify_names(df: DataFrame, name: str = "name", ord_col: str = "ord") -> DataFrame:
    """Add ``unique_name``: repeats of a name become ``name_2``, ``name_3``, ... skipping taken names.

    A repeat only skips suffixed names that the table itself holds, whatever their place, so the result
    does not depend on which of two clashing rows comes first. The i-th taken number s has ``s - 1 - i`` free numbers
    before it, so the r-th repeat's number is r + 1 and the taken numbers with fewer than r free ones before them: one running
    count over repeats and taken numbers in order, without a list per name.
    """
    placed = ranked(df, [name], [F.col(ord_col)], "_k")
    taken = (df.select(F.col(name).alias("_t")).distinct().where(F.col("_t").rlike(r"_\d+$"))
             .select(F.regexp_replace("_t", r"_\d+$", "").alias("_name"), F.regexp_extract("_t", r"_(\d+)$", 1).try_cast("long").alias("_s"))
             .where(F.col("_s") >= 2).distinct())
    marks = ranked(taken, ["_name"], [F.col("_s")], "_i").select("_name", (F.col("_s") - 1 - F.col("_i")).alias("_pos"), F.lit(1).alias("_taken"), F.col("_s").alias("_id"))
    asks = placed.select(F.col(name).alias("_name"), (F.col("_k") - 1).alias("_pos"), F.lit(0).alias("_taken"), F.lit(None).cast("long").alias("_id"), F.struct(*df.columns).alias("_row"))
    both = running_totals(asks.unionByName(marks, allowMissingColumns=True), ["_name"], [F.col("_pos"), F.col("_taken"), F.col("_id")], {"_before": F.col("_taken")})
    unique = F.when(F.col("_pos") == 0, F.col("_name")).otherwise(F.concat(F.col("_name"), F.lit("_"), (F.col("_pos") + 1 + F.col("_before")).cast("string")))
    return both.where(F.col("_taken") == 0).select("_row.*", unique.alias("unique_name"))


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key is not in the output yet; failed rows in the output count as done."""
    return inputs.join(done.select(key), key, "left_anti")


def cap(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def crop_len(df: DataFrame, seq: str, max_len: int) -> DataFrame:
    """Crop sequences of a table to the length a trainer accepts."""
    return df.withColumn(seq, F.substring(seq, 1, max_len))
