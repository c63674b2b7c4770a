"""Splits and samples that depend on a key and a seed only, never on partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from protspark.functions.ordered import ranked
from protspark.functions.skew import first_n


def shuffle_key(key: str, seed: int = 42) -> Column:
    """Pseudo-random text per key and seed, the same in every run and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


PREFIX = 4  # hexadecimal digits of the hash that one scan counts
FEW = 1_000  # hashes that may come to the driver


def _boundaries(hashes: DataFrame, ranks: Callable[[int], list[int]]) -> tuple[list[int], list[tuple[str, int, int]]]:
    """The hashes at given places of the sorted order, found by counting digits: no row is sorted or moved.

    ``hashes`` has one column ``_h``. Each scan counts the next ``PREFIX`` digits of the hashes that still matter (at most
    65 536 numbers). Per place: its hash, the rows below that hash, and the rows with it.
    """
    def counted(prefix: str) -> list[tuple[str, int]]:
        rows = hashes.where(F.col("_h").startswith(prefix)) if prefix else hashes
        digits = rows.groupBy(F.substring("_h", len(prefix) + 1, PREFIX).alias("d")).count()
        return sorted((r[0], r[1]) for r in digits.collect())

    first = counted("")
    places = ranks(sum(n for _, n in first))
    out = []
    for place in places:
        prefix, below, bins = "", 0, first
        while True:
            for digit, n in bins:
                if below + n >= place:
                    break
                below += n
            prefix += digit
            if n <= FEW or len(prefix) >= 32:
                break
            bins = counted(prefix)
        same = hashes.where(F.col("_h").startswith(prefix)).groupBy("_h").count().collect()  # at most FEW hashes, or one
        for h, n in sorted((r[0], r[1]) for r in same):
            if below + n >= place:
                break
            below += n
        out.append((h, below, n))
    return places, out


def _parts(df: DataFrame, key: str, seed: int, ranks: Callable[[int], list[int]]) -> DataFrame:
    """Add ``_part``: how many of the places ``ranks(number of rows)``, in rising order, lie before the row.

    Rows are ordered by the hash of the key. If a place falls among rows of one hash, which are rows of one key, these alone
    are ranked.
    """
    keyed = df.withColumn("_h", shuffle_key(key, seed))
    if df.isEmpty():
        return keyed.withColumn("_part", F.lit(0)).drop("_h")
    places, found = _boundaries(keyed.select("_h"), ranks)
    part, torn = F.lit(len(places)), {}
    for k in reversed(range(len(places))):
        h, below, n = found[k]
        part = F.when(F.col("_h") <= h, k).otherwise(part)
        if below + n != places[k]:
            torn[h] = below
    whole = keyed.where(~F.col("_h").isin(list(torn))) if torn else keyed
    out = whole.withColumn("_part", part)
    for h, below in torn.items():
        order = [F.col(key), F.xxhash64(*[c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()])]
        rows = ranked(keyed.where(F.col("_h") == h), [], order, "_n")
        at = F.lit(len(places))
        for k in reversed(range(len(places))):
            at = F.when(F.col("_n") + below <= places[k], k).otherwise(at)
        out = out.unionByName(rows.withColumn("_part", at).drop("_n"))
    return out.drop("_h")


def split_exact(df: DataFrame, key: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: exactly ``max(1, round(frac*n))`` validation rows; a single row is both (``both``)."""
    sizes = []

    def ranks(n: int) -> list[int]:
        sizes[:] = n, max(1, round(frac * n))
        return [sizes[1]]

    parts = _parts(df, key, seed, ranks)
    n, n_val = sizes or (0, 0)
    return parts.withColumn("split", F.when(F.col("_part") == 0, "val" if n > n_val else "both").otherwise("train")).drop("_part")


def split_fraction(df: DataFrame, key: str, frac: float, seed: int = 42, cap: int | None = None) -> DataFrame:
    """First ``max(1, floor(frac*n))`` shuffled rows train, the others validation; optional cap after shuffling."""
    def ranks(n: int) -> list[int]:
        n = n if cap is None else min(cap, n)
        return [max(1, int(n * frac)), n]

    placed = _parts(df, key, seed, ranks).where(F.col("_part") < 2)
    return placed.withColumn("split", F.when(F.col("_part") == 0, "train").otherwise("val")).drop("_part")


def split_three(df: DataFrame, key: str, fracs: tuple[float, float] = (0.70, 0.15), seed: int = 42) -> DataFrame:
    """Exact train / validation / test parts by shuffled row."""
    parts = _parts(df, key, seed, lambda n: [int(n * fracs[0]), int(n * (fracs[0] + fracs[1]))])
    return parts.withColumn("split", F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), F.col("_part") + 1)).drop("_part")


def split_by_group(df: DataFrame, group: str, frac: float = 0.8, seed: int = 42) -> DataFrame:
    """Exact split of the distinct groups; all rows of a group go the same way."""
    groups = df.select(group).distinct()
    return df.join(split_fraction(groups, group, frac, seed), group)


def predefined_split(df: DataFrame, set_col: str = "set", validation_col: str = "validation") -> DataFrame:
    """``train`` / ``valid`` / ``test`` from given columns; a missing validation flag is false."""
    flag = F.coalesce(F.col(validation_col), F.lit(False)) if validation_col in df.columns else F.lit(False)
    part = F.when(F.col(set_col) == "test", "test").when((F.col(set_col) == "train") & flag, "valid").when(F.col(set_col) == "train", "train")
    return df.withColumn("split", part).where(F.col("split").isNotNull())


def balanced_pairs(pairs: DataFrame, by: list[str], key: str, label: str = "y", ratio: int = 3, max_pos: int | None = None,
                   max_pairs: int | None = 20_000, seed: int = 42) -> DataFrame:
    """All positives (up to ``max_pos``), ``ratio`` negatives per positive, at most ``max_pairs`` per example.

    Sampling is the operator's purpose: the caps choose rows by hash, without replacement. An example
    without positives gives nothing.
    """
    counts = pairs.groupBy(*by).agg(F.sum(F.col(label).cast("long")).alias("_p"))
    n_pos = F.least(F.col("_p"), F.lit(max_pos)) if max_pos else F.col("_p")
    quota = counts.select(*by, n_pos.alias("_np"), (n_pos * max(1, ratio)).alias("_nn"))
    keyed = pairs.withColumn("_h", shuffle_key(key, seed))
    placed = ranked(keyed, [*by, label], [F.col("_h"), F.col(key)], "_n").join(quota, by)
    kept = placed.where(F.col("_n") <= F.when(F.col(label) == 1, F.col("_np")).otherwise(F.col("_nn"))).drop("_n", "_np", "_nn")
    if max_pairs:
        kept = first_n(kept, by, ["_h", key], max_pairs).drop("_rn")
    return kept.drop("_h")


def sample_cap(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, by hash order."""
    return df.withColumn("_h", shuffle_key(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def sample_frac(df: DataFrame, key: str, frac: float, seed: int = 42) -> DataFrame:
    """About ``frac`` of the rows: those whose hash falls below the share."""
    limit = format(math.floor(frac * 16 ** 8), "08x")
    return df.where(F.substring(shuffle_key(key, seed), 1, 8) < limit)


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, bucket_rows: int = 100_000) -> DataFrame:
    """Add ``fold`` 0..k-1 of near-equal size: shuffled place modulo ``k``.

    The place is the number of rows in hash buckets before the row's, counted in one scan, and its rank inside its bucket of
    about ``bucket_rows`` rows.
    """
    keyed = df.withColumn("_h", shuffle_key(key, seed))
    counts = sorted((r[0], r[1]) for r in keyed.groupBy(F.substring("_h", 1, PREFIX).alias("d")).count().collect())  # at most 65 536 numbers
    n, digits = sum(c for _, c in counts), 1
    while digits < PREFIX and n / 16**digits > bucket_rows:
        digits += 1
    before, total = {}, 0
    for d, c in counts:
        before.setdefault(d[:digits], total)
        total += c
    starts = df.sparkSession.createDataFrame(list(before.items()) or [("", 0)], "_b string, _before long")
    w = Window.partitionBy("_b").orderBy("_h", key)
    placed = keyed.withColumn("_b", F.substring("_h", 1, digits)).withColumn("_n", F.row_number().over(w)).join(F.broadcast(starts), "_b")
    return placed.withColumn("fold", F.pmod(F.col("_before") + F.col("_n") - 1, F.lit(k)).cast("int")).select(*df.columns, "fold")


def fold_means(df: DataFrame, metric: Column) -> DataFrame:
    """Mean of the per-fold metric, over all folds in one job."""
    return df.groupBy("fold").agg(metric.alias("m")).agg(F.avg("m").alias("mean_metric"), F.count(F.lit(1)).alias("folds"))
