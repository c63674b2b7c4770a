"""Alignment profiles. Row form is ``(msa_id, row_id, seq)``; one row is one aligned sequence.

Row ``row_id`` 0-or-lowest is the query. All counts are aggregations over exploded letters, combined on
the map side, so a very deep alignment is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from protspark.functions.lineage import cut
from protspark.functions.skew import first_n, spread
from protspark.schemas import AMINO_ACIDS

GAP = "-"
LETTERS = list(AMINO_ACIDS)


def letters(msa: DataFrame) -> DataFrame:
    """Long form ``(msa_id, row_id, col, ch)``."""
    return msa.select("msa_id", "row_id", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("col", "ch"))


def depth(msa: DataFrame) -> DataFrame:
    return msa.groupBy("msa_id").agg(F.count(F.lit(1)).alias("depth"))


def query_rows(msa: DataFrame) -> DataFrame:
    """First row of each alignment."""
    return msa.groupBy("msa_id").agg(F.min_by("seq", "row_id").alias("seq"))


def filter_rows(msa: DataFrame, max_seqs: int | None = None) -> DataFrame:
    """Rows as wide as the first one; optionally the first ``max_seqs`` of them."""
    width = msa.groupBy("msa_id").agg(F.min_by(F.length("seq"), "row_id").alias("_w"))
    same = msa.join(width, "msa_id").where(F.length("seq") == F.col("_w")).drop("_w")
    return first_n(same, ["msa_id"], ["row_id"], max_seqs).drop("_rn") if max_seqs else same


def profile_freq(msa: DataFrame) -> DataFrame:
    """Share of each letter per column over all rows: ``(msa_id, col, ch, freq)``; all else counts as gap."""
    ch = F.when(F.col("ch").isin(LETTERS), F.col("ch")).otherwise(GAP).alias("ch")
    counts = letters(msa).groupBy("msa_id", "col", ch).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(depth(msa), "msa_id").select("msa_id", "col", "ch", (F.col("n") / F.col("depth")).alias("freq"))


def col2pos(msa: DataFrame) -> DataFrame:
    """Alignment column to query position, null on query gaps."""
    w = Window.partitionBy("msa_id").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    cols = query_rows(msa).select("msa_id", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("col", "ch"))
    return cols.select("msa_id", "col", F.when(F.col("ch") != GAP, F.sum((F.col("ch") != GAP).cast("int")).over(w) - 1).alias("pos"))


def pssm(msa: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Letter frequencies over the non-gap rows per query position: ``(msa_id, pos, ch, freq, coverage)``.

    Letters outside the twenty are ``other``. Positions nobody covers, up to the query length or the
    ``expected`` one (msa_id, length), have one row with null ``ch`` and coverage 0.
    """
    mapped = col2pos(msa).where(F.col("pos").isNotNull())
    lengths = mapped.groupBy("msa_id").agg((F.max("pos") + 1).alias("_q"))
    if expected is not None:
        lengths = lengths.join(expected, "msa_id", "left").select("msa_id", F.coalesce("length", "_q").alias("_q"))
    spine = lengths.select("msa_id", F.explode(F.expr("sequence(0, int(_q) - 1)")).alias("pos"))
    ch = F.when(F.col("ch").isin(LETTERS), F.col("ch")).otherwise("other").alias("ch")
    counts = letters(msa).where(F.col("ch") != GAP).groupBy("msa_id", "col", ch).agg(F.count(F.lit(1)).alias("n"))
    at_pos = counts.join(mapped, ["msa_id", "col"])
    w = Window.partitionBy("msa_id", "pos")  # one row per letter
    freq = at_pos.select("msa_id", "pos", "ch", "n", F.sum("n").over(w).alias("_t"))
    return (spine.join(freq, ["msa_id", "pos"], "left").join(depth(msa), "msa_id")
            .select("msa_id", "pos", "ch", (F.col("n") / F.col("_t")).alias("freq"), (F.coalesce("_t", F.lit(0)) / F.col("depth")).alias("coverage")))


def profile_entropy(msa: DataFrame) -> DataFrame:
    """Entropy (natural log) of the twenty-letter frequencies per column; alignments of depth <= 1 give 0."""
    counts = letters(msa).groupBy("msa_id", "col", "ch").agg(F.count(F.lit(1)).alias("n")).join(depth(msa), "msa_id")
    p = F.col("n") / F.col("depth")
    term = F.when(F.col("ch").isin(LETTERS) & (F.col("depth") > 1), -p * F.log(p + 1e-12)).otherwise(0.0)
    return counts.groupBy("msa_id", "col").agg(F.sum(term).alias("entropy"))


def mi_inputs(msa: DataFrame, min_depth: int = 10, max_len: int | None = None) -> DataFrame:
    """Per alignment its ``depth`` and ``length``, and why ``column_mi`` leaves it out: null, ``shallow`` or ``wide``."""
    shape = msa.groupBy("msa_id").agg(F.count(F.lit(1)).alias("depth"), F.min_by(F.length("seq"), "row_id").alias("length"))
    wide = F.when(F.col("length") > max_len, "wide") if max_len else F.lit(None).cast("string")
    return shape.withColumn("reason", F.when(F.col("depth") < min_depth, "shallow").otherwise(wide))


TILE = 64  # columns of a tile
ROWS_PER_TILE = 100_000  # rows of one alignment that one sorted run of a tile pair takes


def _tiles(msa: DataFrame, tile: int, rows_per_tile: int) -> DataFrame:
    """(msa_id, ta, tb, sa, sb), dealt out and sorted by alignment and pair of tiles.

    Sequences are cut into tiles of ``tile`` columns and travel once per pair of tiles, as two short strings. Alignments of more
    than ``rows_per_tile`` rows are dealt out by row too.
    """
    salts = msa.groupBy("msa_id").agg(F.ceil(F.count(F.lit(1)) / rows_per_tile).cast("int").alias("_salts"))
    cells = F.expr(f"""explode(flatten(transform(sequence(0, cast(ceil(length(seq) / {tile}) as int) - 1),
        x -> transform(sequence(x, cast(ceil(length(seq) / {tile}) as int) - 1), y -> struct(x AS ta, y AS tb)))))""")
    cut_at = lambda t: F.expr(f"substring(seq, {t} * {tile} + 1, {tile})")
    keys = ["msa_id", "ta", "tb"]
    tiles = (msa.where(F.length("seq") > 0).join(salts, "msa_id").withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.col("_salts")))
             .select("msa_id", "seq", "_salt", cells.alias("_c")).select("msa_id", "_c.ta", "_c.tb", "_salt", "seq")
             .select(*keys, "_salt", cut_at("ta").alias("sa"), cut_at("tb").alias("sb")))
    return spread(tiles, *keys, "_salt").sortWithinPartitions(*keys).drop("_salt")


def letter_pairs(msa: DataFrame, tile: int = TILE, rows_per_tile: int = ROWS_PER_TILE) -> DataFrame:
    """(msa_id, a, b, ca, cb, n): rows in which columns ``a < b`` hold the amino acids ``ca`` and ``cb``.

    A tile of rows is a matrix with one column per (column, letter), and one matrix product counts all letter pairs of two
    tiles. A task holds one such table of counts at a time, as its rows come sorted. The counts of an alignment that was
    dealt out by row are in several result rows.
    """
    key_type = msa.schema["msa_id"].dataType.simpleString()
    return _tiles(msa, tile, rows_per_tile).mapInArrow(partial(_count_tiles, tile, _pair_rows), f"msa_id {key_type}, a int, b int, ca string, cb string, n long")


def _pair_rows(counts: np.ndarray) -> list[pa.Array]:
    k, names = len(LETTERS), pa.array(LETTERS)
    at_a, at_b = np.nonzero(counts)
    pick = lambda at: names.take(pa.array(at % k))
    return [pa.array(at_a // k, pa.int32()), pa.array(at_b // k, pa.int32()), pick(at_a), pick(at_b), pa.array(np.rint(counts[at_a, at_b]).astype(np.int64))]


def _mi_rows(counts: np.ndarray) -> list[pa.Array]:
    """Mutual information of the tiles' column pairs that share a row, from complete counts."""
    k = len(LETTERS)
    n = counts.reshape(len(counts) // k, k, -1, k).transpose(0, 2, 1, 3)
    total = n.sum(axis=(2, 3))
    a, b = np.nonzero(total)
    p = n[a, b] / (total[a, b] + 1e-9)[:, None, None]
    single = np.log(p.sum(axis=2) + 1e-12)[:, :, None] + np.log(p.sum(axis=1) + 1e-12)[:, None, :]
    return [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array((p * (np.log(p + 1e-12) - single)).sum(axis=(1, 2)))]


def _hot(strings: list[str], width: int) -> np.ndarray:
    """Rows of a tile as 0 and 1: one column per (column, amino acid)."""
    k = len(LETTERS)
    codes = np.full((len(strings), width), k, np.int64)
    known = np.full(0x110000, k, np.int64) if any(not s.isascii() for s in strings) else np.full(128, k, np.int64)
    known[[ord(c) for c in LETTERS]] = np.arange(k)
    flat = known[np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)]
    sizes = np.array([len(s) for s in strings])
    codes[np.arange(width) < sizes[:, None]] = flat
    out = np.zeros((len(strings), width * (k + 1)), np.float32)
    out[np.arange(len(strings))[:, None], np.arange(width) * (k + 1) + codes] = 1.0
    return out.reshape(len(strings), width, k + 1)[:, :, :k].reshape(len(strings), width * k)


def _count_tiles(tile: int, finish: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter-pair counts of each run of one alignment and pair of tiles, given on as ``finish`` makes rows of them.

    Its first two columns are the places in the tiles; only pairs ``a < b`` of the whole alignment are kept.
    """
    k = len(LETTERS)
    key, counts = None, None

    def done() -> pa.RecordBatch:
        a, b, *rest = finish(counts)
        a, b = pc.add(a, pa.scalar(key[1] * tile, pa.int32())), pc.add(b, pa.scalar(key[2] * tile, pa.int32()))
        ids = pa.array([key[0].as_py()], key[0].type).take(pa.array(np.zeros(len(a), np.int64)))
        columns = [ids, a, b, *rest]
        names = ["msa_id", "a", "b", "mi"] if len(rest) == 1 else ["msa_id", "a", "b", "ca", "cb", "n"]
        return pa.RecordBatch.from_arrays(columns, names).filter(pc.less(a, b))

    for batch in batches:
        ta, tb = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        ids = batch.column(0).dictionary_encode()
        code = ids.indices.to_numpy(zero_copy_only=False)
        code = np.where(np.isnan(code), -1, code) if code.dtype.kind == "f" else code
        new = np.r_[True, (code[1:] != code[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])]
        heads = np.flatnonzero(new)
        for s, e in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows]):
            here = (batch.column(0)[s], int(ta[s]), int(tb[s]))
            if key is None or (key[0].as_py(), *key[1:]) != (here[0].as_py(), *here[1:]):
                if key is not None:
                    yield done()
                key, counts = here, np.zeros((tile * k, tile * k))
            for at in range(s, e, 1024):
                part = batch.slice(at, min(1024, e - at))
                left = _hot(part.column(3).to_pylist(), tile)
                right = left if here[1] == here[2] else _hot(part.column(4).to_pylist(), tile)
                counts += left.T @ right
    if key is not None:
        yield done()


def column_mi(msa: DataFrame, min_depth: int = 10, max_len: int | None = None, tile: int = TILE, rows_per_tile: int = ROWS_PER_TILE) -> DataFrame:
    """Mutual information of every column pair ``a < b`` over rows where both hold an amino acid.

    Alignments below ``min_depth`` rows are left out, as are those wider than ``max_len`` if given; ``mi_inputs`` names them.
    The counts come from products of tiles, see ``letter_pairs``; those of up to ``rows_per_tile`` rows are complete in their task.
    """
    fit = mi_inputs(msa, min_depth, max_len).where(F.col("reason").isNull()).select("msa_id", "depth")
    used = msa.join(fit, "msa_id")
    key_type = msa.schema["msa_id"].dataType.simpleString()
    whole = _tiles(used.where(F.col("depth") <= rows_per_tile), tile, rows_per_tile)
    mi = whole.mapInArrow(partial(_count_tiles, tile, _mi_rows), f"msa_id {key_type}, a int, b int, mi double")
    return mi.unionByName(_mi_of_counts(letter_pairs(used.where(F.col("depth") > rows_per_tile), tile, rows_per_tile)))


def _mi_of_counts(pairs: DataFrame) -> DataFrame:
    """The same for alignments that several tasks counted."""
    counts = pairs.groupBy("msa_id", "a", "b", "ca", "cb").agg(F.sum("n").alias("n"))
    # At most 400 letter pairs per column pair, so these windows are small.
    part = counts.repartition("msa_id", "a", "b")
    w = Window.partitionBy("msa_id", "a", "b")
    total = part.withColumn("p", F.col("n") / (F.sum("n").over(w) + 1e-9))
    marg = total.withColumns({"pa": F.sum("p").over(Window.partitionBy("msa_id", "a", "b", "ca")),
                              "pb": F.sum("p").over(Window.partitionBy("msa_id", "a", "b", "cb"))})
    term = F.col("p") * (F.log(F.col("p") + 1e-12) - F.log(F.col("pa") + 1e-12) - F.log(F.col("pb") + 1e-12))
    return marg.groupBy("msa_id", "a", "b").agg(F.sum(term).alias("mi"))


def apc(mi: DataFrame, lengths: DataFrame) -> DataFrame:
    """Average-product correction; means are over the full square with a zero diagonal (``lengths``: msa_id, length)."""
    mi = cut(mi)  # read four times below
    both = mi.select("msa_id", F.col("a").alias("c"), "mi").unionAll(mi.select("msa_id", "b", "mi"))
    rows = both.groupBy("msa_id", "c").agg(F.sum("mi").alias("_s")).join(lengths, "msa_id")
    means = rows.select("msa_id", "c", (F.col("_s") / F.col("length")).alias("_m"))
    overall = both.groupBy("msa_id").agg(F.sum("mi").alias("_t")).join(lengths, "msa_id").select("msa_id", (F.col("_t") / (F.col("length") * F.col("length"))).alias("_g"))
    return (mi.join(means.select("msa_id", F.col("c").alias("a"), F.col("_m").alias("_ma")), ["msa_id", "a"])
            .join(means.select("msa_id", F.col("c").alias("b"), F.col("_m").alias("_mb")), ["msa_id", "b"])
            .join(overall, "msa_id")
            .select("msa_id", "a", "b", (F.col("mi") - F.col("_ma") * F.col("_mb") / (F.col("_g") + 1e-9)).alias("mi_apc")))


def henikoff_weights(msa: DataFrame) -> DataFrame:
    """Position-based sequence weights that sum to 1 per alignment; a gap is one more letter.

    The shares of an alignment's letters are one row, as long as the alignment is wide; each sequence looks its letters up in
    it. No row is keyed by (column, letter), so a column of gaps is no hot key.
    """
    counts = letters(msa).groupBy("msa_id", "col", "ch").agg(F.count(F.lit(1)).alias("n"))
    per_col = counts.groupBy("msa_id", "col").agg(F.collect_list(F.struct("ch", "n")).alias("_l"))
    share = F.expr("map_from_entries(transform(_l, x -> struct(x.ch, 1D / (size(_l) * x.n)))) AS _m")
    table = (per_col.select("msa_id", "col", share).groupBy("msa_id").agg(F.array_sort(F.collect_list(F.struct("col", F.map_entries("_m").alias("e")))).alias("_t"))
             .select("msa_id", F.expr("transform(_t, x -> map_from_entries(x.e))").alias("_t")))
    summed = F.expr("aggregate(transform(filter(split(seq, ''), c -> c <> ''), (c, k) -> _t[k][c]), 0D, (s, v) -> s + v)")
    raw = msa.join(table, "msa_id").where(F.length("seq") > 0).select("msa_id", "row_id", summed.alias("_w"))
    raw = raw.groupBy("msa_id", "row_id").agg(F.sum("_w").alias("_w"))
    total = raw.groupBy("msa_id").agg(F.sum("_w").alias("_t"))
    return raw.join(total, "msa_id").select("msa_id", "row_id", (F.col("_w") / F.col("_t")).alias("weight"))


def filter_homologs(hits: DataFrame, wild_type: DataFrame, max_identity: float = 90.0, min_len: int = 100, inclusive: bool = False) -> DataFrame:
    """Distinct homologs below an identity and above a length, after the wild type: ``(query_id, ord, seq)``.

    ``hits``: query_id, hseq, identity, align_len. ``wild_type``: query_id, seq.
    """
    pct = 100 * F.col("identity") / F.col("align_len")
    close = pct <= max_identity if inclusive else pct < max_identity
    kept = hits.where(close & (F.length("hseq") > min_len)).select("query_id", F.col("hseq").alias("seq")).distinct()
    others = kept.join(wild_type, ["query_id", "seq"], "left_anti")
    return (wild_type.select("query_id", F.lit(0).alias("is_homolog"), "seq")
            .unionByName(others.select("query_id", F.lit(1).alias("is_homolog"), "seq")))


def first_available(sources: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Per id the row of the first source that has one, with its ``provider``."""
    parts = None
    for k, (name, df) in enumerate(sources.items()):
        cols = [c for c in df.columns if c != key]
        part = df.select(key, F.lit(k).alias("_prio"), F.struct(F.lit(name).alias("provider"), *cols).alias("_row"))
        parts = part if parts is None else parts.unionByName(part)
    best = parts.groupBy(key).agg(F.min_by("_row", "_prio").alias("_row"))
    return best.select(key, "_row.*")


def channel_coverage(features: DataFrame, by: list[str], vec: str = "vec", channels: int = 21) -> DataFrame:
    """Share of non-zero cells in the last ``channels`` entries of the position vectors."""
    tail = F.slice(vec, -channels, channels)
    nonzero = F.size(F.filter(tail, lambda x: x != 0))
    return features.groupBy(*by).agg((F.sum(nonzero) / (F.count(F.lit(1)) * channels)).alias("coverage"))
