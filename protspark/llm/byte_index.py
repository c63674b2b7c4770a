"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits agree in at least 8 - 4 = 4 of their 8 byte positions. The
index therefore lists fingerprints under the values of each set of four byte positions; every pair in reach meets in
a list, its shared positional bytes are tallied, pairs below the guaranteed minimum go, and the rest is verified by
counting differing bits. A pair is reported only in the first list where it meets.

A list that is longer than ``hot`` is not paired. Its members are linked through midpoints instead: two
fingerprints are within 4 bits if and only if both are within 2 bits of a common value, so each member is
listed under all values within 2 bits and each such list becomes a star. Both ways find the same components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from protspark.functions.lineage import cut
from protspark.llm.common import LOWEST, WORD_BYTES, id_of, key_of, map_batches
from protspark.llm.components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SHINGLE, SEED, RADIUS = 4, 42, 4
SETS = list(combinations(range(8), 8 - RADIUS))
HOT_LIST = 2_000
PART = 1 << 16  # rows that the reader of the lists holds back


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the word shingles, each occurrence one vote; 0 without words."""
    words = WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b %b" % s for s in zip(words, words[1:], words[2:], words[3:])]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, len(shingles), 1 << 14):
        block = b"".join([digest(s, SEED) for s in shingles[k:k + (1 << 14)]])
        ones += np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    def start():
        def step(ids, texts):
            values = np.array([fingerprint(t) for t in texts], np.uint64)
            return ids, values.view(np.int64)
        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, fp long", start)


class _Lists:
    """Reads index entries in list order and gives pairs, or marks the members of lists that are too long.

    Lists below the limit may still hold very many pairs, so these are given in parts of about ``part`` rows.
    """

    def __init__(self, hot: int, part: int = PART):
        self.hot, self.part, self.too_long = hot, part, None
        self.left = (np.zeros(0, np.int64),) * 3

    def __call__(self, keys, fps, nodes):
        new = [np.array(x, np.int64) for x in (keys, fps, nodes)]
        key, fp, node = (np.concatenate(x) for x in zip(self.left, new))
        last = np.searchsorted(key, key[-1])  # the last list may go on in the next slice
        yield from self._parts(key[:last], fp[:last], node[:last])
        if key[-1] == self.too_long or len(key) - last > self.hot:
            self.too_long = int(key[-1])
            yield node[last:], np.full(len(key) - last, LOWEST), fp[last:]
            last = len(key)
        self.left = (key[last:], fp[last:], node[last:])

    def finish(self):
        yield from self._parts(*self.left)

    def _parts(self, key, fp, node):
        out, rows = [], 0
        for found in self._pairs(key, fp, node):
            out.append(found)
            rows += len(found[0])
            if rows >= self.part:
                yield [np.concatenate(x) for x in zip(*out)]
                out, rows = [], 0
        if out:
            yield [np.concatenate(x) for x in zip(*out)]

    def _pairs(self, key, fp, node):
        at = np.arange(len(key))
        if self.too_long is not None:  # its last entries
            rest = key == self.too_long
            if rest.any():
                yield node[rest], np.full(int(rest.sum()), LOWEST), fp[rest]
                at = at[~rest]
        gap = 1
        while len(at := at[at + gap < len(key)]) and len(at := at[key[at] == key[at + gap]]):
            other = at + gap
            differ = fp[at] ^ fp[other]
            same = np.ascontiguousarray(differ).view(np.uint8).reshape(-1, 8)[:, ::-1] == 0  # position 0 is the highest byte
            tally = same.sum(axis=1)
            first = np.array(SETS)[key[at] >> 32]
            prefix = np.cumsum(same, axis=1)  # the first four shared positions are this list's positions
            here = same[np.arange(len(at))[:, None], first].all(axis=1) & (prefix[np.arange(len(at)), first[:, -1]] == 8 - RADIUS)
            keep = (tally >= 8 - RADIUS) & here & (np.bitwise_count(differ.view(np.uint64)) <= RADIUS)
            if keep.any():
                yield node[at[keep]], node[other[keep]], fp[at[keep]]
            gap += 1


def _index_keys() -> list:
    byte = [F.shiftrightunsigned(F.col("fp"), 56 - 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = []
    for k, places in enumerate(SETS):
        value = F.lit(k << 32).cast("long")
        for n, p in enumerate(places):
            value = value.bitwiseOR(F.shiftleft(byte[p], 24 - 8 * n))
        keys.append(value)
    return keys


def _midpoint_masks() -> list[int]:
    flips = [0] + [1 << a for a in range(64)] + [1 << a | 1 << b for a, b in combinations(range(64), 2)]
    return [x - (1 << 64) if x >> 63 else x for x in flips]


def _midpoint_stars(members: DataFrame) -> DataFrame:
    masks = "explode(array(" + ",".join("(-9223372036854775807L - 1L)" if x == LOWEST else f"{x}L" for x in _midpoint_masks()) + "))"
    mids = members.select("a", "fp", F.expr(masks).alias("mask")).select("a", F.col("fp").bitwiseXOR(F.col("mask")).alias("mid"))
    leads = mids.groupBy("mid").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return mids.join(leads, "mid").where("a != b").select("a", "b").distinct()


def fingerprint_links(nodes: DataFrame, hot: int = HOT_LIST) -> DataFrame:
    """Edges (a, b) between nodes (node, fp), fingerprints distinct, that connect exactly what links at <= 4 bits do."""
    listed = nodes.select(F.explode(F.array(*_index_keys())).alias("key"), "fp", "node")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = cut(map_batches(listed.repartition(parts, "key").sortWithinPartitions("key"), "a long, b long, fp long", lambda: _Lists(hot), rows=1 << 16))
    pairs = met.where(F.col("b") != LOWEST).select("a", "b")
    members = met.where(F.col("b") == LOWEST).select("a", "fp").distinct()
    if members.isEmpty():
        return pairs
    return cut(pairs.union(_midpoint_stars(members)))


def near_duplicates(docs: DataFrame, hot: int = HOT_LIST) -> DataFrame:
    """doc_id, fingerprint, component_id for every row.

    Equal fingerprints are one node, named by its smallest id, so copies are never paired. Null and empty texts have
    fingerprint zero and are linked like any other; a null id is the smallest. An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs).select(key_of().alias("key"), "fp"))
    nodes = cut(rows.groupBy("fp").agg(F.min("key").alias("node")))
    roots = components(_shifted(nodes, hot), "a", "b")
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component"))
    return rows.join(named, "fp").select(
        id_of("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        id_of("component").alias("component_id"))


def _shifted(nodes: DataFrame, hot: int) -> DataFrame:
    """Links of the nodes; the lowest key marks list members there, so a null id travels as the next one."""
    null_id = F.when(F.col("node") == LOWEST, F.lit(LOWEST + 1)).otherwise(F.col("node"))
    back = lambda c: F.when(F.col(c) == LOWEST + 1, F.lit(LOWEST)).otherwise(F.col(c)).alias(c)
    return fingerprint_links(nodes.select("fp", null_id.alias("node")), hot).select(back("a"), back("b"))


def one_of_each(docs: DataFrame, hot: int = HOT_LIST) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Rows are told apart by id and text, so each row without an id, or with an id that stands twice, is judged by its own
    text; rows equal in both are one. A node is named by its fingerprint, since ids need not be distinct here.
    """
    def start():
        def step(keys, ties, texts):
            return keys, ties, np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return step

    keyed = docs.select(key_of().alias("_key"), F.xxhash64("text").alias("_tie"), F.struct(*docs.columns).alias("_row"))
    rows = cut(map_batches(keyed.select("_key", "_tie", "_row.text"), "key long, tie long, fp long", start))
    # The lowest value marks list members; the next one is linked to it anyway.
    node = F.greatest(F.col("fp"), F.lit(LOWEST + 1)).alias("node")
    roots = components(fingerprint_links(rows.select("fp", node).distinct(), hot), "a", "b")
    parts = rows.select("key", "tie", node).join(roots, "node", "left").select("key", "tie", F.coalesce("root", "node").alias("part"))
    kept = parts.groupBy("part").agg(F.min(F.struct("key", "tie")).alias("f")).select(F.col("f.key").alias("_key"), F.col("f.tie").alias("_tie"))
    return (keyed.join(kept, ["_key", "_tie"], "left_semi").dropDuplicates(["_key", "_tie"])
            .select(*[F.col("_row")[c].alias(c) for c in docs.columns]))
