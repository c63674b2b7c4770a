"""Near copies by exact similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Every pair in reach is found, without a fingerprint's chance of missing it. If shingles have one order for all texts, two
texts at 0.8 share one of the first n - ceil(0.8 n) + 1 of their n shingles (prefix filter), so only those are listed;
texts that meet in a list and whose sizes allow 0.8 are compared by their whole sets. The order puts shingles of crowded
count buckets last, which keeps lists short; any order gives the same result.

Components are wanted, not pairs. In a list of over ``hot`` texts each is first compared with its next neighbours. What
these comparisons joined is not paired again; every pair of the list that is still apart then is compared.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from protspark.functions.lineage import cut
from protspark.llm.common import WORD_BYTES, key_of, map_batches
from protspark.llm.components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SHINGLE, SEED = 5, 42
BUCKET_BITS, KEY_BITS = 16, 20
HOT_LIST, NEXT = 200, 8
CACHE_WORDS, SEEN_NODES = 300_000, 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, SEED)
        return out


def shingles(text: str | None, words: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text of fewer than five words is one shingle, one without words none."""
    found = WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(SHINGLE, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h += w[k:len(h) + k] * _ODD[k]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return np.unique(h ^ (h >> np.uint64(29)))


def _node(h: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(h.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def prefix(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which two sets at 0.8 share one, in the order by bucket count and hash."""
    keep = len(h) - (4 * len(h) + 4) // 5 + 1
    return h[np.lexsort((h, counts[_bucket(h)]))[:keep]] if len(h) else h


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(key_of().alias("key"), F.xxhash64("text").alias("tie"), "text")


class _Mark:
    """A node per row, named by its shingle set; at the end the counts of the task's shingles by bucket."""

    def __init__(self):
        self.words, self.counts = _Words(), np.zeros(1 << BUCKET_BITS, np.int64)

    def __call__(self, keys, ties, texts):
        nodes = []
        for t in texts:
            h = shingles(t, self.words)
            nodes.append(_node(h))
            self.counts += np.bincount(_bucket(h), minlength=len(self.counts))
        return keys, ties, nodes, [False] * len(keys)

    def finish(self):
        at = np.flatnonzero(self.counts)
        return at, self.counts[at], np.zeros(len(at), np.int64), [True] * len(at)


class _Entries:
    """(shingle, node, n) of each prefix, once a node and task."""

    def __init__(self, counts: np.ndarray):
        self.words, self.counts, self.seen = _Words(), counts, set()

    def __call__(self, texts):
        out = []
        if len(self.seen) > SEEN_NODES:
            self.seen.clear()
        for t in texts:
            h = shingles(t, self.words)
            node = _node(h)
            if len(h) and node not in self.seen:
                self.seen.add(node)
                p = prefix(h, self.counts).view(np.int64)
                out.append((p, np.full(len(p), node), np.full(len(p), len(h), np.int32)))
        return [np.concatenate(x) for x in zip(*out)] if out else None


def _fits(n, m) -> np.ndarray:
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


class _Lists:
    """Reads entries in list order; gives pairs (a, b, 0, 0), and the members of long lists as (node, node, shingle, n)."""

    def __init__(self, hot: int):
        self.hot, self.left = hot, (np.zeros(0, np.int64),) * 3

    def __call__(self, *columns):
        s, node, n = (np.concatenate([x, np.array(y, np.int64)]) for x, y in zip(self.left, columns))
        last = np.searchsorted(s, s[-1])  # the last list may go on in the next slice
        self.left = (s[last:], node[last:], n[last:])
        return self._pairs(s[:last], node[:last], n[:last])

    def finish(self):
        return self._pairs(*self.left)

    def _pairs(self, s, node, n):
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (node[1:] != node[:-1])
        s, node, n = s[new], node[new], n[new]
        _, of, size = np.unique(s, return_inverse=True, return_counts=True)
        long = size[of] > self.hot if len(s) else np.zeros(0, bool)
        out, at, gap = [], np.arange(len(s)), 1
        while len(at := at[at + gap < len(s)]) and len(at := at[s[at] == s[at + gap]]):
            if gap > NEXT:
                at = at[~long[at]]
            keep = at[_fits(n[at], n[at + gap])]
            out.append(np.stack([np.minimum(node[keep], node[keep + gap]), np.maximum(node[keep], node[keep + gap])]))
            gap += 1
        pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        zero = np.zeros(pairs.shape[1], np.int64)
        return [np.concatenate(x) for x in zip((*pairs, zero, zero), (node[long], node[long], s[long], n[long]))]


class _Apart:
    """Reads members of long lists; gives the pairs of a list that are in different components."""

    def __init__(self):
        self.left = (np.zeros(0, np.int64),) * 4

    def __call__(self, *columns):
        all_ = [np.concatenate([x, np.array(y, np.int64)]) for x, y in zip(self.left, columns)]
        last = np.searchsorted(all_[0], all_[0][-1])
        self.left = tuple(x[last:] for x in all_)
        return self._pairs(*[x[:last] for x in all_])

    def finish(self):
        return self._pairs(*self.left)

    def _pairs(self, s, node, n, part):
        out = []
        for at in np.split(np.arange(len(s)), np.flatnonzero(s[1:] != s[:-1]) + 1) if len(s) else []:
            _, of, size = np.unique(part[at], return_inverse=True, return_counts=True)
            for k in at[of != size.argmax()]:  # two of the largest component are never apart
                other = at[(part[at] != part[k]) & _fits(n[at], n[k])]
                out.append(np.stack([np.minimum(node[other], node[k]), np.maximum(node[other], node[k])]))
        return list(np.unique(np.concatenate(out, axis=1), axis=1)) if out else None


def _similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have a similarity of 0.8 or more."""
    pairs = cut(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    firsts = cut(nodes.join(wanted, "node", "left_semi").select("node", "first.key", "first.tie"))
    # Rows that cannot be wanted are passed over before their text is cut into shingles; the join decides.
    slot = F.pmod(F.xxhash64("key", "tie"), F.lit(1 << KEY_BITS)).cast("int")
    hit = np.zeros(1 << KEY_BITS, bool)
    hit[[r[0] for r in firsts.select(slot).distinct().collect()]] = True
    bits = np.packbits(hit)

    def start():
        words = _Words()

        def step(keys, ties, slots, texts):
            at = [k for k, x in enumerate(slots) if bits[x >> 3] >> (7 - (x & 7)) & 1]
            if not at:
                return None
            found = [shingles(texts[k], words) for k in at]
            return [keys[k] for k in at], [ties[k] for k in at], [_node(h) for h in found], [h.view(np.int64) for h in found]
        return step

    rows = _rows(docs).select("key", "tie", slot.alias("slot"), "text")
    sets = map_batches(rows, "key long, tie long, node long, set array<long>", start, rows=128)
    sets = cut(sets.join(firsts, ["key", "tie", "node"], "left_semi").dropDuplicates(["node"]).select("node", "set"))
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("_sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("set").alias("_sb")), "b"))
    shared = F.size(F.array_intersect("_sa", "_sb"))
    return cut(both.where(9 * shared >= 4 * (F.size("_sa") + F.size("_sb"))).select("a", "b"))  # s / (n + m - s) >= 4 / 5


def _named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return nodes.join(components(links, "a", "b"), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")


def near_copies(docs: DataFrame, hot: int = HOT_LIST) -> DataFrame:
    """(node, first, part): shingle sets, the smallest (id, text hash) of their rows, and their components."""
    marked = cut(map_batches(_rows(docs), "key long, tie long, node long, counted boolean", _Mark))
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for k, n in marked.where("counted").groupBy("key").agg(F.sum("tie")).collect():  # one number a bucket
        counts[k] = n
    nodes = cut(marked.where("NOT counted").groupBy("node").agg(F.min(F.struct("key", "tie")).alias("first")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = map_batches(docs.select("text"), "shingle long, node long, n int", lambda: _Entries(counts), rows=128)
    listed = entries.repartition(parts, "shingle").sortWithinPartitions("shingle", "node")
    met = cut(map_batches(listed, "a long, b long, shingle long, n long", lambda: _Lists(hot), rows=1 << 16))
    links = _similar(docs, nodes, met.where("a != b").select("a", "b"))
    named = cut(_named(nodes, links))
    members = met.where("a = b").select(F.col("a").alias("node"), "shingle", "n")
    if members.isEmpty():
        return named
    placed = members.join(named.select("node", "part"), "node").select("shingle", "node", "n", "part")
    apart = map_batches(placed.repartition(parts, "shingle").sortWithinPartitions("shingle"), "a long, b long", _Apart, rows=1 << 16)
    return _named(nodes, links.union(_similar(docs, nodes, apart)))


def one_of_each(docs: DataFrame, hot: int = HOT_LIST) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays.

    Rows are told apart by id and text, so each row without an id, or with an id that stands twice, is judged by its own
    text. Rows equal in both are one; all rows without words are one component.
    """
    kept = near_copies(docs, hot).groupBy("part").agg(F.min("first").alias("f")).select(F.col("f.key").alias("_key"), F.col("f.tie").alias("_tie"))
    keyed = docs.select(key_of().alias("_key"), F.xxhash64("text").alias("_tie"), F.struct(*docs.columns).alias("_row"))
    return (keyed.join(kept, ["_key", "_tie"], "left_semi").dropDuplicates(["_key", "_tie"])
            .select(*[F.col("_row")[c].alias(c) for c in docs.columns]))
