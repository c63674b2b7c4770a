"""Substring dedup with super-k-mer partitioning.

A window is 50 consecutive words. Its minimiser is the least hash of the runs of eight words in it. Consecutive
windows with one minimiser form a super-k-mer and travel as one packed string to the bucket of the minimiser, where
the windows of all strings are sorted and each one's smallest document is found. Equal windows have equal minimisers,
so they always meet.

A minimiser that occurs in one document only cannot hold a repeated window, so its strings are never cut out of the
text. Equal strings of a bucket travel once, with their smallest document. A bucket with many different strings is
split into slices; the windows of its slices are then merged by an aggregation on the window itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from protspark.functions.lineage import cut
from protspark.llm.common import WORD_BYTES, id_of, key_of, map_batches, stored

WINDOW = 50
RUN = 8
MAX_WINDOWS = 64  # of one string, so that a text of one repeated word is cut too
SLICE_STRINGS = 2_000
CACHE_WORDS = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _words(text: str | None) -> list[bytes]:
    return WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass"))


def minimisers(hashes: np.ndarray, window: int = WINDOW, run: int = RUN) -> np.ndarray:
    """The minimiser of every window of a document."""
    n = len(hashes) - run + 1
    mixed = np.zeros(n, np.uint64)
    for j in range(run):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + n]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    span, width = 1, window - run + 1
    while span * 2 <= width:
        mixed = np.minimum(mixed[:-span], mixed[span:])
        span *= 2
    return np.minimum(mixed[:len(mixed) - (width - span)], mixed[width - span:])


def super_kmers(hashes: np.ndarray, window: int = WINDOW, run: int = RUN) -> list[tuple[int, int, int]]:
    """(minimiser as signed long, first window, number of windows)."""
    if len(hashes) < window:
        return []
    least = minimisers(hashes, window, run)
    cuts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])).tolist()
    signed = least.view(np.int64)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(least)]):
        m = int(signed[a])
        out += [(m, s, min(MAX_WINDOWS, b - s)) for s in range(a, b, MAX_WINDOWS)]
    return out


def _skeletons(docs: DataFrame, window: int, run: int) -> DataFrame:
    """Per row: id, hash of the text, word count, digest of all words, and its super-k-mers without text."""
    def start():
        known = _Hashes()

        def step(keys, hashes, texts):
            rows = []
            for key, th, text in zip(keys, hashes, texts):
                words = _words(text)
                mers = super_kmers(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), window, run)
                m, s, n = zip(*mers) if mers else ((), (), ())
                rows.append((key, th, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), list(m), list(s), list(n)))
            return [list(c) for c in zip(*rows)]
        return step

    rows = docs.select(key_of().alias("key"), F.xxhash64("text").alias("th"), "text")
    return map_batches(rows, "key long, th long, n_words long, sha string, ms array<long>, ss array<int>, ns array<int>", start)


def _candidates(skeletons: DataFrame) -> DataFrame:
    """(key, th, mers): super-k-mers whose minimiser occurs in two documents or more."""
    place = lambda x: F.shiftleft(x["ss"].cast("long"), 8) + x["ns"]
    mers = (skeletons.select("row", "key", F.explode(F.arrays_zip("ms", "ss", "ns")).alias("x"))
            .select("row", "key", F.col("x.ms").alias("m"), place(F.col("x")).alias("sn")))
    shared = mers.groupBy("m").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("m")
    own = mers.drop("key").join(shared, "m", "left_semi").groupBy("row").agg(F.collect_list(F.struct("m", "sn")).alias("mers"))
    unpacked = F.transform("mers", lambda x: F.struct(x["m"].alias("m"), F.shiftright(x["sn"], 8).cast("int").alias("s"), x["sn"].bitwiseAND(F.lit(255)).cast("int").alias("n")))
    return skeletons.select("row", "key", "th").join(own, "row").select("key", "th", unpacked.alias("mers")).dropDuplicates(["key", "th"])


def _packed(texts: DataFrame, window: int) -> DataFrame:
    """(m, key, th, s, packed): the candidate super-k-mers as strings of words joined by one space."""
    def start():
        def step(keys, hashes, texts, mers):
            rows = []
            for key, th, text, own in zip(keys, hashes, texts, mers):
                words = _words(text)
                rows += [(x["m"], key, th, x["s"], b" ".join(words[x["s"]:x["s"] + x["n"] + window - 1])) for x in own]
            return [list(c) for c in zip(*rows)] if rows else None
        return step

    return map_batches(texts.select("key", "th", "text", "mers"), "m long, key long, th long, s int, packed binary", start, rows=64)


def _windows(packed: bytes, window: int) -> list[bytes]:
    words = packed.split(b" ")
    return [b" ".join(words[k:k + window]) for k in range(len(words) - window + 1)]


class _Buckets:
    """Reads strings in bucket order; gives, per string, the smallest document of each of its windows in the bucket."""

    def __init__(self, window: int):
        self.window, self.held, self.bucket = window, [], None

    def __call__(self, ms, slices, slice_counts, ids, firsts, strings):
        out = []
        for m, part, parts, i, first, packed in zip(ms, slices, slice_counts, ids, firsts, strings):
            if (m, part) != self.bucket:
                out += self._close()
                self.bucket = (m, part)
            self.held.append((i, first, parts, packed))
        return [list(c) for c in zip(*out)] if out else None

    def finish(self):
        out = self._close()
        return [list(c) for c in zip(*out)] if out else None

    def _close(self):
        rows = [(w, first, n, k) for n, (_, first, _, packed) in enumerate(self.held) for k, w in enumerate(_windows(packed, self.window))]
        rows.sort()
        least = [[None] * (len(p.split(b" ")) - self.window + 1) for _, _, _, p in self.held]
        before, lead = None, None
        for w, first, n, k in rows:
            if w != before:
                before, lead = w, first
            least[n][k] = lead
        out = []
        for n, (i, _, parts, packed) in enumerate(self.held):
            texts = None if parts == 1 else [hashlib.md5(w).digest() for w in _windows(packed, self.window)]
            out.append((i, least[n], texts))
        self.held = []
        return out


def _least(strings: DataFrame, window: int, slice_strings: int) -> DataFrame:
    """(id, least): for each different string, the smallest document of each of its windows."""
    sizes = strings.groupBy("m").agg(F.ceil(F.count("*") / slice_strings).cast("int").alias("parts"))
    sliced = strings.join(sizes, "m").withColumn("part", F.pmod(F.col("id.b"), F.col("parts")).cast("int"))
    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sliced.repartition(parts, "m", "part").sortWithinPartitions("m", "part").select("m", "part", "parts", F.col("id"), "first", "packed")
    found = map_batches(dealt, "id struct<a: long, b: long>, least array<long>, texts array<binary>", lambda: _Buckets(window), rows=1024)
    found = cut(found)
    split = found.where("texts IS NOT NULL").select("id", F.posexplode(F.arrays_zip("texts", "least")).alias("k", "x")).select("id", "k", F.col("x.texts").alias("w"), F.col("x.least").alias("v"))
    merged = split.groupBy("w").agg(F.min("v").alias("v"))
    whole = (split.drop("v").join(merged, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("kv"))
             .select("id", F.col("kv.v").alias("least")))
    return found.where("texts IS NULL").select("id", "least").union(whole)


def repeated_words(docs: DataFrame, window: int = WINDOW, run: int = RUN, slice_strings: int = SLICE_STRINGS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row, kept words joined by one space.

    A word goes if a window over it also starts in a document with a smaller id. Null and empty texts, and texts
    shorter than a window, lose nothing. Rows with one id are one document with several texts and never remove from
    each other; repeated rows get equal results. A null id is the smallest.
    """
    rows = cut(_skeletons(docs, window, run)).withColumn("row", F.monotonically_increasing_id())
    mers = _candidates(rows)
    texts = docs.select(key_of().alias("key"), F.xxhash64("text").alias("th"), "text")
    texts = stored(texts.join(mers, ["key", "th"]).dropDuplicates(["key", "th"]), "candidate-texts")
    packed = _packed(texts, window)
    # a string's id is a 128-bit digest, with the bucket in it
    named = stored(packed.withColumn("id", F.struct(F.xxhash64("m", "packed").alias("a"), F.conv(F.substring(F.md5("packed"), 1, 15), 16, 10).cast("long").alias("b"))), "super-k-mers")
    strings = named.groupBy("m", "id").agg(F.min("key").alias("first"), F.any_value("packed").alias("packed"))
    least = _least(strings, window, slice_strings)
    hits = named.select("id", "key", "th", "s").join(least, "id")
    starts = F.filter(F.transform("least", lambda v, k: F.when(v < F.col("key"), F.col("s") + k)), lambda x: x.isNotNull())
    starts = hits.select("key", "th", starts.alias("at")).where(F.size("at") > 0)
    found = starts.groupBy("key", "th").agg(F.flatten(F.collect_list("at")).alias("at"))

    def start():
        def step(keys, hashes, texts, ats):
            out = []
            for key, th, text, at in zip(keys, hashes, texts, ats):
                words = _words(text)
                ends = np.zeros(len(words) + 1, np.int64)
                np.add.at(ends, at, 1)
                np.add.at(ends, np.array(at) + window, -1)
                keep = (np.cumsum(ends)[:-1] == 0).tolist()
                kept = [w for w, k in zip(words, keep) if k]
                out.append((key, th, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            return [list(c) for c in zip(*out)]
        return step

    changed = map_batches(texts.select("key", "th", "text").join(found, ["key", "th"]), "key long, th long, gone long, new_sha string", start)
    return rows.select("key", "th", "n_words", "sha").join(changed, ["key", "th"], "left").select(
        id_of("key").alias("doc_id"), "n_words", F.coalesce("gone", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("new_sha", "sha").alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, k, array_to_string(ws[k + 1:k + 50], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(greatest(0, len(ws) - 49))) AS k FROM d)),
f AS (SELECT t, min(doc_id) AS lo FROM w GROUP BY t),
gone AS (SELECT DISTINCT w.doc_id, unnest(range(w.k, w.k + 50)) AS p FROM w JOIN f ON w.t = f.t WHERE f.lo < w.doc_id),
p AS (SELECT doc_id, unnest(range(len(ws))) AS p, unnest(ws) AS word FROM d),
kept AS (SELECT p.doc_id, count(*) AS n, string_agg(p.word, ' ' ORDER BY p.p) AS t FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.p = gone.p
         WHERE gone.p IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
