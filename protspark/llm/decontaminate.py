"""Benchmark decontamination with SimHash over item-sized windows, in DataFrame operations only.

A window is as many consecutive words of a document as a benchmark item has. Windows and items are bags of word
shingles (five words, all words of a shorter item), weighted by their number of occurrences. Both get a 64-bit
SimHash. Item fingerprints are listed under every value of each of their eight bytes within two bits, so by the
pigeonhole principle every window within 18 bits meets its item in a list (multi-index Hamming search). Pairs in
reach are verified by their exact weighted-shingle similarity, sum of least over sum of greatest weights.

A window of m shingles can only be similar enough if at least 2 * m * t / (1 + t) of them occur in items of its
size. Fingerprints are made for the windows that meet this bound; all others cannot pass the verification. Shingles
are compared by 64-bit hashes.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from protspark.functions.lineage import cut
from protspark.llm.common import id_of, key_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 18
BLOCKS = 8
LANE = 21  # bits of one counter; three counters share a long
BROADCAST_ROWS = 1_000_000  # about 16 MB of keys; beyond it the side is shuffled

_SPACE = " \t\n\x0b\x0c\r"


def _words(text: str) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(_SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if the table has few rows, else leave the join to shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shingle(words: str, pos: Column, width: Column) -> Column:
    return F.xxhash64(F.slice(F.col(words), pos + 1, width))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item, size, width, m, h, c) of every item with a word; ``m`` shingles in all, ``c`` of them equal."""
    sized = (items.select(key_of("item_id").alias("item"), _words("text").alias("_ws")).where("_ws IS NOT NULL").distinct()
             .withColumn("size", F.size("_ws")).withColumn("width", F.least(F.lit(SHINGLE), F.col("size"))))
    rows = sized.select("item", F.xxhash64("_ws").alias("text_hash"), "size", "width", (F.col("size") - F.col("width") + 1).alias("m"),
                        "_ws", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("width"))).alias("pos"))
    return rows.groupBy("item", "text_hash", "size", "width", "m", _shingle("_ws", F.col("pos"), F.col("width")).alias("h")).agg(F.count("*").alias("c"))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(key_of().alias("key"), F.xxhash64("text").alias("th"), _words("text").alias("ws"))


def _anchors(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(key, th, n, pos, size, m, width): positions whose shingle occurs in an item of that size."""
    listed = cut(shingles.select("width", "h", "size", "m").distinct())
    widths = [r[0] for r in listed.select("width").distinct().collect()]  # at most five numbers
    placed = _identified(docs).where("ws IS NOT NULL").withColumn("n", F.size("ws"))
    placed = placed.select("*", F.explode(F.array(*[F.lit(w) for w in sorted(widths)])).alias("width")).where("n >= width")
    placed = placed.select("key", "th", "n", "ws", "width", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))).alias("pos"))
    hashed = placed.select("key", "th", "n", "pos", "width", _shingle("ws", F.col("pos"), F.col("width")).alias("h"))
    return hashed.join(_small(listed), ["width", "h"]).select("key", "th", "n", "pos", "size", "m", "width").distinct()


def _need(similarity: float) -> Column:
    return F.ceil(F.round(F.col("m") * (2 * similarity / (1 + similarity)), 6))


def _windows(anchors: DataFrame, similarity: float) -> DataFrame:
    """(key, th, size, m, width, start) of the windows that meet the bound on item shingles."""
    doc = ["key", "th", "size", "m", "width"]
    blocked = anchors.withColumn("block", F.floor(F.col("pos") / F.col("m")))
    w = Window.partitionBy(*doc).orderBy("block")
    beside = lambda f, step: F.when(f("block").over(w) == F.col("block") + step, f("c").over(w)).otherwise(0)
    dense = (blocked.groupBy(*doc, "block").agg(F.count("*").alias("c"))
             .withColumn("most", F.col("c") + F.greatest(beside(F.lag, -1), beside(F.lead, 1)))
             .where(F.col("most") >= _need(similarity)).select(*doc, "block"))
    near = blocked.join(dense, [*doc, "block"], "left_semi").where("n >= size")
    starts = F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("m") + 1), F.least(F.col("pos"), F.col("n") - F.col("size")))
    possible = near.where(F.col("pos") - F.col("m") + 1 <= F.col("n") - F.col("size"))
    counted = possible.select(*doc, F.explode(starts).alias("start")).groupBy(*doc, "start").agg(F.count("*").alias("met"))
    return counted.where(F.col("met") >= _need(similarity)).select(*doc, "start")


def _window_shingles(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, th, size, m, start, h, c) of every window."""
    per_doc = cut(windows.groupBy("key", "th").agg(F.collect_list(F.struct("size", "m", "width", "start")).alias("ws_at")))
    texts = _identified(docs).join(_small(per_doc), ["key", "th"]).dropDuplicates(["key", "th"])
    one = texts.select("key", "th", "ws", F.explode("ws_at").alias("w"))
    rows = one.select("key", "th", "ws", "w", F.explode(F.sequence(F.col("w.start"), F.col("w.start") + F.col("w.m") - 1)).alias("pos"))
    h = _shingle("ws", F.col("pos"), F.col("w.width"))
    return (rows.select("key", "th", "w.size", "w.m", "w.start", h.alias("h"))
            .groupBy("key", "th", "size", "m", "start", "h").agg(F.count("*").alias("c")))


def simhash(shingles: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``m`` and ``fp``: bit b is set if shingles of more than half the weight have it set."""
    bit = lambda b: F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1).cast("long"))
    longs = []
    for j in range(0, 64, 3):
        packed = bit(j)
        for lane in range(1, min(3, 64 - j)):
            packed = packed.bitwiseOR(F.shiftleft(bit(j + lane), LANE * lane))
        longs.append(F.sum(packed * F.col("c")).alias(f"v{j // 3}"))
    votes = shingles.groupBy(*by, "m").agg(*longs)
    fp = F.lit(0).cast("long")
    for b in range(64):
        n = F.shiftrightunsigned(f"v{b // 3}", LANE * (b % 3)).bitwiseAND(F.lit((1 << LANE) - 1).cast("long"))
        fp = fp.bitwiseOR(F.when(n * 2 > F.col("m"), F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long")).otherwise(F.lit(0).cast("long")))
    return votes.select(*by, "m", fp.alias("fp"))


def _near(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """Every (window, item) pair of one size whose fingerprints differ in at most ``radius`` bits."""
    width = 64 // BLOCKS
    masks = [sum(1 << b for b in bits) for n in range(radius // BLOCKS + 1) for bits in combinations(range(width), n)]
    block = lambda j: F.shiftrightunsigned("fp", width * j).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    blocks = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), block(j).alias("v")) for j in range(BLOCKS)])).alias("b")
    listed = items.select("item", "text_hash", "size", F.col("fp").alias("item_fp"), blocks).select(
        "*", F.explode(F.array(*[F.lit(x).cast("long") for x in masks])).alias("flip"))
    listed = listed.select("item", "text_hash", "size", "item_fp", F.col("b.j").alias("j"), F.col("b.v").bitwiseXOR(F.col("flip")).alias("v"))
    looked = windows.select("key", "th", "size", "start", "fp", blocks).select("key", "th", "size", "start", "fp", "b.j", "b.v")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    return looked.join(_small(listed), ["size", "j", "v"]).where(close).select("key", "th", "size", "start", "item", "text_hash").distinct()


def _leaking(docs: DataFrame, items: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Windows at the similarity or above, by (id, text hash) of their rows."""
    shingles = cut(item_shingles(items))
    if shingles.isEmpty():
        return docs.sparkSession.createDataFrame([], "key long, th long, item long, similarity double, start int, size int")
    windows = cut(_windows(cut(_anchors(docs, shingles)), similarity))
    rows = cut(_window_shingles(docs, windows))
    prints = simhash(rows, ["key", "th", "size", "start"])
    pairs = _near(prints, simhash(shingles, ["item", "text_hash", "size"]), radius)
    both = (pairs.join(rows, ["key", "th", "size", "start"])
            .join(shingles.select("item", "text_hash", "h", F.col("c").alias("ic")), ["item", "text_hash", "h"]))
    shared = both.groupBy("key", "th", "item", "text_hash", "size", "m", "start").agg(F.sum(F.least("c", "ic")).alias("shared"))
    return shared.withColumn("similarity", F.col("shared") / (2 * F.col("m") - F.col("shared"))).where(F.col("similarity") >= similarity)


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start, n_words: the best window of each document for each item it contains.

    Words are lower-cased. Documents and items that are null, empty or without words contain and leak nothing. A
    document shorter than an item has no window of its size. Of equally similar windows the first counts. Repeated
    rows are one document. Empty tables give an empty result.
    """
    scored = _leaking(docs, items, similarity, radius)
    best = scored.groupBy("key", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "size")).alias("b"))
    return best.select(id_of("key").alias("doc_id"), id_of("item").alias("item_id"), "b.similarity", (-F.col("b.s")).alias("start"), F.col("b.size").alias("n_words"))


def without_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that contain no item.

    Rows are told apart by id and text, so rows without an id, or with an id that stands twice, are judged by their own text.
    """
    hit = _leaking(docs, items, similarity, radius).select(F.col("key").alias("_key"), F.col("th").alias("_tie")).distinct()
    keyed = docs.select(key_of().alias("_key"), F.xxhash64("text").alias("_tie"), F.struct(*docs.columns).alias("_row"))
    return keyed.join(hit, ["_key", "_tie"], "left_anti").select(*[F.col("_row")[c].alias(c) for c in docs.columns])


SQL = """
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
i AS (SELECT item_id, ws, len(ws) AS n, least(5, len(ws)) AS k FROM
      (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS ws FROM benchmark) WHERE len(ws) > 0),
ip AS (SELECT item_id, n, k, ws, unnest(range(n - k + 1)) AS p FROM i),
sh AS (SELECT item_id, n, k, array_to_string(ws[p + 1:p + k], ' ') AS s, count(*) AS c FROM ip GROUP BY ALL),
dp AS (SELECT doc_id, ws, len(ws) AS len, k, unnest(range(len(ws) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(ws) >= k),
ds AS (SELECT doc_id, len, k, p, array_to_string(ws[p + 1:p + k], ' ') AS s FROM dp),
a AS (SELECT DISTINCT ds.doc_id, ds.len, sh.item_id, sh.n, sh.k, ds.p FROM ds JOIN sh ON ds.k = sh.k AND ds.s = sh.s),
st AS (SELECT DISTINCT doc_id, item_id, n, k, unnest(range(greatest(0, p - (n - k)), least(p, len - n) + 1)) AS start FROM a),
wc AS (SELECT st.doc_id, st.item_id, st.n, st.k, st.start, ds.s, count(*) AS c FROM st
       JOIN ds ON ds.doc_id = st.doc_id AND ds.k = st.k AND ds.p BETWEEN st.start AND st.start + st.n - st.k GROUP BY ALL),
sc AS (SELECT wc.doc_id, wc.item_id, wc.n, wc.start, sum(least(wc.c, sh.c))::BIGINT AS shared, any_value(wc.n - wc.k + 1) AS m
       FROM wc JOIN sh ON sh.item_id = wc.item_id AND sh.n = wc.n AND sh.s = wc.s GROUP BY ALL),
ok AS (SELECT *, shared::DOUBLE / (2 * m - shared) AS similarity FROM sc WHERE shared::DOUBLE / (2 * m - shared) >= 0.8),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM ok)
SELECT doc_id, item_id, similarity, start::INT AS start, n::INT AS n_words FROM rk WHERE r = 1
"""
