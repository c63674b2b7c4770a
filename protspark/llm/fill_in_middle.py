"""Fill-in-middle transformation: texts cut in three at unit ends, the middle moved to the end behind markers.

A batch's texts lie end to end in one UTF-8 buffer, as Arrow holds them, and are never split in Python. The buffer is
viewed as 64-bit words. Arithmetic on whole words sets the top bit of every byte that ends a unit (or continues a code
point), a bit count per word and its running sum give ranks, and a unit's end is found by searching the running sum
for its word and then selecting the set bit inside that word.

A unit is a maximal run up to and with ``unit_end`` (one ASCII character, the line end by default); a rest without it
is a unit too. Null texts count as empty, a null id as an empty decimal, so all rows without an id are cut by the same
two numbers. Equal rows give equal results, an empty table gives an empty one, and only the named columns are read.
A text must fit one Arrow value (2 GB); it is never shortened.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

MARKERS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix, the middle
BYTES_PER_SLICE = 1 << 24

ONES, TOPS, LOWS = (np.uint64(int(b * 8, 16)) for b in ("01", "80", "7f"))
ONE = np.uint64(1)


def equal_bytes(words: np.ndarray, byte: int) -> np.ndarray:
    """The top bit of every byte equal to ``byte``; no carry leaves a byte, so the marks are exact."""
    x = words ^ (ONES * np.uint64(byte))
    return ~(((x & LOWS) + LOWS) | x | LOWS)


def continuation_bytes(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte 10xxxxxx, which continues a UTF-8 code point."""
    return words & ~(words << ONE) & TOPS


class Marks:
    """Rank and select over marked bytes of a buffer."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, offsets: np.ndarray) -> np.ndarray:
        """Marked bytes before each offset, which must lie inside the padded buffer."""
        word, bits = offsets >> 3, (offsets & 7).astype(np.uint64) << np.uint64(3)
        return self.before[word] + np.bitwise_count(self.marks[word] & ((ONE << bits) - ONE))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The offset of the k-th marked byte, counted from 0."""
        word = np.searchsorted(self.before, k, side="right") - 1
        left, m = k - self.before[word], self.marks[word]
        for _ in range(7):  # drop the lowest marks in front
            m = np.where(left > 0, m & (m - ONE), m)
            left = left - 1
        return (word << 3) + (np.bitwise_count((m & (~m + ONE)) - ONE).astype(np.int64) >> 3)


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit_end: int) -> tuple[np.ndarray, ...]:
    """Units, the two cut offsets and the code points of prefix and middle of every text ``data[start:end]``."""
    padded = np.zeros((len(data) >> 3) + 1 << 3, np.uint8)
    padded[:len(data)] = data
    words = padded.view("<u8")
    ending, inner = Marks(equal_bytes(words, unit_end)), Marks(continuation_bytes(words))
    first = ending.rank(starts)
    n = ending.rank(ends) - first
    n += (ends > starts) & (padded[np.maximum(ends - 1, 0)] != unit_end)
    a, b = h1 % (n + 1), h2 % (n + 1)

    def offset(units: np.ndarray) -> np.ndarray:
        out = np.where(units == 0, starts, ends)
        within = np.flatnonzero((units > 0) & (units < n))
        out[within] = ending.select(first[within] + units[within] - 1) + 1
        return out

    p, m = offset(np.minimum(a, b)), offset(np.maximum(a, b))

    def chars(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return y - x - (inner.rank(y) - inner.rank(x))

    return n, p, m, chars(starts, p), chars(p, m)


def _slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each."""
    sizes = np.cumsum(np.frombuffer(pc.binary_length(texts).cast(pa.int64()).buffers()[1], np.int64)[:len(texts)])
    k = 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + limit, side="right")))
        yield k, stop
        k = stop


def fill_in_middle(docs: DataFrame, seed: str = "7", rate_percent: int = 100, spm_percent: int = 50, unit_end: str = "\n",
                   markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (``psm``, ``spm`` or ``plain``), prefix_chars, middle_chars and ``fim``, the transformed text.

    ``psm`` is prefix, suffix, middle, and ``spm`` is suffix, prefix, middle, each behind its marker. Texts that are
    empty, hold a marker or are not drawn (``rate_percent``) stay plain and have no cuts. The draws and both cuts come
    from the SHA-256 of ``seed:id``, so they do not depend on the partitioning.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *draws)
    if len(unit_end) != 1 or ord(unit_end) > 127:
        raise ValueError("unit_end must be one ASCII character")
    heads = tuple(m.encode() for m in markers)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("fim", pa.string())])

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        text = b.column(1).cast(pa.large_string())
        text = text if text.offset == 0 else pa.concat_arrays([text])
        _, offs, buf = text.buffers()
        offsets = np.frombuffer(offs, np.int64)[:len(text) + 1]
        low = int(offsets[0])
        data = np.frombuffer(buf, np.uint8)[low:int(offsets[-1])] if buf is not None and buf.size else np.zeros(0, np.uint8)
        starts, ends = offsets[:-1] - low, offsets[1:] - low
        h1, h2, h3, h4 = (c.to_numpy() for c in b.columns[2:])
        n, p, m, prefix_chars, middle_chars = cuts(data, starts, ends, h1, h2, ord(unit_end))
        plain = (starts == ends) | (h3 % 100 >= rate_percent)
        for mark in markers:
            plain |= pc.match_substring(text, mark).to_numpy(zero_copy_only=False)
        form = np.where(plain, 0, np.where(h4 % 100 < spm_percent, 1, 2))
        raw, out = data.tobytes(), []
        for f, s, x, y, e in zip(form.tolist(), starts.tolist(), p.tolist(), m.tolist(), ends.tolist()):
            if f == 0:
                out.append(raw[s:e])
            elif f == 1:
                out.append(b"".join((heads[1], raw[y:e], heads[0], raw[s:x], heads[2], raw[x:y])))
            else:
                out.append(b"".join((heads[0], raw[s:x], heads[1], raw[y:e], heads[2], raw[x:y])))
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n), pa.array(np.array(["plain", "spm", "psm"], object)[form], pa.string()),
             pa.array(prefix_chars, mask=plain), pa.array(middle_chars, mask=plain), pa.array(out, pa.binary()).cast(pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, stop in _slices(b.column(1), BYTES_PER_SLICE):
                yield one(b.slice(k, stop - k))

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, fim string")


def restored(fim: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text before the transformation. Only texts without markers are transformed, so the markers found are the ones set."""
    parts = F.split(fim, "|".join(re.escape(m) for m in markers))
    first, second, last = (F.element_at(parts, i) for i in (2, 3, 4))
    return (F.when(form == "plain", fim).when(form == "psm", F.concat(first, last, second)).otherwise(F.concat(second, last, first)))


def digests(docs: DataFrame) -> DataFrame:
    """The table's rows by the stated contract: sizes, form and the digests of the output and of the text restored from it."""
    rows = fill_in_middle(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("fim"), 256).alias("output_sha256"),
                       F.sha2(restored(F.col("fim"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
           sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
drawn AS (
    SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
           CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM cut),
parts AS (
    SELECT doc_id, text, n,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
           array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
           array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') AS suffix
    FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
""".strip()
