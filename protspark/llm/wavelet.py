"""Token-ID output as wavelet matrices.

Documents are encoded in ascending id order and cut into shards of whole documents. A shard is one Parquet file
with one row: document ids and starts, and a wavelet matrix of its token ids. Plane k holds bit (width - 1 - k) of
every id in the order that the planes before have left; zeros go first, ones follow, both in order. Each plane
carries the number of ones before each block of 512 bits, so rank takes one lookup and one popcount of at most a
block. Access, counting and occurrence lookup need the planes only, never the plain ids.

A shard closes when it has ``shard_tokens`` ids, so it holds at most that many and one document. Global positions
are not written: they follow from the number of ids in earlier partitions, which readers sum.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache
from operator import attrgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from protspark.functions.lineage import shared_folder
from protspark.llm.common import id_of, key_of, map_batches

END_ID = 0
SHARD_TOKENS = 1 << 22
BLOCK = 512
CACHE_PIECES = 500_000


class WaveletMatrix:
    """Bit-planes with rank and select over unsigned ids."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros, self.width = n, zeros, len(planes)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> "WaveletMatrix":
        zeros, planes, ranks = [], [], []
        for k in range(width - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << k)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            fill = np.pad(packed, (0, -len(packed) % (BLOCK // 8)))
            ones = np.bitwise_count(fill).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            before = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])
            planes.append(packed.tobytes())
            ranks.append(before.tobytes())
            ones_from = len(ids) - int(before[-1])
            zeros.append(ones_from)
            turned = np.empty_like(ids)
            np.compress(~bit, ids, out=turned[:ones_from])
            np.compress(bit, ids, out=turned[ones_from:])
            ids = turned
        return cls(len(ids), zeros, planes, ranks)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (i & 7) & 1

    def _rank1(self, k: int, i: int) -> int:
        """Ones of plane ``k`` before position ``i``."""
        block = i // BLOCK
        first, last = block * (BLOCK // 8), i >> 3
        ones = int(self.ranks[k][block]) + int(np.bitwise_count(self.planes[k][first:last]).sum())
        if i & 7:
            ones += (int(self.planes[k][last]) & ((1 << (i & 7)) - 1)).bit_count()
        return ones

    def _select(self, k: int, bit: int, j: int) -> int:
        """Position of the ``j``-th (from 0) one or zero of plane ``k``."""
        starts = self.ranks[k].astype(np.int64)
        if not bit:
            starts = np.minimum(np.arange(len(starts)) * BLOCK, self.n) - starts
        block = int(np.searchsorted(starts, j, side="right")) - 1
        bits = np.unpackbits(self.planes[k][block * (BLOCK // 8):(block + 1) * (BLOCK // 8)], bitorder="little")
        bits = bits[:self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[j - int(starts[block])])

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.width):
            bit, ones = self._bit(k, i), self._rank1(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, value: int, i: int, j: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` in [i, j) lie below the last plane."""
        if value >> self.width:
            return 0, 0
        for k in range(self.width):
            a, b = self._rank1(k, i), self._rank1(k, j)
            i, j = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.width - 1 - k) & 1 else (i - a, j - b)
        return i, j

    def count(self, value: int, i: int = 0, j: int | None = None) -> int:
        a, b = self._range(value, i, self.n if j is None else j)
        return b - a

    def select(self, value: int, j: int) -> int:
        """Position of the ``j``-th (from 0) occurrence."""
        i = self._range(value, 0, self.n)[0] + j
        for k in range(self.width - 1, -1, -1):
            bit = value >> (self.width - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the last to the first."""
        out = np.zeros(self.n, np.uint32 if self.width > 16 else np.uint16)
        for k in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(out)
            up[np.flatnonzero(~bit)] = out[:self.zeros[k]]  # by positions: several times faster than by masks
            up[np.flatnonzero(bit)] = out[self.zeros[k]:] | out.dtype.type(1 << (self.width - 1 - k))
            out = up
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = rf"!-~{LETTERS}"
ID = attrgetter("id")


class _Cache(dict):
    """At most twice ``CACHE_PIECES`` entries: a full dictionary becomes the old one, and what is asked for again comes back."""

    def __init__(self, made):
        super().__init__()
        self.made, self.old = made, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.pop(key, None)
        if out is None:
            out = self.made(key)
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Encoder:
    """Ids of whole texts, equal to the library's, with a bounded cache of pieces, for byte-level tokenizers.

    A text of ASCII and Latin-1 letters is cut into the pre-tokenizer's pieces here, and each piece is encoded by the
    library's model. Other texts are cut before each single space or line end between two plain characters, where the
    pre-tokenizer cuts always; parts that are not plain go to the library. So do whole texts that hold an added token.
    """
    # Fixed: the pieces of a byte-level pre-tokenizer, for plain characters.
    PIECES = re.compile(rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+").findall
    ODD = re.compile(rf"[^ \n{PLAIN}]").search
    CUTS = re.compile(rf"(?<=[{PLAIN}])(?=[ \n][{PLAIN}])").split

    def __init__(self, path: str):
        self.library = _tokenizer(path)
        self.added = [a.content for a in self.library.get_added_tokens_decoder().values()]
        self.width = max(1, (self.library.get_vocab_size() - 1).bit_length())
        self.kind, self.code = (np.uint16, "H") if self.width <= 16 else (np.uint32, "I")
        cut, model = self.library.pre_tokenizer.pre_tokenize_str, self.library.model.tokenize
        form = {k: cut(chr(k))[0][0] for k in range(256) if not self.ODD(chr(k))}
        self.pieces = _Cache(lambda piece: array(self.code, [*map(ID, model(piece.translate(form)))]).tobytes())
        self.parts = _Cache(lambda part: self._whole(part) if self.ODD(part) else self._plain(part))

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]

    def _whole(self, t: str) -> bytes:
        return array(self.code, self.library.encode(t, add_special_tokens=False).ids).tobytes()

    def _plain(self, t: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.PIECES(t)))

    def one(self, t: str) -> bytes:
        if any(a in t for a in self.added):
            return self._whole(t)
        return b"".join(map(self.parts.__getitem__, self.CUTS(t))) if self.ODD(t) else self._plain(t)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process, so its cache outlives a task."""
    return Encoder(path)


SHARD = ("partition int, shard int, first long, n long, doc_ids binary, doc_starts binary, "
         "zeros array<long>, planes array<binary>, ranks array<binary>")


class _Writer:
    def __init__(self, path: str, shard_tokens: int):
        self.encode, self.limit = encoder(path), shard_tokens
        self.part = self.ids = self.held = None
        self.first = self.shard = 0
        self._clear()

    def _clear(self):
        self.doc_ids, self.sizes, self.held, self.n = [], [], [], 0

    def __call__(self, parts, doc_ids, texts):
        self.part, end, rows = parts[0], self.encode.kind(END_ID).tobytes(), []
        for i, ids in zip(doc_ids, self.encode([t or "" for t in texts])):
            if self.n >= self.limit:
                rows.append(self._row())
            self.doc_ids.append(i)
            self.held.append(ids + end)
            self.sizes.append(len(self.held[-1]) // len(end))
            self.n += self.sizes[-1]
        return [list(c) for c in zip(*rows)] if rows else None

    def _row(self):
        ids = np.frombuffer(b"".join(self.held), self.encode.kind)
        m = WaveletMatrix.build(ids, self.encode.width)
        starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1].astype(np.int64)
        row = (self.part, self.shard, self.first, self.n, np.array(self.doc_ids, np.int64).tobytes(), starts.tobytes(),
               m.zeros, [p.tobytes() for p in m.planes], [r.tobytes() for r in m.ranks])
        self.first, self.shard = self.first + self.n, self.shard + 1
        self._clear()
        return row

    def finish(self):
        return [list(c) for c in zip(self._row())] if self.doc_ids else None


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text, append the end id, and write one compressed file per shard to ``folder``.

    Rows are sorted by (id, hash of the text); a null id comes first and null texts are empty. Whole documents
    travel once, in the range exchange; encoding, cutting and building happen behind it in the same task.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    order = ["_key", "_tie"]
    rows = (docs.select(key_of().alias("_key"), F.xxhash64("text").alias("_tie"), "text")
            .repartitionByRange(*order).sortWithinPartitions(*order)
            .select(F.spark_partition_id().alias("_part"), "_key", "text"))
    (map_batches(rows, SHARD, lambda: _Writer(path, shard_tokens), rows=256)
     .write.option("maxRecordsPerFile", 1).option("compression", "zstd").mode("errorifexists").parquet(folder))


def read_shards(docs_or_session, folder: str) -> DataFrame:
    """Shard rows with ``base``, the global position of the shard's first id."""
    spark = getattr(docs_or_session, "sparkSession", docs_or_session)
    shards = spark.read.schema(SHARD).parquet(folder)
    sums = {r[0]: r[1] for r in shards.groupBy("partition").agg(F.sum("n")).collect()}  # one number per range partition
    bases, total = [], 0
    for p in sorted(sums):
        bases.append((p, total))
        total += sums[p]
    starts = spark.createDataFrame(bases, "partition int, _base long")
    return shards.join(F.broadcast(starts), "partition").withColumn("base", F.col("first") + F.col("_base")).drop("_base")


def _matrix(n, zeros, planes, ranks) -> WaveletMatrix:
    return WaveletMatrix(n, zeros, planes, ranks)


def documents_of(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the planes."""
    def start():
        def step(base, n, doc_ids, starts, zeros, planes, ranks):
            out = []
            for row in zip(base, n, doc_ids, starts, zeros, planes, ranks):
                ids = _matrix(row[1], *row[4:]).decode()
                keys, at = np.frombuffer(row[2], np.int64), np.frombuffer(row[3], np.int64)
                for i, a, b in zip(keys.tolist(), at.tolist(), [*at[1:].tolist(), row[1]]):
                    out.append((i, row[0] + a, b - a, zlib.crc32(ids[a:b].astype("<u4"))))
            return [list(c) for c in zip(*out)] if out else None
        return step

    rows = shards.select("base", "n", "doc_ids", "doc_starts", "zeros", "planes", "ranks")
    return map_batches(rows, "_key long, start long, n_tokens long, ids_crc32 long", start, rows=1).select(
        id_of("_key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, position) of every occurrence of one id; positions are global and found by select."""
    def start():
        def step(base, n, doc_ids, starts, zeros, planes, ranks):
            out = []
            for row in zip(base, n, doc_ids, starts, zeros, planes, ranks):
                m = _matrix(row[1], *row[4:])
                keys, at = np.frombuffer(row[2], np.int64), np.frombuffer(row[3], np.int64)
                for j in range(m.count(token)):
                    p = m.select(token, j)
                    out.append((int(keys[np.searchsorted(at, p, side="right") - 1]), row[0] + p))
            return [list(c) for c in zip(*out)] if out else None
        return step

    rows = shards.select("base", "n", "doc_ids", "doc_starts", "zeros", "planes", "ranks")
    return map_batches(rows, "_key long, position long", start, rows=1).select(id_of("_key").alias("doc_id"), "position")


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n) over all shards, counted on the planes."""
    def start():
        def step(n, zeros, planes, ranks):
            found = [(t, _matrix(*row).count(t)) for row in zip(n, zeros, planes, ranks) for t in tokens]
            return [list(c) for c in zip(*found)] if found else None
        return step

    return map_batches(shards.select("n", "zeros", "planes", "ranks"), "token int, n long", start, rows=1).groupBy("token").agg(F.sum("n").alias("n"))


def encode_documents(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the shards (to the session's shared folder if none is named) and read every document back from them.

    Null and empty texts are the end id alone. Equal rows stand side by side. An empty table gives an empty result.
    """
    folder = folder or shared_folder(docs.sparkSession, "wavelet")
    write_shards(docs, folder, **options)
    return documents_of(read_shards(docs, folder))
