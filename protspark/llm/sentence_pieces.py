"""SentencePiece encoding and decoding (BPE models with byte fallback) by vectorised merge rounds.

Texts become flat arrays of symbols. One round finds the lowest pair rank of every word, merges that pair at its leftmost
places in all words at once, and closes the gaps; words without a pair leave, and rounds go on until none is left.

Exactness. The library merges the pair of the best score first, the leftmost of equal ones. Words do not touch: the text is
cut wherever the two code points at the cut stand side by side in no piece of the model, so no merge could ever cross.
Within a word all places of the lowest rank are merged in one round only if no piece that begins or ends with the merged
piece has the same or a better score; then no merge made possible by the first place could come before the second. For
other pieces a round merges the leftmost place alone.

Null texts count as empty; an empty text is the begin and end id alone. Equal rows give equal results, an empty table gives
an empty one, and only the named columns are read. Texts of any length are encoded whole; an ids value must fit one Arrow
value (2 GB). Code points without a piece become byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NONE = np.iinfo(np.int32).max
KNOWN_IDS = 1 << 19  # ids of known words that a worker keeps, about 50 MB with their words
KNOWN_CHARS = 64  # longer words are not kept
CHARS_PER_SLICE = 1 << 19


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Model:
    """Tables of one model file."""

    def __init__(self, path: str) -> None:
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        pieces = {lib.id_to_piece(i): i for i in range(n) if i not in special and not lib.is_unused(i)}
        scores = {i: lib.get_score(i) for i in pieces.values()}
        place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.first = {p: i for p, i in pieces.items() if len(p) == 1}
        if not {c for p in pieces for c in p} <= set(self.first):
            raise ValueError("a piece holds a code point that is no piece")
        self.rank = np.full(n, NONE, np.int32)
        for i, s in scores.items():
            self.rank[i] = place[s]
        self._pairs(pieces, n)
        self._together(pieces, n)
        self._whole_runs(pieces)
        self._bytes_of(lib, n, special)

    def _pairs(self, pieces: dict[str, int], n: int) -> None:
        """Pairs of pieces and the piece they merge to, sorted by key."""
        found = {pieces[p[:k]] * n + pieces[p[k:]]: i for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces}
        self.size = n
        self.keys = np.array(sorted(found), np.int64)
        self.merged = np.array([found[k] for k in self.keys.tolist()], np.int32)

    def _together(self, pieces: dict[str, int], n: int) -> None:
        """May all places of one piece be merged in one round?"""
        self.together = np.ones(n, bool)
        for p, i in pieces.items():
            for k in range(1, len(p)):
                for part in (p[:k], p[k:]):
                    j = pieces.get(part)
                    if j is not None and self.rank[i] <= self.rank[j]:
                        self.together[j] = False

    def _whole_runs(self, pieces: dict[str, int]) -> None:
        """Which code points stand side by side in a piece; and the length at which runs of spaces are cut."""
        chars = sorted({c for p in pieces for c in p})
        self.number = np.zeros(0x110000, np.uint16)  # 0: in no piece
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in pieces:
            at = self.number[[ord(c) for c in p]]
            self.beside[at[:-1], at[1:]] = True
        # Runs of spaces, if equal in score and worse than all else, are merged last and from the left. If this makes one piece of
        # a longest run, every longer run begins with that piece, so runs are cut there. Otherwise they stay whole: slower, not other.
        runs = {len(p): self.rank[i] for p, i in pieces.items() if len(p) > 1 and set(p) == {SPACE}}
        others = max((self.rank[i] for p, i in pieces.items() if len(p) > 1 and set(p) != {SPACE}), default=-1)
        self.longest_run = 0
        if runs and len(set(runs.values())) == 1 and min(runs.values()) > others:
            parts = [1] * max(runs)
            while (k := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in runs), None)) is not None:
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            self.longest_run = max(runs) if len(parts) == 1 else 0

    def _bytes_of(self, lib, n: int, special: set[int]) -> None:
        """The bytes each id stands for."""
        def said(i: int) -> bytes:
            if lib.is_control(i):
                return b""
            if lib.is_unknown(i):
                return " ⁇ ".encode()
            return bytes([int(lib.id_to_piece(i)[3:5], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace(SPACE, " ").encode()

        texts = [said(i) for i in range(n)]
        self.said = np.frombuffer(b"".join(texts), np.uint8)
        self.said_length = np.array([len(t) for t in texts], np.int64)
        self.said_start = np.cumsum(self.said_length) - self.said_length
        self.is_control = np.array([lib.is_control(i) for i in range(n)])
        self.is_byte = np.array([lib.is_byte(i) for i in range(n)])
        self.opens = np.array([i not in special and lib.id_to_piece(i).startswith(SPACE) for i in range(n)])

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair merges to, -1 if none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def word_starts(self, points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Offsets at which words begin: each text's start, and every place that no piece spans."""
        number = self.number[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.beside[number[:-1], number[1:]]
        cut[text_starts] = True
        if self.longest_run:
            space = np.flatnonzero(points == ord(SPACE))
            if len(space):
                new = np.ones(len(space), bool)
                new[1:] = (np.diff(space) > 1) | cut[space[1:]]
                head = np.maximum.accumulate(np.where(new, np.arange(len(space)), 0))
                deep = space[(np.arange(len(space)) - head) % self.longest_run == 0]
                cut[deep] = True
        return np.flatnonzero(cut)

    def merge_rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words given as flat symbols and their lengths; the final symbols in the words' order, and the new lengths."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        inner = word[:-1] == word[1:]
        to = np.full(len(word), -1, np.int32)  # what each symbol and the next merge to
        at = np.flatnonzero(inner)
        to[at] = self.pair(symbols[at], symbols[at + 1])
        while len(word):
            rank = np.where(to >= 0, self.rank[to], NONE)
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[heads, len(word)])
            least = np.minimum.reduceat(rank, heads)
            live = least < NONE
            if not live.all():
                keep = np.repeat(live, sizes)
                done.append((word[~keep], symbols[~keep]))
                word, symbols, to, rank = word[keep], symbols[keep], to[keep], rank[keep]
                if not len(word):
                    break
                sizes, least = sizes[live], least[live]
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            of = word[hit]
            leading = np.r_[True, of[1:] != of[:-1]]
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) > 1] | leading, np.arange(len(hit)), 0))
            take = hit[leading | (self.together[to[hit]] & ((np.arange(len(hit)) - run) % 2 == 0) & self._alike(to[hit], leading))]
            symbols[take] = to[take]
            gone = np.zeros(len(word), bool)
            gone[take + 1] = True
            shift = np.cumsum(gone)
            word, symbols, to = word[~gone], symbols[~gone], to[~gone]
            now = take - shift[take]
            near = np.unique(np.r_[now[now > 0] - 1, now])
            fits = near[:-1] if len(near) and near[-1] == len(word) - 1 else near
            to[near] = -1
            fits = fits[word[fits] == word[fits + 1]]
            to[fits] = self.pair(symbols[fits], symbols[fits + 1])
        words, ids = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(words, kind="stable")
        return ids[order], np.bincount(words, minlength=len(lengths))

    @staticmethod
    def _alike(to: np.ndarray, leading: np.ndarray) -> np.ndarray:
        """Is a place's piece that of its word's first place? Pieces of equal score are merged one by one."""
        return to == to[np.maximum.accumulate(np.where(leading, np.arange(len(to)), 0))]


class Encoder:
    """Encodes lists of texts; keeps the ids of words it has met, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, flat, and their lengths."""
        m = self.model
        odd = {k: [m.byte_ids[b] for b in w.encode()] for k, w in enumerate(words) if len(w) == 1 and w not in m.first}
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        numbers = m.number[points]
        if not hasattr(self, "_piece"):
            self._piece = np.zeros(int(m.number.max()) + 1, np.int32)
            for c, i in m.first.items():
                self._piece[m.number[ord(c)]] = i
        ids, lengths = m.merge_rounds(self._piece[numbers], sizes)
        if odd:
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for k, new in odd.items():
                parts[k] = np.array(new, np.int32)
                lengths[k] = len(new)
            ids = np.concatenate(parts)
        return ids.astype(np.int32), lengths

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with begin and end ids, and the number of ids of every text."""
        if len(self.ids) > KNOWN_IDS:
            self._forget()
        m = self.model
        whole = "".join([SPACE + t for t in texts if t]).replace(" ", SPACE)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        text_starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        cut = m.word_starts(points, text_starts) if len(points) else np.zeros(0, np.int64)
        ends = np.r_[cut[1:], len(points)]
        words = [whole[a:b] for a, b in zip(cut.tolist(), ends.tolist())]
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        new = list(dict.fromkeys([words[k] for k in unknown.tolist()]))
        if new:
            ids, lengths = self._learn(new)
            base = len(self.starts)
            self.known.update(zip(new, range(base, base + len(new))))
            self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(lengths) - lengths]
            self.ids, self.lengths = np.r_[self.ids, ids], np.r_[self.lengths, lengths]
            at[unknown] = [self.known[words[k]] for k in unknown.tolist()]
        flat = self.ids[spread(self.starts[at], self.lengths[at])]
        for w in new:
            if len(w) > KNOWN_CHARS:
                del self.known[w]
        per_word = np.cumsum(np.r_[0, self.lengths[at]])
        counts = np.zeros(len(texts), np.int64)
        first = np.searchsorted(cut, text_starts)
        counts[sizes > 0] = np.diff(np.r_[per_word[first], per_word[-1]])
        out = np.empty(len(flat) + 2 * len(texts), np.int32)
        stop = np.cumsum(counts + 2)
        out[stop - counts - 2], out[stop - 1] = m.bos, m.eos
        out[spread(stop - counts - 1, counts)] = flat
        return out, counts + 2


def decode(model: Model, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of flat ids: piece bytes gathered at once, the space put before the first piece taken away again."""
    ends = np.cumsum(counts)
    begins = ends - counts
    length = model.said_length[ids]
    skip = np.zeros(len(ids), np.int64)
    real = np.flatnonzero(~model.is_control[ids])
    at = np.searchsorted(real, begins)
    has = at < len(real)
    lead = real[at[has]]
    lead = lead[(lead < ends[has]) & model.opens[ids[lead]]]
    skip[lead] = 1
    raw = model.said[spread(model.said_start[ids] + skip, length - skip)].tobytes()
    size = np.r_[0, np.cumsum(length - skip)]
    between = model.is_control[ids]  # a control piece ends a run of bytes
    between[begins[counts > 0]] = between[ends[counts > 0] - 1] = False
    inner = np.diff(np.cumsum(np.r_[0, between])[np.r_[0, ends]])
    out = []
    for k, (a, b) in enumerate(zip(size[begins].tolist(), size[ends].tolist())):
        try:
            if inner[k]:
                raise ValueError
            out.append(raw[a:b].decode())
        except ValueError:
            out.append(_with_bad_bytes(model, ids[begins[k]:ends[k]], raw[a:b], np.diff(size[begins[k]:ends[k] + 1])))
    return out


_CODE_POINT = re.compile(rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
                         rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}|(?s:.)")


def _with_bad_bytes(model: Model, ids: np.ndarray, raw: bytes, sizes: np.ndarray) -> str:
    """Runs of byte pieces are read code point by code point; a byte that begins none becomes U+FFFD."""
    out, at, k = [], 0, 0
    byte = model.is_byte[ids]
    while k < len(ids):
        stop = k + 1
        while byte[k] and stop < len(ids) and byte[stop]:
            stop += 1
        part = raw[at:at + int(sizes[k:stop].sum())]
        out += [c.decode(errors="replace") for c in _CODE_POINT.findall(part)] if byte[k] else [part.decode()]
        at, k = at + len(part), stop
    return "".join(out)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One per worker process, kept between tasks."""
    return Encoder(Model(path))


def _slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    k, total = 0, 0
    for j, n in enumerate(sizes):
        if j > k and total + n > limit:
            yield k, j
            k, total = j, 0
        total += n
    if k < len(sizes):
        yield k, len(sizes)


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids``: begin id, pieces and end id of every text as little-endian unsigned 32-bit integers."""
    path = model or public_tokenizers.path(MODEL)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for k, stop in _slices([len(t) for t in texts], CHARS_PER_SLICE):
                ids, counts = encoder(texts[k:stop])
                raw = ids.astype("<u4").tobytes()
                ends = (4 * np.cumsum(counts)).tolist()
                parts = pa.array([raw[x:y] for x, y in zip([0, *ends], ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, stop - k), parts], schema=schema)

    return rows.mapInArrow(run, "doc_id long, ids binary")


def decoded(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """The rows of ``encode`` with ``text``, read back from the ids alone. A null ids value gives an empty text."""
    path = model or public_tokenizers.path(MODEL)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _encoder(path).model
        for b in batches:
            raw = [x or b"" for x in b.column(1).to_pylist()]
            for k, stop in _slices([len(x) for x in raw], CHARS_PER_SLICE):
                ids = np.frombuffer(b"".join(raw[k:stop]), "<u4").astype(np.int64)
                texts = decode(m, ids, np.array([len(x) // 4 for x in raw[k:stop]], np.int64))
                yield pa.RecordBatch.from_arrays([*(c.slice(k, stop - k) for c in b.columns), pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The table's rows by the stated contract: the number of ids and the digests of ids and decoded text."""
    rows = decoded(encode(docs, model), model)
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text"), 256).alias("decoded_sha256"))
