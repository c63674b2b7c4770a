"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over every document. Suspicious tokens (look-alike digits and signs anywhere in words,
masked letters, letters and signs set apart, repeated letters) become character lattices: each sign may stand for several
letters, a mask for any, a repeated letter or a separator for nothing, each at a channel cost. Viterbi decoding under the language model restores the
likeliest word. The restored text is scored with a lexicon of word beginnings, learned from all labelled rows by
the lower confidence bound of their rate in toxic texts over that in others. A beginning enters only with several
different words before it, so a toxic text that was copied many times does not make its ordinary words toxic. A
logistic model of three sums over the lexicon, fitted to at most ``MAX_FIT_ROWS`` labelled rows in hash order, gives
the score.

Tokens of any length are decoded whole: beyond ``LONG`` characters over tables of the reachable states, of which every
``STRIDE``-th is kept and the ones between are made again on the way back, so a token of a megabyte takes some megabytes. A
long token with one masked letter gets its likeliest reading only, a short one the ``MASK_FORMS`` likeliest.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable
from functools import lru_cache
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, functions as F

from protspark.functions.lineage import cut
from protspark.llm.common import WORD, id_of, id_remainder, key_of, map_batches

THRESHOLD = 0.3
MODULUS, HELD_OUT = 4, 2
BEGINNINGS = (4, 5, 6, 7)
MIN_CONTEXTS = 5
MIN_RATIO, MAX_LOG_RATIO = 4.0, 6.0
CONFIDENCE = 1.645
MAX_FIT_ROWS = 20_000
CACHE_WORDS, CACHE_FORMS = 300_000, 50_000
LONG, STRIDE = 256, 512

# Letters that signs look like.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
SEPARATORS = " .-_*"
SIGN_COST, REPEAT_COST, SEPARATOR_COST, KEEP_COST = 0.7, 0.2, 0.1, 6.0
MASK = "*"
MASK_FORMS = 6

#: Letters of the model; any other character is the border of a word.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöùúûüýÿœ"
CODES = {c: k + 1 for k, c in enumerate(ALPHABET)}
SIZE = 64
_TABLE = np.zeros(0x180, np.uint8)
for _c, _k in CODES.items():
    _TABLE[ord(_c)] = _k
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x180:
        _TABLE[ord(_c.upper())] = _k

_L = r"[^\W\d_]"
SPACED = re.compile(rf"(?<![^\W_])(?:{_L}([ .\-_*])(?={_L}(?:\1|(?![^\W_])))){{2,}}{_L}(?![^\W_])")
_S = r"(?:[^\W\d_]|[013-9@$!|+€])"
#: Letters and signs set apart by any white space, each perhaps with a mark behind it.
RUN = re.compile(rf"(?<![^\W_]){_S}(?:[.\-_*]*\s+{_S}){{2,}}(?![^\W_])")
#: Stands in every run, before its last letter; begins with a class of characters, so the search passes over words quickly.
INNER = re.compile(rf"\s{_S}[.\-_*]*\s+{_S}(?![^\W_])")
PIECE = re.compile(r"[\w@$!|+€.\-*]+")
LETTER = re.compile(_L)
MIXED = re.compile(rf"[013-9@$!|+€.\-_*]|({_L})\1\1")
TRIPLE = re.compile(rf"({_L})\1\1")
OUTSIDE = ".,;:?\"'()[]{}#%&<>"
EDGES = ".,;:?\"'()[]{}#*%&<>"


def trigrams(text: str) -> np.ndarray:
    """Trigrams of letter codes; zeros stand before the first and behind the last letter of a word."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], 0).astype(np.int64)
    c = np.concatenate([[0, 0], small, [0]])
    return c[:-2] * SIZE * SIZE + c[1:-1] * SIZE + c[2:]


class LanguageModel:
    """log P(c | a, b), interpolated with the bigram and the letter's own share."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        one = (n.sum(axis=(0, 1)) + 0.5) / (n.sum() + 0.5 * SIZE)
        two = n.sum(axis=0)
        two = (two + 20 * one) / (two.sum(axis=1, keepdims=True) + 20)
        self.cost = -np.log((n + 5 * two) / (n.sum(axis=2, keepdims=True) + 5))

    def restore(self, token: str) -> str:
        """The likeliest word behind a token."""
        return self._masked(token) if len(token) > LONG else self._costed(token)[1]

    def unmasked(self, token: str) -> list[str]:
        """The likeliest words behind one masked letter; behind several, the likeliest one."""
        if token.count(MASK) > 1 or len(token) > LONG:
            return [self._masked(token)]
        return [w for _, w in sorted(self._costed(token.replace(MASK, c)) for c in CODES)[:MASK_FORMS]]

    @staticmethod
    def _choices(c: str, before: str) -> list[tuple[str, float]]:
        low = c.lower()
        if low in CODES:
            return [(low, 0.0), ("", REPEAT_COST)] if low == before else [(low, 0.0)]
        if low.isalpha():
            return [(low, 0.0)]
        choices = [(x, SIGN_COST) for x in LOOKALIKES.get(c, "")]
        if c in SEPARATORS or c.isspace() or c in LOOKALIKES and c == before:
            choices.append(("", SEPARATOR_COST))
        return choices or [(c, KEEP_COST)]

    def _costed(self, token: str) -> tuple[float, str]:
        """Cost and word of the cheapest path, by Viterbi over (last two letters)."""
        states = {(0, 0): (0.0, "")}
        before = ""
        for c in token:
            choices = self._choices(c, before)
            before = c.lower()
            after: dict = {}
            for (a, b), (cost, word) in states.items():
                for x, channel in choices:
                    if x:
                        code = CODES.get(x, 0)
                        state, total = (b, code), cost + channel + self.cost[a, b, code]
                    else:
                        state, total = (a, b), cost + channel
                    if state not in after or total < after[state][0]:
                        after[state] = (total, word + x)
            states = after
        return min((cost + self.cost[a, b, 0], word) for (a, b), (cost, word) in states.items())

    def _step(self, c: str, before: str, at: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One character: the last letters in reach, the costs by (letter before, last letter) and where each came from.

        ``at`` are the last letters in reach and ``now`` has a column for each. -1 stands for a character that is no letter.
        """
        choices = [(x, 0.0) for x in ALPHABET] if c == MASK else self._choices(c, before)
        letters = [(CODES.get(x, 0), channel) for x, channel in choices if x]
        codes = np.array([k for k, _ in letters], np.int64)
        ways = now[:, :, None] + self.cost[:, at][:, :, codes]
        new, of = np.full((SIZE, len(codes)), np.inf), np.zeros((SIZE, len(codes)), np.int8)
        new[at], of[at] = ways.min(axis=0) + np.array([channel for _, channel in letters]), ways.argmin(axis=0)
        silent = [channel for x, channel in choices if not x]
        if not silent:
            return codes, new, of
        both = np.union1d(codes, at)
        cost, back = np.full((SIZE, len(both)), np.inf), np.zeros((SIZE, len(both)), np.int8)
        into = np.searchsorted(both, codes)
        cost[:, into], back[:, into] = new, of
        stay = np.searchsorted(both, at)
        better = now + silent[0] < cost[:, stay]
        cost[:, stay] = np.where(better, now + silent[0], cost[:, stay])
        back[:, stay] = np.where(better, -1, back[:, stay])
        return both, cost, back

    def _masked(self, token: str) -> str:
        """The likeliest word over tables of states: each mask is one letter, whichever."""
        at, now = np.zeros(1, np.int64), np.full((SIZE, 1), np.inf)
        now[0, 0] = 0.0
        kept, before = [], ""
        for k, c in enumerate(token):
            if k % STRIDE == 0:
                kept.append((at, now, before))
            at, now, _ = self._step(c, before, at, now)
            before = c.lower()
        a, i = np.unravel_index((now + self.cost[:, at, 0]).argmin(), now.shape)
        a, b = int(a), int(at[i])
        word = []
        for k in reversed(range(len(kept))):
            part = token[k * STRIDE:(k + 1) * STRIDE]
            (at, now, before), back = kept.pop(), []
            for c in part:
                at, now, of = self._step(c, before, at, now)
                before = c.lower()
                back.append((at, of))
            for c, (at, of) in zip(reversed(part), reversed(back)):
                came = int(of[a, np.searchsorted(at, b)]) if len(at) > 1 else int(of[a, 0])
                if came >= 0:
                    word.append(ALPHABET[b - 1] if b else c.lower())
                    a, b = came, a
        return "".join(reversed(word))


def language_model(docs: DataFrame) -> LanguageModel:
    """Counted over every text, summed by Spark; the driver takes one number per trigram of the fixed alphabet."""
    def start():
        def step(texts):
            counts = np.zeros(SIZE**3, np.int64)
            for t in texts:
                if t:
                    counts += np.bincount(trigrams(t), minlength=SIZE**3) if len(t) > 50_000 else 0
            short = [trigrams(t) for t in texts if t and len(t) <= 50_000]
            if short:
                counts += np.bincount(np.concatenate(short), minlength=SIZE**3)
            at = np.flatnonzero(counts)
            return at, counts[at]
        return step

    rows = map_batches(docs.select("text"), "g int, n long", start, rows=512).groupBy("g").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE**3, np.int64)
    for g, n in rows:
        counts[g] = n
    return LanguageModel(counts)


class Restorer:
    """Restored forms of suspicious words, kept for the latest ones, and of letters set apart by spaces."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.found: dict[str, list[str]] = {}

    def word(self, word: str) -> list[str]:
        if plain(word):
            return []
        if word not in self.found:
            if len(self.found) >= CACHE_FORMS:
                self.found.clear()
            self.found[word] = self._forms(word)
        return self.found[word]

    def beginnings(self, word: str) -> list[str]:
        """The beginnings of the word and of its restored forms, each once."""
        if bare := plain(word):
            return _cut_off(bare.lower())
        return list({g for w in [word, *self.word(word)] for g in beginnings(w)})

    def _forms(self, word: str) -> list[str]:
        out = [self.model.restore(m.group()) for m in SPACED.finditer(word)]
        for token in tokens(word):
            out.append(self.model.restore(token))
            if MASK in token:
                out += self.model.unmasked(token)
        return out

    def apart(self, text: str) -> list[str]:
        out = []
        for m in RUN.finditer(text) if INNER.search(text) else ():
            run = m.group()
            if LETTER.search(run):  # as a whole, and in parts where one separator ends
                out += [self.model.restore(x) for x in dict.fromkeys([run, *(p.group() for p in SPACED.finditer(run))])]
        return out


def tokens(word: str) -> set[str]:
    """The parts between edge marks that mix letters with look-alikes, separators or masks, or repeat a letter.

    Signs at the end may be letters or marks, so both readings count. Below three characters no beginning is reached.
    """
    found = set()
    for m in PIECE.finditer(word):
        token = m.group().strip(".-_")
        token = token.strip(MASK) if token[:1] == token[-1:] == MASK else token.rstrip(MASK)  # markup, or a visible beginning
        found |= {token, token.rstrip("!|+$@").rstrip(".-_")}
    return {t for t in found if len(t) > 2 and LETTER.search(t) and MIXED.search(t)}


def plain(word: str) -> str | None:
    """The word without outer marks, if nothing is set apart, mixed or repeated in it: the usual case."""
    bare = word.strip(OUTSIDE)
    return bare if bare.isalpha() and not TRIPLE.search(bare) else None


def beginnings(word: str) -> list[str]:
    return _cut_off(word.strip(EDGES + "!|+$@").lower())


def _cut_off(word: str) -> list[str]:
    w = word + "$"
    return [w[:n] for n in BEGINNINGS if len(w) >= n]


@lru_cache(maxsize=2)
def _made(tag: str, kind: str) -> list:
    """A place of the worker process for the caches of one model, kept between tasks; the two latest stay."""
    return []


def _kept(tag: str, kind: str, make: Callable[[], object]):
    """What ``make`` gives, made once per worker process and tag."""
    place = _made(tag, kind)
    if not place:
        place.append(make())
    return place[0]


def _context(word: str) -> int:
    """The bit of a word in the set of words before a beginning."""
    return 1 << (zlib.crc32(word.encode("utf-8", "surrogatepass")) & 63)


def lexicon(train: DataFrame, model: LanguageModel) -> dict[str, float]:
    """Beginnings with their log rate ratio; ``train`` has text and y, a row per labelled document.

    A beginning counts once per document, word and word before it. Moved are, per slice and beginning, two counts and a
    64-bit set of hashed words before it in toxic texts.
    """
    tag = uuid.uuid4().hex

    def start():
        restorer = _kept(tag, "restorer", lambda: Restorer(model))

        def step(texts, ys):
            seen, total = (Counter(), Counter()), [0, 0]
            contexts: dict = defaultdict(int)
            for text, y in zip(texts, ys):
                words = WORD.findall(text) + restorer.apart(text)
                total[y] += len(words)
                pairs = set(zip(["", *words], words))
                seen[y].update([word for _, word in pairs])
                if y:
                    for before, word in pairs:
                        contexts[word] |= _context(before)
            sums: dict = defaultdict(lambda: [0, 0, 0])
            for y, counted in enumerate(seen):  # words are taken apart once a slice
                for word, n in counted.items():
                    context = contexts[word] if y else 0
                    for g in restorer.beginnings(word):
                        row = sums[g]
                        row[y] += n
                        row[2] |= context
            rows = [(g, *row) for g, row in sums.items()] + [(None, *total, 0)]
            g, clean, toxic, masks = zip(*rows)
            return list(g), list(clean), list(toxic), np.array(masks, np.uint64).view(np.int64)
        return step

    rows = map_batches(train.select("text", F.when(F.col("y") > 0, 1).otherwise(0).alias("y")), "g string, clean long, toxic long, mask long", start, rows=4096)
    sums = cut(rows.groupBy("g").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("mask").alias("mask")))
    total = sums.where("g IS NULL").first()
    if total is None or not total.clean or not total.toxic:
        return {}
    low = F.greatest(F.lit(0.0), F.col("toxic") - CONFIDENCE * F.sqrt("toxic")) / total.toxic
    ratio = low / ((F.col("clean") + 1) / total.clean)
    kept = sums.where("g IS NOT NULL").where(F.bit_count("mask") >= MIN_CONTEXTS).select("g", ratio.alias("r")).where(F.col("r") > MIN_RATIO)
    return {g: min(MAX_LOG_RATIO, float(np.log(r))) for g, r in kept.collect()}  # beginnings of at most seven characters


class _Weights(dict):
    def __init__(self, model: LanguageModel, known: dict[str, float]):
        super().__init__()
        self.restorer, self.known = Restorer(model), known
        self.heads = {g[:BEGINNINGS[0]] for g in known}

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        bare = plain(word)
        if bare and (bare.lower() + "$")[:BEGINNINGS[0]] not in self.heads:
            p = 0.0
        else:
            p = max([self.known.get(g, 0.0) for g in self.restorer.beginnings(word)], default=0.0)
        self[word] = p
        return p


class Evidence:
    """Three sums over the lexicon words of a restored text, and a one: weight, weight per word, different words."""

    def __init__(self, model: LanguageModel, known: dict[str, float]):
        self.weights = _Weights(model, known)

    def __call__(self, text: str | None) -> list[float]:
        words = WORD.findall(text or "")
        words += self.weights.restorer.apart(text or "")
        each = list(map(self.weights.__getitem__, words))
        weight = sum(filter(None, each))
        return [min(weight, 30) / 5, min(60, 1000 * weight / max(20, len(words))) / 20, min(len(set(compress(words, each))), 6) / 2, 1.0]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) + 0.1 * w), -3, 3)
    return w


def _fitted(docs: DataFrame, said: DataFrame, model: LanguageModel, known: dict[str, float], tag: str) -> np.ndarray | None:
    sample = said.orderBy(F.xxhash64("key"), "key").limit(MAX_FIT_ROWS)
    rows = docs.where("text IS NOT NULL").select(key_of().alias("key"), "text").join(F.broadcast(sample), "key").select("text", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))

    def start():
        evidence = _kept(tag, "evidence", lambda: Evidence(model, known))
        return lambda texts, ys: [[list(x) for x in zip(*[evidence(t) for t in texts])][k] for k in range(3)] + [ys]

    found = map_batches(rows, "a double, b double, c double, y int", start).groupBy("a", "b", "c", "y").count().collect()
    if len({r.y for r in found}) < 2:
        return None
    n = np.array([r["count"] for r in found])
    x = np.repeat(np.array([[r.a, r.b, r.c, 1.0] for r in found]), n, axis=0)
    return _logistic(x, np.repeat(np.array([r.y for r in found], float), n))


def _scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``toxicity`` and ``_tie``, the hash of the text."""
    model = language_model(docs)
    said = labels.where("toxic IS NOT NULL").groupBy(key_of().alias("key")).agg(F.max("toxic").alias("y")).where(id_remainder(id_of("key"), MODULUS) != HELD_OUT)
    # One plan at every size: labels grow with the documents, and hashing their side spares a sort of the texts.
    train = docs.where("text IS NOT NULL").select(key_of().alias("key"), "text").join(said.hint("shuffle_hash"), "key")
    known = lexicon(train, model)
    tag = uuid.uuid4().hex
    weights = _fitted(docs, said, model, known, tag)

    def start():
        evidence = _kept(tag, "evidence", lambda: Evidence(model, known))

        def one(text):
            return 0.0 if weights is None else float(1 / (1 + np.exp(-np.clip(np.array(evidence(text)) @ weights, -30, 30))))
        return lambda ids, held, ties, texts: (ids, held, ties, [one(t) for t in texts])

    rows = docs.select(F.col("doc_id").cast("long"), (id_remainder("doc_id", MODULUS) == HELD_OUT).alias("held"), F.xxhash64("text").alias("_tie"), "text")
    scored = map_batches(rows, "doc_id long, held_out boolean, _tie long, score double", start)
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Held-out rows give no labels. A doc_id with several labels is toxic if one of them is; null labels are ignored.
    Null and empty texts score like any text without a lexicon word. Without labels of both classes every score is 0.
    Repeated rows get equal scores.
    """
    return _scores(docs, labels).drop("_tie")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic.

    Rows are told apart by id and text, so rows without an id, or with an id that stands twice, are judged by their own text.
    """
    hit = _scores(docs, labels).where("predicted = 1").select(key_of("doc_id").alias("_key"), "_tie").distinct()
    keyed = docs.select(key_of().alias("_key"), F.xxhash64("text").alias("_tie"), F.struct(*docs.columns).alias("_row"))
    return keyed.join(hit, ["_key", "_tie"], "left_anti").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
