"""Language identification by nearest centroid.

A text is a vector of hashed character n-grams (one to three characters of its lower-cased words), log-scaled, times
inverse document frequency, normalised. Every language has a few centroids, found by spherical k-means on at most
``SAMPLE_PER_LANGUAGE`` learnable documents in hash order; document frequencies are counted over all learnable ones.
The nearest centroid by cosine names the language. A text that is farther from it than nearly all learned texts of that
centroid is marked as rejected.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from protspark.llm.common import id_remainder, key_of, map_batches

DIMENSIONS = 4096
SAMPLE_PER_LANGUAGE = 300
CENTROIDS, ROUNDS = 4, 12
REJECT_DEVIATIONS = 4.0
MODULUS, HELD_OUT = 3, 1
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")
CHUNK = 1 << 20


def has_letter(text: str) -> bool:
    """Is there a letter (general category L), as ``\\p{L}`` says in the fitting sample? Signs such as ``²`` or ``½`` are none."""
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of the letters of a text; every other run of characters is one space."""
    out = np.zeros(DIMENSIONS, np.int64)
    letters = " " + NOT_LETTERS.sub(" ", text.lower()) + " "
    codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for a in range(0, len(codes), CHUNK):
        c = codes[a:a + CHUNK + 2] * np.uint64(0x9E3779B97F4A7C15)
        one, last = c, CHUNK if a + CHUNK < len(codes) else len(c)
        two = one[:-1] * np.uint64(31) + c[1:]
        three = two[:-1] * np.uint64(37) + c[2:]
        for grams in (one[:last], two[:last], three[:last]):
            h = grams ^ (grams >> np.uint64(29))
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out += np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=DIMENSIONS)
    return out


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(text)) * idf
    return v / max(1e-12, float(np.sqrt(v @ v)))


def _learnable(docs: DataFrame) -> DataFrame:
    known = F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder("doc_id", MODULUS) != HELD_OUT)
    return docs.where(known).select(key_of().alias("key"), F.col("lang").cast("string").alias("lang"), "text")


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Over every learnable document; one number per dimension and batch is moved."""
    def start():
        def step(texts):
            df = np.zeros(DIMENSIONS, np.int64)
            n = 0
            for t in texts:
                if has_letter(t):
                    df += counts(t) > 0
                    n += 1
            at = np.flatnonzero(df)
            return [np.append(at, -1), np.append(df[at], n)]
        return step

    sums = map_batches(texts.select("text"), "d int, n long", start, rows=4096).groupBy("d").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(DIMENSIONS), 0
    for d, n in sums:
        if d < 0:
            total = n
        else:
            df[d] = n
    return np.log((1 + total) / (1 + df)) + 0.05


def clusters(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; centroids and, for each, the smallest cosine that is not rejected."""
    picks = [0]
    nearest = vectors @ vectors[0]
    while len(picks) < min(CENTROIDS, len(vectors)):
        picks.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[picks[-1]])
    centres = vectors[picks]
    for _ in range(ROUNDS):
        own = np.argmax(vectors @ centres.T, axis=1)
        sums = np.array([vectors[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(1e-12, np.sqrt((sums * sums).sum(axis=1, keepdims=True)))
    cosines = vectors @ centres.T
    own = np.argmax(cosines, axis=1)
    limits = []
    for k in range(len(centres)):
        near = cosines[own == k, k]
        limits.append(float(near.mean() - REJECT_DEVIATIONS * near.std()) if len(near) else 0.0)
    return centres, np.array(limits)


def fit(docs: DataFrame) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Inverse frequencies, the language of each centroid, centroids, and rejection limits."""
    texts = _learnable(docs)
    idf = inverse_frequencies(texts)
    order = Window.partitionBy("lang").orderBy("h", "key", "th")
    ids = texts.where(F.regexp_like("text", F.lit(r"\p{L}"))).select("lang", "key", F.xxhash64("key").alias("h"), F.xxhash64("text").alias("th"))
    chosen = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_PER_LANGUAGE).select("key", "th", "lang").distinct()
    picked = texts.withColumn("th", F.xxhash64("text")).join(F.broadcast(chosen), ["key", "th", "lang"]).select("lang", "key", "th", "text").dropDuplicates(["key", "th", "lang"])

    def start():
        return lambda langs, keys, hashes, texts: (langs, keys, hashes, [vector(t, idf).astype(np.float32).tobytes() for t in texts])

    rows = map_batches(picked, "lang string, key long, th long, v binary", start).orderBy("lang", "key", "th").collect()  # the bounded sample
    by: dict[str, list] = {}
    for lang, _, _, v in rows:
        by.setdefault(lang, []).append(np.frombuffer(v, np.float32))
    names, centres, limits = [], [], []
    for lang in sorted(by):
        c, limit = clusters(np.array(by[lang], np.float64))
        names += [lang] * len(c)
        centres.append(c)
        limits.append(limit)
    return idf, names, np.concatenate(centres) if centres else np.zeros((0, DIMENSIONS)), np.concatenate(limits) if limits else np.zeros(0)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row.

    ``und`` with score 0 is given to texts that are null or have no letter, and to all texts if nothing was learned.
    Any other text gets the nearest learned language; the score is the cosine, and ``rejected`` says that it is farther
    from its centroid than learned texts are. Equal cosines take the first language by code point.
    """
    idf, names, centres, limits = fit(docs)
    flat = np.ascontiguousarray(centres.T)

    def start():
        def one(text):
            if text is None or not names or not has_letter(text):
                return UNKNOWN, 0.0, True
            cos = vector(text, idf) @ flat
            k = int(np.argmax(cos))
            return names[k], float(min(1.0, max(0.0, cos[k]))), bool(cos[k] < limits[k])

        def step(ids, held, texts):
            found = [one(t) for t in texts]
            return [ids, held, *[list(c) for c in zip(*found)]]
        return step

    rows = docs.select(F.col("doc_id").cast("long"), (id_remainder("doc_id", MODULUS) == HELD_OUT).alias("held"), "text")
    return map_batches(rows, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean", start)
