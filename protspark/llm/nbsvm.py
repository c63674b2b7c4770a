"""Quality classifier: naive Bayes support vectors over n-grams of word shapes.

A word's shape is its case pattern, the marks behind it, and whether it repeats the word before. A document is the set
of its shape n-grams (one to three words, hashed). Log-count ratios of the classes come from all labelled rows that may
be learned from; they scale the indicators. A linear hinge-loss model is fitted to the scaled vectors by dual
coordinate descent, on at most ``MAX_FIT_ROWS`` rows in hash order, and its margin becomes a probability by Platt's
logistic fit.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from protspark.functions.lineage import cut
from protspark.llm.common import WORD, id_of, id_remainder, key_of, map_batches

BUCKETS = 1 << 16
MAX_FIT_ROWS = 20_000
THRESHOLD = 0.3
COST, EPOCHS = 1.0, 12
MODULUS, HELD_OUT = 5, 0
CACHE_WORDS = 200_000

_MARKS = ".,;:!?\"'()[]{}#*$%&|<>"
_RUN = re.compile(r"(.)\1+")


class _Shapes(dict):
    def __missing__(self, word: str) -> str:
        core = word.strip(_MARKS)
        tail = word[len(word.rstrip(_MARKS)):] if core else word
        kind = ("-" if not core else "d" if core.isdigit() else "l" if core.islower()
                else "T" if core[0].isupper() and (len(core) == 1 or core[1:].islower()) else "U" if core.isupper() else "m")
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = shape = kind + _RUN.sub(r"\1\1", tail)[:3]
        return shape


def ngrams(text: str | None, shapes: _Shapes) -> list[int]:
    words = WORD.findall(text or "")
    seen = [shapes[w] + "=" if w == before else shapes[w] for w, before in zip(words, [None, *words])]
    grams = {" ".join(g) for n in (1, 2, 3) for g in set(zip(*[seen[k:] for k in range(n)]))}
    grams.add("words:%d" % min(len(words).bit_length(), 8))
    return sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})


def featured(docs: DataFrame) -> DataFrame:
    def start():
        shapes = _Shapes()
        return lambda keys, texts: (keys, [ngrams(t, shapes) for t in texts])

    return map_batches(docs.select(key_of().alias("key"), "text"), "key long, grams array<int>", start)


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic of the margin, with Platt's smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - goal) * margin).sum() + 1e-3 * a, (p - goal).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return a, b


def fit(rows: list[tuple[list[int], int]], ratio: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias, and the logistic's slope and offset; dual coordinate descent for the hinge loss."""
    xs = []
    for grams, _ in rows:
        at = np.array(grams, np.int64)
        v = ratio[at]
        xs.append((at, v / max(1e-12, float(np.sqrt((v * v).sum())))))
    y = np.array([1.0 if label else -1.0 for _, label in rows])
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)).tolist():
            at, v = xs[k]
            gain = y[k] * (w[at] @ v + bias) - 1
            new = min(max(alpha[k] - gain / (v @ v + 1), 0.0), COST)
            if new != alpha[k]:
                step = (new - alpha[k]) * y[k]
                alpha[k] = new
                w[at] += step * v
                bias += step
    margin = np.array([w[at] @ v + bias for at, v in xs])
    return w, bias, *_platt(margin, y)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Held-out rows are never learned from. A doc_id with several labels counts by its largest; null labels are
    ignored. Null and empty texts are scored like any other, by the n-gram that says how long a text is. Without
    labels of both classes the score is the share of good ones, or 0.5 if there are none.
    """
    rows = cut(featured(docs))
    said = labels.where("quality IS NOT NULL").groupBy(key_of().alias("key")).agg(F.max("quality").alias("y"))
    train = rows.join(said.where(id_remainder(id_of("key"), MODULUS) != HELD_OUT), "key")
    counts = np.ones((2, BUCKETS))
    for g, y, n in train.select(F.explode("grams").alias("g"), "y").groupBy("g", "y").count().collect():  # at most two numbers per bucket
        counts[1 if y else 0, g] += n
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    sample = [(r.grams, r.y) for r in train.orderBy(F.xxhash64("key"), "key", "grams").limit(MAX_FIT_ROWS).collect()]
    share = float(np.mean([bool(y) for _, y in sample])) if sample else 0.5
    model = fit(sample, ratio) if 0 < share < 1 else None

    def start():
        def score(grams):
            if model is None:
                return share
            w, bias, a, b = model
            at = np.array(grams, np.int64)
            v = ratio[at]
            z = a * (float(w[at] @ v) / max(1e-12, float(np.sqrt((v * v).sum()))) + bias) + b
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return lambda keys, grams: (keys, [score(g) for g in grams])

    scored = map_batches(rows.select("key", "grams"), "key long, score double", start)
    return scored.select(id_of("key").alias("doc_id"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")).select(
        "doc_id", (id_remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score", "predicted")
