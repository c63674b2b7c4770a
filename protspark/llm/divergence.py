"""Quality rules: distribution divergence from language references.

Every language has two reference histograms, summed over all of its documents: shares of character classes, and
shares of its most common short words. A document is compared with the reference of its language by Jensen-Shannon
distance (base 2, between 0 and 1); a document without a language is compared with all and takes the nearest.
Short documents have noisy histograms, so each comparison has a minimum length below which it passes.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F

from protspark.functions.lineage import cut
from protspark.llm.common import WORD, map_batches

#: Parameters of the method.
MAX_CLASS_DISTANCE = 0.27
MAX_WORD_DISTANCE = 0.36
MIN_CHARS = 200
MIN_WORDS = 100
COMMON_WORDS = 50
MAX_COMMON_LENGTH = 5

#: Parameters of the base rules.
MIN_BASE_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOLS = re.compile(r"[#*$%&|<>]")
CLASSES = ["lower", "upper", "other letter", "digit", "space", "line end", "stop", "mark", "symbol"]
_STOPS, _MARKS = ".,;:!?", "'\"()-_/"


def _class_of(c: int) -> int:
    s = chr(c)
    if s.isalpha():
        return 0 if s.islower() else 1 if s.isupper() else 2
    if s.isdigit():
        return 3
    return 5 if s in "\r\n" else 4 if s.isspace() else 6 if s in _STOPS else 7 if s in _MARKS else 8


_FEW = np.array([_class_of(c) for c in range(0x3000)], np.uint8)


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(_FEW[codes[codes < len(_FEW)]], minlength=len(CLASSES))
    for c in codes[codes >= len(_FEW)].tolist():
        counts[_class_of(c)] += 1
    return counts


def common_words(words: list[str]) -> Counter:
    """Short words of letters only, in lower case."""
    short = Counter(w for w in words if len(w) <= MAX_COMMON_LENGTH)
    out = Counter()
    for w, n in short.items():
        if w.isalpha():
            out[w.lower()] += n
    return out


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; an empty one is at distance 1 from any other."""
    if not p.sum() or not q.sum():
        return 0.0 if p.sum() == q.sum() else 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def references(docs: DataFrame) -> dict[str, dict]:
    """Per language: class counts, its common words and their counts, all words. Counted over every document.

    What comes to the driver is bounded by the number of languages times the classes and common words.
    """
    def start():
        def step(langs, texts):
            sums = defaultdict(Counter)
            for lang, text in zip(langs, texts):
                if lang is None or text is None:
                    continue
                words = WORD.findall(text)
                for w, n in common_words(words).items():
                    sums[lang]["w" + w] += n
                sums[lang]["n"] += len(words)
                for k, n in enumerate(class_counts(text).tolist()):
                    sums[lang][f"c{k}"] += n
            rows = [(lang, item, n) for lang, c in sums.items() for item, n in c.items()]
            return [list(c) for c in zip(*rows)] if rows else None
        return step

    counts = map_batches(docs.select(F.col("lang").cast("string"), "text"), "lang string, item string, n long", start, rows=4096)
    counts = cut(counts.groupBy("lang", "item").agg(F.sum("n").alias("n")))
    first = F.row_number().over(_by_count()) <= COMMON_WORDS
    words = counts.where(F.col("item").startswith("w")).select("*", first.alias("top")).where("top").drop("top")
    out: dict[str, dict] = {}
    for lang, item, n in counts.where(~F.col("item").startswith("w")).union(words).collect():
        ref = out.setdefault(lang, {"classes": np.zeros(len(CLASSES)), "words": {}, "n": 0})
        if item == "n":
            ref["n"] = n
        elif item[0] == "c":
            ref["classes"][int(item[1:])] = n
        else:
            ref["words"][item[1:]] = n
    for ref in out.values():
        ref["words"] = dict(sorted(ref["words"].items()))
    return out


def _by_count():
    from pyspark.sql.window import Window
    return Window.partitionBy("lang").orderBy(F.desc("n"), "item")


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(windows) != len(seen := set(windows)):
        counts, reach = Counter(windows), 0
        for k, w in enumerate(windows):
            if counts[w] > 1:
                repeated += k + 3 - max(reach, k)
                reach = k + 3
    return sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


def divergence(text: str, words: list[str], ref: dict) -> tuple[float, float]:
    classes = distance(class_counts(text).astype(float), ref["classes"])
    mine = common_words(words)
    top = list(ref["words"])
    rest = lambda part, n: np.array([part.get(w, 0) for w in top] + [n - sum(part.get(w, 0) for w in top)], float)
    return classes, distance(rest(mine, len(words)), rest(ref["words"], ref["n"]))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    Null and empty texts have no words and fail the base rule on length. A document whose text is long enough for a
    comparison is dropped if it lies farther from its reference than the limit. Distances are null where a document
    is too short to judge, or if no reference exists.
    """
    refs = references(docs)

    def start():
        def step(ids, langs, texts):
            rows = []
            for i, lang, text in zip(ids, langs, texts):
                text = text or ""
                words = WORD.findall(text)
                base = base_counts(text, words)
                failed = len(words) < MIN_BASE_WORDS or 100 * base[3] > MAX_REPEAT_PERCENT * len(words)
                classes = shares = None
                near = [refs[lang]] if lang in refs else refs.values()
                if near and (len(text) >= MIN_CHARS or len(words) >= MIN_WORDS):
                    classes, shares = min((divergence(text, words, r) for r in near), key=sum)
                    classes = classes if len(text) >= MIN_CHARS else None
                    shares = shares if len(words) >= MIN_WORDS else None
                far = (classes or 0.0) > MAX_CLASS_DISTANCE or (shares or 0.0) > MAX_WORD_DISTANCE
                rows.append((i, len(words), *base, failed, not failed and not far,
                             None if classes is None else round(classes, 4), None if shares is None else round(shares, 4)))
            return [list(c) for c in zip(*rows)]
        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text"),
                       "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                       "base_failed boolean, kept boolean, class_distance double, word_distance double", start)
