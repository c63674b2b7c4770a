import random
import re

import numpy as np

from protspark.llm import divergence as D


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    wins = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    hit = set()
    for k, w in enumerate(wins):
        if wins.count(w) > 1:
            hit |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_counts():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é", "\t", "\x85", "a b c ", "x\n"]) for _ in range(rng.randint(0, 60)))
        assert D.base_counts(text, D.WORD.findall(text)) == brute(text), repr(text)


def test_distance():
    a, b = np.array([1.0, 0]), np.array([0, 2.0])
    assert D.distance(a, a) == 0 and D.distance(a, b) == 1 and D.distance(a * 0, b) == 1 and D.distance(a * 0, b * 0) == 0


def test_rules(spark):
    rng = random.Random(2)
    vocab = ["the", "and", "of", "to"] * 20 + ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(4, 9))) for _ in range(400)]
    good = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    rows = [(k, good(rng.randint(150, 300)), "en") for k in range(60)]
    rows += [(100, good(200).replace(" ", " ### "), "en"), (101, good(200).upper(), "en"), (102, "word " * 300, "en"), (103, None, "en"),
             (104, "", None), (105, good(200), None), (106, good(200), "xx"), (107, good(49), "en"), (None, good(200), "en"),
             (1, rows[1][1], "en"), (108, good(90_000), "en")]
    df = spark.createDataFrame([(i, t, g, 9, "s") for i, t, g in rows], "doc_id long, text string, lang string, n_words int, item string")
    got = {}
    for r in D.quality_rules(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(r.kept for k in range(60) for r in got[k]) and len(got[1]) == 2 and got[1][0] == got[1][1]
    assert not got[100][0].kept and not got[101][0].kept and got[100][0].class_distance > D.MAX_CLASS_DISTANCE
    assert got[102][0].base_failed and got[103][0].base_failed and got[104][0].base_failed and got[107][0].base_failed
    assert got[103][0].n_words == 0 and got[103][0].class_distance is None
    assert got[105][0].kept and got[None][0].kept and got[108][0].n_words == 90_000 and got[106][0].class_distance == 0
    for i, t, g in rows[:-1]:
        assert (got[i][0].word_chars, got[i][0].n_symbols, got[i][0].n_dup_lines, got[i][0].n_repeat_words) == brute(t)


def test_empty(spark):
    assert D.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
