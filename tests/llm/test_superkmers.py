import hashlib
import random
import re

import numpy as np
import pytest

from protspark.llm import superkmers as S
from protspark.llm.common import LOWEST


def brute(rows, window):
    rows = [(LOWEST if i is None else i, [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) for i, t in rows]
    first = {}
    for i, words in rows:
        for k in range(len(words) - window + 1):
            w = tuple(words[k:k + window])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, words in rows:
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def data():
    rng = random.Random(11)
    text = lambda n: [rng.choice(["ab", "cd", "é", "fg,", "h"]) + str(rng.randrange(40)) for _ in range(n)]
    base = [text(160) for _ in range(5)]
    rows = []
    for k in range(120):
        words = list(base[k % 5])
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = f"x{k}"
        if k % 3 == 0:
            words = text(30) + words[10:120] + text(20)
        rows.append((k * 7 % 127, (" \n" if k % 2 else " ").join(words)))
    return rows + [(300, None), (301, ""), (302, "few words"), (None, " ".join(base[0])), (5, rows[3][1]), (5, rows[3][1]), (303, "te " * 3_000), (304, "te " * 400),
                   (305, " ".join(text(30_000) + base[1]))]


@pytest.mark.parametrize("slice_strings", [2_000, 3])
@pytest.mark.parametrize("window", [50, 9])
def test_equals_brute_force(docs_of, slice_strings, window):
    rows = data()
    got = S.repeated_words(docs_of(rows).repartition(4), window, slice_strings=slice_strings).collect()
    assert sorted((LOWEST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, window)


def test_minimisers():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 200).astype(np.uint64)
    one = [S.minimisers(h[k:k + 50])[0] for k in range(151)]
    assert (S.minimisers(h) == np.array(one)).all()


def test_empty(docs_of):
    assert S.repeated_words(docs_of([])).count() == 0
