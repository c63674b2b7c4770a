import random

import pytest

from protspark.llm import near_copies as N


def sets(t):
    w = (t or "").lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
                root[find(a)] = find(b)
    least = {}
    for a, (i, t) in enumerate(rows):
        key = (-2**63 if i is None else i)
        least[find(a)] = min(least.get(find(a), key), key)
    return sorted(least.values())


def texts():
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(120)] for _ in range(8)]
    rows = []
    for k in range(96):
        words = list(base[k % 8])
        for _ in range(k % 7):
            words[rng.randrange(len(words))] = f"new{k}"
        rows.append((1000 - k, " ".join(words + ["tail"] * (k % 3))))
    return rows + [(5, None), (6, ""), (7, "one"), (8, "One"), (9, "one two"), (3000, rows[0][1])]


@pytest.mark.parametrize("hot", [200, 3])
def test_all_pairs_at_the_similarity(docs_of, hot):
    rows = texts()
    got = sorted(r.doc_id for r in N.one_of_each(docs_of(rows), hot).collect())
    assert got == brute(rows)
    assert len(got) < len(rows) - 20


def test_far_fingerprints_are_near_copies_and_close_ones_are_not(docs_of):
    """Four edits in 200 words: 0.82 by five-word sets, beyond the 4 bits of op9. Six are 0.74, below 0.8."""
    w = [f"w{k}" for k in range(200)]
    near = [f"x{k}" if k in (20, 70, 120, 170) else x for k, x in enumerate(w)]
    far = [f"y{k}" if k in (20, 50, 80, 110, 140, 170) else x for k, x in enumerate(w)]
    assert [r.doc_id for r in N.one_of_each(docs_of([(1, " ".join(w)), (2, " ".join(near))])).collect()] == [1]
    assert sorted(r.doc_id for r in N.one_of_each(docs_of([(1, " ".join(w)), (2, " ".join(far))])).collect()) == [1, 2]


def test_rows_without_id_are_judged_by_their_text(docs_of):
    rows = [(None, "the first text without an id"), (None, "quite another one of them here"), (4, "one id with two texts a"), (4, "that differ in every single word"), (5, "one id with two texts a")]
    assert sorted(r.text for r in N.one_of_each(docs_of(rows)).collect()) == sorted(t for _, t in rows[:4])
