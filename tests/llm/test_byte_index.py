import random

import pytest
import xxhash

from protspark.llm import byte_index as B, components
from protspark.llm.common import LOWEST


def brute(rows):
    def fp(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
        if not words:
            return 0
        n = max(1, len(words) - 3)
        hs = [xxhash.xxh64(" ".join(words[k:k + 4]).encode(), seed=42).intdigest() for k in range(n)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)
    prints = [fp(t) for _, t in rows]
    root = list(range(len(rows)))
    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                root[find(a)] = find(b)
    ids = [LOWEST if i is None else i for i, _ in rows]
    least = {}
    for a in range(len(rows)):
        least[find(a)] = min(least.get(find(a), 2**63), ids[a])
    return sorted((ids[a], f"{prints[a]:016x}", least[find(a)]) for a in range(len(rows)))


def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(400)) for _ in range(12)]
    rows = []
    for k in range(90):
        words = base[k % 12].split()
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = "new" + str(k)
        rows.append((k * 3 % 97, " ".join(words)))
    return rows + [(200, None), (201, ""), (202, "\t\n"), (203, "one"), (204, "One"), (None, "two three"), (205, "two  three"),
                   (3, rows[1][1]), (3, rows[1][1]), (206, "Élan vital " * 3), (207, "long " * 60_000)]


@pytest.mark.parametrize("hot", [2_000, 1])
def test_components(docs_of, hot):
    rows = texts()
    got = sorted((LOWEST if r.doc_id is None else r.doc_id, r.fingerprint, LOWEST if r.component_id is None else r.component_id)
                 for r in B.near_duplicates(docs_of(rows), hot).collect())
    assert got == brute(rows)


def test_empty(docs_of):
    assert B.near_duplicates(docs_of([])).count() == 0


def test_links_of_random_fingerprints(spark):
    rng = random.Random(1)
    fps = {0, 2**63, 2**64 - 1}
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            for _ in range(rng.randint(1, 5)):
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "node long, fp long")
    got = {tuple(sorted(r)) for r in B.fingerprint_links(df).collect()}
    want = {(a, b) for b in range(len(fps)) for a in range(b) if bin(fps[a] ^ fps[b]).count("1") <= 4}
    assert got == want


def test_one_of_each_keeps_columns(docs_of):
    df = B.one_of_each(docs_of([(5, "same text here now"), (2, "same text here now"), (2, "same text here now"), (9, "another one"), (None, "same text here now")]))
    assert df.columns == ["doc_id", "text", "key", "fp", "n_words", "score"]
    assert sorted((r.doc_id or -1, r.text) for r in df.collect()) == [(-1, "same text here now"), (9, "another one")]


def test_pairs_of_a_crowded_list_come_in_parts():
    """The reader holds back a bounded number of rows, however many pairs one list has, and gives each pair once."""
    import inspect

    fps = [a | b << 8 for a in (1, 2, 4, 8, 16, 32, 64, 128) for b in range(0, 256, 3) if b.bit_count() < 4]
    read = B._Lists(hot=2_000, part=500)
    parts = read([0] * len(fps), fps, list(range(len(fps))))
    assert inspect.isgenerator(parts)
    parts = [*parts, *read.finish()]
    got = [(int(a), int(b)) for a, b, _ in (r for p in parts for r in zip(*p))]
    want = {(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 4}
    assert len(got) == len(want) and set(got) == want and len(want) > 5_000
    assert max(len(p[0]) for p in parts) < 500 + len(fps)


@pytest.mark.parametrize("edges", [[], [(1, 2), (1, 3), (7, 9)], [(k, k + 1) for k in range(40)], [(2, 1), (1, 2), (5, 5), (4, 2), (9, 8), (8, 7), (7, 9)]])
def test_rounds_of_components_write_few_files_and_end_at_stars(spark, monkeypatch, edges):
    made, whole = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: made.append(out := whole(df)) or out)
    monkeypatch.setattr(components, "FILES", 2)
    monkeypatch.setattr(components, "FILE_ROWS", 10)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: r for n, r in root.items() if n in linked}
    assert max(df.rdd.getNumPartitions() for df in made) <= max(2, len(edges) // 10)
    assert len(made) == 1 or len(edges) > 3  # stars need no round
