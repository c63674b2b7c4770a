import hashlib
import random
import re

import numpy as np
import pytest

from protspark.llm import fill_in_middle as M


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, out[0], len(p), len(m), out[1]


def texts(n=800):
    rng = random.Random(8)
    bits = ["\n", "\n\n", "a", "é", "日本", "🙂", "x" * 9, "\r", "\x0b", "\x8a", "<P", ">", "<S", "Ċ", "\x00", "line of words "]
    return ([(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for k in range(n)]
            + [(n, None), (n + 1, ""), (n + 2, "a<P>b"), (n + 3, "<M>"), (n + 4, "\n"), (n + 5, "é\n" * 70_000 + "z"), (n + 6, "q" * 300_000),
               (None, "one\ntwo\nthree"), (None, None), (7, "again\nthe same id"), (-5, "minus\nfive\nlines\n")])


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (100, 100)])
def test_equals_plain_python(spark, docs_of, rate, spm):
    rows = texts()
    out = M.fill_in_middle(docs_of(rows), rate_percent=rate, spm_percent=spm)
    back = out.withColumn("back", M.restored(out.fim, out.form)).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.fim) for r in back), key=repr)
    assert got == sorted(((i, *brute(i, t, rate, spm)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.back) for r in back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {r.form for r in back} >= {"plain"} | ({"spm"} if spm else {"psm"})


def test_digests(spark, docs_of):
    rows = texts(60)
    want = []
    for i, t in rows:
        n, form, p, m, out = brute(i, t)
        want.append((i, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, M.digests(docs_of(rows)).collect()), key=repr) == sorted(want, key=repr)


def test_rank_and_select():
    rng = np.random.default_rng(9)
    for n in (0, 1, 7, 8, 9, 64, 1000):
        data = rng.integers(0, 256, n, dtype=np.uint8)
        data[rng.random(n) < 0.3] = 10
        padded = np.zeros((n >> 3) + 1 << 3, np.uint8)
        padded[:n] = data
        marks = M.Marks(M.equal_bytes(padded.view("<u8"), 10))
        at = np.flatnonzero(data == 10)
        assert (marks.select(np.arange(len(at))) == at).all()
        assert marks.rank(np.arange(n + 1)).tolist() == [int((data[:k] == 10).sum()) for k in range(n + 1)]
        inner = M.Marks(M.continuation_bytes(padded.view("<u8")))
        assert inner.rank(np.array([n]))[0] == int(((data & 0xC0) == 0x80).sum())


def test_small_slices_and_empty(spark, docs_of, monkeypatch):
    monkeypatch.setattr(M, "BYTES_PER_SLICE", 5)
    rows = texts(40)[:40]
    assert sorted(r.fim for r in M.fill_in_middle(docs_of(rows)).collect()) == sorted(brute(i, t)[4] for i, t in rows)
    assert M.digests(docs_of(rows).filter("false")).collect() == []
    with pytest.raises(ValueError):
        M.fill_in_middle(docs_of(rows), unit_end="é")
