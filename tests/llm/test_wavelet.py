import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from protspark.functions.lineage import shared_folder
from protspark.llm import wavelet as W


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_matrix():
    rng = np.random.default_rng(1)
    for n in (1, 7, 511, 512, 513, 3_000):
        ids = rng.integers(0, 40, n).astype(np.uint16) * 1237
        m = W.WaveletMatrix.build(ids, 16)
        assert (m.decode() == ids).all()
        assert [m.access(i) for i in range(0, n, 7)] == ids[::7].tolist()
        for v in {int(ids[0]), int(ids[-1]), 5}:
            at = np.flatnonzero(ids == v).tolist()
            assert m.count(v) == len(at) and [m.select(v, j) for j in range(len(at))] == at
            assert m.count(v, n // 3, n // 2) == sum(n // 3 <= x < n // 2 for x in at)


def test_encoder_equals_library(library):
    rng = random.Random(4)
    bits = ["the", "house", "é", "Ünder", "'s", "don't", "x_y", "12", "3.5", " ", " ", " ", "  ", "\n", "\t", "!!", "...", "<|endoftext|>", "\x85", "\x1c", "日本", "ß,", "a-b", "'", " ", "　", "ª", "²", "\n", "a\nb", "x.\nÉ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(4_000)]
    encode = W.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(0, len(texts), 500):
        part = texts[k:k + 500]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(b, np.uint16).tolist() for b in encode(part)] == want


def test_encoder_with_a_full_cache(library, monkeypatch):
    monkeypatch.setattr(W, "CACHE_PIECES", 3)
    encode = W.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "one two three, it's four\n\n five ’six’ two  one seven² one 12 two\n"
    for _ in range(3):
        assert np.frombuffer(encode.one(text), np.uint16).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encode.pieces) <= 4 and len(encode.pieces.old) <= 4


@pytest.mark.parametrize("limit", [50, 1 << 22])
def test_documents(docs_of, library, limit):
    rng = random.Random(9)
    rows = [(rng.randrange(-50, 500), " ".join(rng.choice(["alpha", "beta,", "gamma.", "d"]) for _ in range(rng.randint(0, 40)))) for _ in range(120)]
    rows += [(700, None), (701, ""), (None, "no id"), (3, "twice"), (3, "twice"), (800, "very long " * 30_000)]
    df = docs_of(rows).repartition(5)
    folder = shared_folder(df.sparkSession, "test-wavelet")
    got = W.encode_documents(df, folder, shard_tokens=limit).collect()
    want = sorted((-(2**63) if i is None else i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in rows)
    got = sorted(((-(2**63) if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got)
    assert [g[0] for g in got] == [w[0] for w in want]
    at = 0
    for g in got:
        assert g[1] == at
        at += g[2]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((g[0], g[2], g[3]) for g in got) == sorted((i, len(x), crc(x)) for i, x in want)
    shards = W.read_shards(df, folder)
    token = library.encode(" beta", add_special_tokens=False).ids[0]
    n = sum(x.count(token) for _, x in want)
    assert {r.token: r.n for r in W.token_counts(shards, [token, 49_999]).collect()} == {token: n, 49_999: 0}
    assert W.occurrences(shards, token).count() == n


def test_empty(docs_of):
    assert W.encode_documents(docs_of([])).count() == 0
