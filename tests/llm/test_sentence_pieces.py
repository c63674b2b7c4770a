import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from protspark.llm import sentence_pieces as X

BITS = ["the", "house", "é", "Ünder", "'s", " ", "  ", "   ", " " * 17, "\n", "\t", "!!", "...", "<s>", "<0x41>", "日本語", "ß", "12345", "ﷺ", "▁", "▁▁",
        "\x00", "🙂", "🤖🏽", "aaaaaaa", "abababab", "http://x.y/z", "===" * 9, "Ωμ", "न", "internationalization", "　", "﻿", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(X.MODEL))


@pytest.fixture(scope="module")
def model():
    return X.Model(public_tokenizers.path(X.MODEL))


def texts(seed, n):
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfw"
    out = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for _ in range(n // 10)] + ["", " ", "  ", "\n", " " * 1000]


def both(model, library, encoder, part):
    ids, counts = encoder(part)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    want = library.encode(part, add_bos=True, add_eos=True)
    assert got == want
    assert X.decode(model, ids.astype(np.int64), counts) == [library.decode(w) for w in want]


def test_equals_library(model, library):
    encoder = X.Encoder(model)
    for seed in range(3):
        both(model, library, encoder, texts(seed, 1500))  # later rounds meet known words
    both(model, library, encoder, [""])


def test_long_words(model, library):
    rng = random.Random(1)
    long = ["a" * 100_000, "=" * 99_999, "ab" * 50_000, " " * 100_003, "x" + " " * 50_001 + "y", "日本" * 20_000,
            "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))]
    both(model, library, X.Encoder(model), long)


def test_pieces_of_unequal_runs_stay_whole(model, library):
    """Without the cut of long space runs the rounds alone give the same ids."""
    other = X.Model(public_tokenizers.path(X.MODEL))
    other.longest_run = 0
    both(model, library, X.Encoder(other), [" " * k + "a" + " " * (40 - k) for k in range(41)])


def test_decoding_any_ids(model, library):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([1, 2, 0, rng.randint(3, 258), rng.randint(131, 258), rng.randint(259, 31999), 28705]) for _ in range(rng.randint(0, 8))]
        assert X.decode(model, np.array(ids, np.int64), np.array([len(ids)]))[0] == library.decode(ids)


def test_forgetting(model, library, monkeypatch):
    monkeypatch.setattr(X, "KNOWN_IDS", 50)
    encoder = X.Encoder(model)
    for seed in range(4):
        both(model, library, encoder, texts(seed, 40))


def test_query(spark, docs_of, library, monkeypatch):
    rows = list(enumerate(texts(9, 120))) + [(None, None), (None, "no id"), (500, None), (501, ""), (502, "same"), (502, "same")]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, X.digests(docs_of(rows)).collect()), key=repr) == sorted(want, key=repr)
    assert X.digests(docs_of(rows).filter("false")).collect() == []
