"""Obfuscated words reach the lattice wherever their signs stand."""

import random
import tracemalloc

import numpy as np
import pytest

from protspark.llm import deobfuscate as D
from protspark.llm.common import WORD


@pytest.fixture(scope="module")
def restorer():
    text = "idiot moron worthless stupid clown kill die ass " * 50 + "then there other another " * 200
    return D.Restorer(D.LanguageModel(np.bincount(D.trigrams(text), minlength=D.SIZE**3)))


def forms(restorer, text):
    return {f for w in WORD.findall(text) for f in restorer.word(w)} | set(restorer.apart(text))


@pytest.mark.parametrize("seen, meant", [
    ('"st0pid', "stopid"), ("(1diot", "idiot"), ('"stuuupid', "stupid"), ("[cl0wn],", "clown"), ("you,1diot", "idiot"), ("d13", "die"), ("a$$", "ass"),
    ("idi07", "idiot"), ("1d107", "idiot"), ("st*pid", "stupid"), ("cl*wn!", "clown"), ("*diot", "idiot"), ("w*rthl*ss", "worthless"), ("m**on", "moron"), ("st-up-id", "stupid"), ("i d 1 0 t", "idiot"), ("so k  i  l  l it", "kill"),
    ("k\ni\nl\nl", "kill"), ("(k i l l)", "kill"), ("x-k i l l", "kill"), ("k i l l  m o r o n", "moron"), ("m. o. r. o. n", "moron")])
def test_forms(restorer, seen, meant):
    assert meant in forms(restorer, seen)


def dense(model, token):
    """The same decoding over the whole table of states, with every back pointer kept."""
    now = np.full((D.SIZE, D.SIZE), np.inf)
    now[0, 0] = 0.0
    back, before = [], ""
    for c in token:
        new, of = np.full_like(now, np.inf), np.zeros(now.shape, int)
        for x, channel in [(x, 0.0) for x in D.ALPHABET] if c == D.MASK else model._choices(c, before):
            if x:
                k = D.CODES.get(x, 0)
                total = (now + model.cost[:, :, k]).min(axis=0) + channel
                better = total < new[:, k]
                new[better, k], of[better, k] = total[better], (now + model.cost[:, :, k]).argmin(axis=0)[better]
            else:
                better = now + channel < new
                new[better], of[better] = now[better] + channel, -1
        before, now = c.lower(), new
        back.append((c.lower(), of))
    a, b = np.unravel_index((now + model.cost[:, :, 0]).argmin(), now.shape)
    word = ""
    for c, of in reversed(back):
        if of[a, b] >= 0:
            word, a, b = (D.ALPHABET[b - 1] if b else c) + word, of[a, b], a
    return word


def test_reachable_states_equal_the_whole_table(restorer, monkeypatch):
    monkeypatch.setattr(D, "STRIDE", 4)
    rng = random.Random(1)
    for _ in range(150):
        token = "".join(rng.choice("idiotmrn1403$*.-_xßé#五tt") for _ in range(rng.randint(1, 14)))
        assert restorer.model._masked(token) == dense(restorer.model, token)
    for token in ("st0pid", "1d107", "stuuupid", "i d 1 0 t"):
        assert restorer.model._masked(token) == restorer.model.restore(token)


def test_very_long_tokens(restorer):
    rng = random.Random(2)
    masked = "st*pid*" + "".join(rng.choice("idiotmoron1403") for _ in range(20_000))
    tracemalloc.start()
    out = restorer.word(masked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out and all(len(w) <= len(masked) for w in out) and peak < 60e6


def test_quick_way_out_loses_nothing(restorer, monkeypatch):
    words = ["then", "there,", '"other"', "(st0pid)", "stuuupid.", "a.b.c", "x-y", "étude;", "k.i.l.l", "ok!", "AAA", "%then%", "i'm", "²a", "a.", ".a.", "<b>", "don't"]
    quick = [sorted(restorer.word(w)) for w in words]
    monkeypatch.setattr(D, "OUTSIDE", "")
    monkeypatch.setattr(D, "TRIPLE", D.re.compile(""))
    assert [sorted(restorer.word(w)) for w in words] == quick


def test_plain_words_and_numbers_stay_out(restorer):
    assert forms(restorer, "then there, other (another) 1 2 3 4 10-11-12 *then* then*** then.") == set()


def test_words_are_taken_apart_once_and_only_where_needed(monkeypatch):
    counts = np.bincount(D.trigrams("the vile scum and the plain mill of the town " * 9), minlength=D.SIZE**3)
    model = D.LanguageModel(counts)
    words = ["plain", "(Mill),", "sc*m", "v1le", "viiile", "a", "ab", "scum!", "v.i.l.e", "İstanbul", "***", "the-town", "42", "ß", "'thé'"]
    restorer = D.Restorer(model)
    for w in words:
        forms = [w, *D.Restorer(model)._forms(w)] if not D.plain(w) else [w]
        assert sorted(restorer.beginnings(w)) == sorted({g for x in forms for g in D.beginnings(x)}), w
    for text in ("the v i l e town", "a b", "x a b", "v. i- l* e", "a  1 l e.", "ab c d", "1 2 3", "v\ni\nl\ne", "a b cd", ""):
        assert bool(restorer.apart(text)) == any(D.LETTER.search(m.group()) for m in D.RUN.finditer(text)), text
    weights = D._Weights(model, {"scum": 2.0, "scum$": 3.0, "vile": 1.5})
    assert [weights[w] for w in ("scum", "Scummy", "v1le", "sc*m", "plain", "ab")] == [3.0, 2.0, 1.5, 3.0, 0.0, 0.0]
    monkeypatch.setattr(D, "_cut_off", None)  # never needed for a plain word with an unknown head
    assert weights["ordinary"] == 0.0 and weights["(Ordinary)."] == 0.0
