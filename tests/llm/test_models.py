"""Toxicity, language and quality models on small tables; held-out accuracy, and the defined corner cases."""

import random
import zlib

import numpy as np
import pytest

from protspark.llm import centroids, deobfuscate, nbsvm

EXTRA = [(9_001, None), (9_002, ""), (9_003, " \n"), (9_004, "12 34 !!"), (None, "an honest little text about rivers"), (9_005, "long text here " * 20_000)]


def make(spark, rows, lang="xx"):
    return spark.createDataFrame([(i, t, g, 1.0, 2, True) for i, t, g in [(*r, lang) if len(r) == 2 else r for r in rows]],
                                 "doc_id long, text string, lang string, score double, key int, held_out boolean").repartition(3)


def words(rng, syllables, n):
    return [("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))) for _ in range(n)]


def remainder(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def toxic_rows():
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        w = words(rng, ["ta", "re", "mi", "sol", "an", "der"], 60)
        if k % 4 == 0:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["grumbat", "zorkel"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    rng = random.Random(5)
    masked = [(5_000 + k, " ".join(words(rng, ["ta", "re", "mi"], 20) + [bad] + words(rng, ["sol", "an"], 20) + [bad, "and", bad]))
              for k, bad in enumerate(["gr0mb4t".replace("0", "u"), "z0rk3l", "z o r k e l", "grummmmbat"])]
    said = spark.createDataFrame([*[(i, y, 0) for i, y in labels], (7, None, 0), (8, 1, 0), (8, 1, 0)], "doc_id long, toxic int, key int")
    docs = make(spark, rows + masked + EXTRA + [rows[4], rows[4]])
    got = {}
    for r in deobfuscate.toxicity(docs, said).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for rs in got.values() for r in rs)
    held = [i for i, _ in labels if remainder(i, 4) == 2]
    assert all(got[i][0].held_out == (remainder(i, 4) == 2) for i, _ in labels)
    assert np.mean([got[i][0].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert all(got[5_000 + k][0].predicted for k in range(4))
    assert not any(got[i][0].predicted for i, _ in EXTRA) and len(got[4]) == 3 and len(set(got[4])) == 1
    kept = deobfuscate.without_toxic(docs, said)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, rs in got.items() if not rs[0].predicted}

    bad = next(t for i, t in rows if got[i][0].predicted)
    same = [(None, bad), (None, "a clean line"), (None, None), (9_000, bad), (9_000, "another clean line")]
    left = deobfuscate.without_toxic(make(spark, rows + same), said)
    own = [(r.doc_id, r.text) for r in left.collect() if r.doc_id is None or r.doc_id == 9_000]
    assert sorted(own, key=str) == sorted(((i, t) for i, t in same if t != bad), key=str)
    assert deobfuscate.without_toxic(make(spark, []), said).count() == 0


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in deobfuscate.toxicity(make(spark, EXTRA), none).collect()} == {0.0}
    assert deobfuscate.toxicity(make(spark, []), none).count() == 0


def test_restore():
    text = "idiot moron worthless stupid clown " * 50 + "then there other another " * 200
    counts = np.bincount(deobfuscate.trigrams(text), minlength=deobfuscate.SIZE**3)
    model = deobfuscate.LanguageModel(counts)
    for seen, meant in [("1d10t", "idiot"), ("m o r o n", "moron"), ("stuuupid", "stupid"), ("cl0wn", "clown"), ("w0rthl3$$", "worthless"), ("then", "then")]:
        assert model.restore(seen) == meant


def test_languages(spark):
    rng = random.Random(4)
    kinds = {"aa": ["ta", "re", "mi"], "bb": ["ö", "lich", "ver"], "cc": ["que", "ción", "os"]}
    rows = [(k, " ".join(words(rng, kinds[g], 30)), g) for k in range(300) for g in [list(kinds)[k % 3]]]
    docs = make(spark, rows + [(i, t, None) for i, t in EXTRA] + [(300, rows[0][1], None), (300, rows[0][1], None)])
    got = {}
    for r in centroids.languages(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(got[i][0].lang_pred == g and 0 < got[i][0].score <= 1 for i, _, g in rows)
    assert all(got[i][0].held_out == (remainder(i, 3) == 1) for i, _, _ in rows)
    assert [got[i][0].lang_pred for i in (9_001, 9_002, 9_003, 9_004)] == ["und"] * 4
    assert got[None][0].lang_pred in kinds and [r.lang_pred for r in got[300]] == ["aa", "aa"] and got[9_005][0].lang_pred in kinds


def test_signs_are_no_letters(spark):
    rows = [(k, f"the house and the river number {k}", "en") for k in range(60)] + [(100, "² ½ ① 12", None), (101, "½a", None), (102, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in centroids.languages(df).collect()}
    assert got[100] == got[102] == "und" and got[101] == "en"


def test_languages_without_any(spark):
    assert {r.lang_pred for r in centroids.languages(make(spark, EXTRA, None)).collect()} == {"und"}
    assert centroids.languages(make(spark, [])).count() == 0


def test_ngram_counts_in_pieces(monkeypatch):
    text = "Ein längerer Text, mit Zeichen. " * 40
    whole = centroids.counts(text)
    monkeypatch.setattr(centroids, "CHUNK", 100)
    assert (centroids.counts(text) == whole).all()


def test_quality(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        w = words(rng, ["ta", "re", "mi", "sol"], rng.randint(30, 90))
        if k % 5 == 0:
            w = [x.upper() + "!!" for x in w] if k % 2 else [y for x in w for y in (x, "|")]
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 5 != 0), 0))
    said = spark.createDataFrame(labels + [(3, None, 0)], "doc_id long, quality int, grams int")
    got = {}
    for r in nbsvm.quality_scores(make(spark, rows + EXTRA + [rows[1]]), said).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for rs in got.values() for r in rs)
    assert all(got[i][0].held_out == (remainder(i, 5) == 0) for i, _ in rows)
    assert np.mean([got[i][0].predicted == (i % 5 != 0) for i, _ in rows if remainder(i, 5) == 0]) > 0.97
    assert len(got[1]) == 2 and got[1][0] == got[1][1] and set(got) == {i for i, _ in rows + EXTRA}


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in nbsvm.quality_scores(make(spark, EXTRA), none).collect()} == {0.5}
    assert nbsvm.quality_scores(make(spark, []), none).count() == 0
