import random
from collections import Counter

from protspark.llm import decontaminate as D


def bag(words, k):
    return Counter(" ".join(words[p:p + k]) for p in range(len(words) - k + 1))


def brute(docs, items, t=0.8):
    out = {}
    for i, text in docs:
        words = (text or "").lower().split()
        for j, item in items:
            iw = (item or "").lower().split()
            n, k = len(iw), min(5, len(iw))
            if not n:
                continue
            ib = bag(iw, k)
            for s in range(len(words) - n + 1):
                wb = bag(words[s:s + n], k)
                shared = sum((wb & ib).values())
                sim = shared / (2 * (n - k + 1) - shared)
                if sim >= t and sim > out.get((i, j), (0,))[0]:
                    out[i, j] = (sim, s)
    return sorted((i, j, *v) for (i, j), v in out.items())


def data():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 5)))
    text = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(text(rng.randint(25, 60)))) for k in range(12)]
    items += [(20, items[0][1] + " tail words"), (21, None), (22, ""), (23, "qq rr ss"), (None, " ".join(text(30))), (24, "re pe at " * 12), (24, "re pe at " * 12)]
    docs = []
    for k in range(60):
        body = text(rng.randint(20, 120))
        if k % 2:
            passage = (items[rng.randrange(len(items))][1] or "").split()
            for _ in range(k % 3):
                if passage:
                    passage[rng.randrange(len(passage))] = word()
            if k % 5 == 0:
                passage = [p.upper() for p in passage]
            if k % 7 == 0 and passage:
                del passage[rng.randrange(len(passage))]
            at = rng.randrange(len(body))
            body[at:at] = passage
        docs.append((k, (" \n" if k % 4 else " ").join(body)))
    docs += [(100, None), (101, ""), (102, " \n\t"), (103, "short"), (1, docs[1][1]), (1, docs[1][1]), (None, "x " + items[3][1]), (104, "re pe at " * 500),
             (105, " ".join(text(30_000)) + " " + items[5][1] + " end")]
    return docs, items


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "item_id long, text string, size int, h string")


def test_equals_brute_force(spark, docs_of):
    docs, items = data()
    no = lambda x: -1 if x is None else x
    got = sorted((no(r.doc_id), no(r.item_id), r.similarity, r.start) for r in D.leaks(docs_of(docs), items_of(spark, items)).collect())
    assert got == brute([(no(i), t) for i, t in docs], [(no(j), t) for j, t in items])
    kept = D.without_leaks(docs_of(docs), items_of(spark, items))
    assert kept.columns == docs_of([]).columns
    hit = {g[0] for g in got}
    assert sorted(no(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(no(i) for i, _ in docs if no(i) not in hit)


def test_shuffled_sides(spark, docs_of, monkeypatch):
    docs, items = data()
    want = sorted(map(str, D.leaks(docs_of(docs), items_of(spark, items)).collect()))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert sorted(map(str, D.leaks(docs_of(docs), items_of(spark, items)).collect())) == want


def test_empty(spark, docs_of):
    docs, items = data()
    assert D.leaks(docs_of([]), items_of(spark, items)).count() == 0
    assert D.leaks(docs_of(docs), items_of(spark, [])).count() == 0
    assert D.without_leaks(docs_of(docs[:5]), items_of(spark, [])).count() == 5


def test_rows_without_or_with_the_same_id_are_judged_by_their_text(spark, docs_of):
    docs, items = data()
    leak = items[3][1]
    rows = [(None, "x " + leak), (None, "nothing of that kind here"), (None, None), (7, leak + " y"), (7, "clean words only"), (8, "")]
    kept = D.without_leaks(docs_of(rows), items_of(spark, items))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (r for r in rows if leak not in (r[1] or ""))))
    assert D.without_leaks(docs_of([]), items_of(spark, items)).count() == 0
