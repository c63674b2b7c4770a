"""The pipeline's second stage is op9's operator, on rows whose ids may be missing or stand twice."""

import corpus_pipeline as P
from protspark.llm import byte_index as B


def bits(a, b):
    return bin(B.fingerprint(a) ^ B.fingerprint(b)).count("1")


def test_near_duplicates_by_fingerprints(spark, docs_of):
    words = [f"w{k}" for k in range(300)]
    near = " ".join([*words[:299], "other"])
    assert bits(" ".join(words), near) <= B.RADIUS
    # Below 0.8 by their five-word sets, but one fingerprint: op9 links them.
    rows = [(1, " ".join(words)), (2, near), (3, " ".join(words)), (4, "a b c d e f"), (5, "a b c d " * 3), (6, "a b c d " * 40),
            (None, "the first text without an id"), (None, "quite another one of them here"), (4, "an id that stands twice")]
    want = {}
    for i, t in rows:
        root = next((r for r in want if bits(r, t) <= B.RADIUS), t)
        want.setdefault(root, []).append((-1 if i is None else i, t))
    got = P.near_duplicates(spark, docs_of(rows), "").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in got) == sorted(min(x) for x in want.values())


def test_the_stage_agrees_with_the_operator(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    parts = {r.component_id for r in B.near_duplicates(docs).collect()}
    assert {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()} == parts
