import os

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    now, sizes = docs, []
    for name, stage in P.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
        assert now.columns == docs.columns
        got = [r.doc_id for r in now.select("doc_id").collect()]
        assert set(got) <= ids
        sizes.append(len(got))
        ids = set(got)
        if name != "mixing":
            assert len(got) == len(ids)
    assert sizes[0] <= docs.count() and sizes[1] < sizes[0] and sizes[2] < sizes[1]
    out = P.token_output(spark, now, SF).collect()
    assert len(out) == sizes[3]
    out.sort(key=lambda r: r.start)
    assert out[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:]))


def test_run(spark):
    assert P.run(spark, SF).count() > 0
