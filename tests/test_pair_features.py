"""Features of pairs in batches: the rows of a loop, whatever is null, repeated or of another length."""

import pytest
from pyspark.sql import functions as F

from protspark.functions import vectors as V
from protspark.plans import projections

NAN = float("nan")
VECTORS = [[0.1, -2.5, 3.0], [1e300, 0.0, -0.0], [4.0, None, 1.0], [1.0, 2.0], [], [NAN, 1.0, 2.0], None, [7.0, 8.0, 9.0]]


def plain(x, y):
    if x is None or y is None:
        return None
    n = max(len(x), len(y))
    p, q = (v + [None] * (n - len(v)) for v in (x, y))
    both = lambda f: [None if a is None or b is None else f(a, b) for a, b in zip(p, q)]
    return x + y + both(lambda a, b: abs(a - b)) + both(lambda a, b: a * b)


def summed(f):
    total = 0.0
    for e in f:
        if e is None:
            return None
        total += e
    return total


@pytest.mark.parametrize("kind", ["double", "float"])
@pytest.mark.parametrize("vectors", [VECTORS, [v for v in VECTORS if v and len(v) == 3 and None not in v], [[], []], [None]])
def test_pairs_equal_a_loop(spark, vectors, kind):
    data = [(k, x, m, y) for k, x in enumerate(vectors) for m, y in enumerate(vectors)]
    df = spark.createDataFrame(data, f"i int, x array<double>, j int, y array<double>").coalesce(1)
    cast = df.select("i", "j", F.col("x").cast(f"array<{kind}>").alias("x"), F.col("y").cast(f"array<{kind}>").alias("y"))
    known = {(r.i, r.j): (r.x, r.y) for r in cast.collect()}
    got = cast.select("i", "j", V.pair_features("x", "y").alias("f")).select("i", "j", "f", V.size_and_sum("f").alias("s")).collect()
    chained = cast.select("i", "j", V.size_and_sum(V.pair_features("x", "y")).alias("s")).collect()
    assert len(got) == len(chained) == len(data)
    for r in got:
        want = plain(*known[r.i, r.j])
        assert repr(r.f) == repr(want)
        assert repr((r.s.n, r.s.total) if want is not None else (None, None)) == repr((len(want), summed(want)) if want is not None else (None, None))
    assert sorted(map(repr, chained)) == sorted(repr(r) for r in cast.sparkSession.createDataFrame(got, "i int, j int, f array<double>, s struct<n:int,total:double>").select("i", "j", "s").collect())


def test_sums_of_many_rows_add_from_first_to_last(spark):
    rows = [(k, [((k * 37 + d * 11) % 101) / 7 - 6 for d in range(64)]) for k in range(1300)]
    df = spark.createDataFrame(rows, "k int, x array<double>").coalesce(1)
    got = dict(df.select("k", V.size_and_sum("x").alias("s")).select("k", "s.total").collect())
    assert got == {k: summed(x) for k, x in rows}


def test_repeated_and_missing_ids_give_the_rows_of_the_joins(spark, tmp_path):
    """A pair of ids comes once for each of its points and each of its vectors."""
    near = lambda k: [0.01 * k, 0.0, 0.0] + [float(k)] * 61
    data = [(1, near(1), 0), (1, near(2), 0), (1, near(3), 7), (2, near(4), 0), (2, near(4), 0), (3, None, 0), (3, near(5), 0),
            (None, near(6), 0), (4, near(7), None), (5, [5.0] * 64, 0)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    e = [r for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    want = []
    for a in e:
        for b in e:
            if None in (a.vec_id, b.vec_id, a.label, b.label, a.embedding, b.embedding) or a.label != b.label or not a.vec_id < b.vec_id:
                continue
            if sum((p - q) ** 2 for p, q in zip(a.embedding[:3], b.embedding[:3])) ** 0.5 > 0.1:
                continue
            for c in e:
                for d in e:
                    if (c.vec_id, d.vec_id) == (a.vec_id, b.vec_id):
                        f = plain(c.embedding, d.embedding)
                        want.append((a.vec_id, b.vec_id, f and len(f), None if f is None else round(summed(f), 6) + 0.0))
    got = [tuple(r) for r in projections.pair_features(spark, str(tmp_path)).collect()]
    assert want and sorted(map(repr, got)) == sorted(map(repr, want))
