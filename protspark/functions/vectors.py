"""Array-column functions for feature vectors."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from protspark.functions.columns import col


def as_double(v: str | Column) -> Column:
    return col(v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def align_dim(v: str | Column, want: int) -> Column:
    """Zero-pad or cut to ``want`` entries."""
    vec = as_double(v)
    padded = F.concat(vec, F.array_repeat(F.lit(0.0), F.greatest(F.lit(want) - F.size(vec), F.lit(0))))
    return F.slice(padded, 1, want)


DOUBLES = pa.list_(pa.float64())


def _matrix(v: pa.Array) -> np.ndarray | None:
    """A batch of vectors of one length without nulls as a matrix; None for any other batch."""
    entries = v.flatten()
    if v.null_count or entries.null_count or not len(v):
        return None
    width = len(entries) // len(v)
    if (v.value_lengths().to_numpy() != width).any():
        return None
    return entries.to_numpy().astype(np.float64, copy=False).reshape(len(v), width)


def _pair_row(x: list | None, y: list | None) -> list | None:
    """The features of one pair: an entry that is null, or has no partner, has null features."""
    if x is None or y is None:
        return None
    met = list(itertools.zip_longest(x, y))
    both = lambda f: [None if p is None or q is None else f(p, q) for p, q in met]
    return [*x, *y, *both(lambda p, q: abs(p - q)), *both(lambda p, q: p * q)]


def pair_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    """``[a, b, |a-b|, a*b]`` of a batch of pairs; row by row if lengths differ or something is null."""
    x, y = _matrix(a), _matrix(b)
    if x is None or y is None or x.shape != y.shape:
        return pa.array([_pair_row(p, q) for p, q in zip(a.cast(DOUBLES).to_pylist(), b.cast(DOUBLES).to_pylist())], DOUBLES)
    rows, width = x.shape
    f = np.empty((rows, 4, width))
    f[:, 0], f[:, 1] = x, y
    np.abs(np.subtract(x, y, out=f[:, 2]), out=f[:, 2])
    np.multiply(x, y, out=f[:, 3])
    return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * np.int32(4 * width), f.ravel())


def folded_batch(v: pa.Array, block: int = 512) -> pa.Array:
    """Size and sum of each vector of a batch, added from first to last as a loop would."""
    x = _matrix(v)
    if x is None or not x.shape[1]:
        rows = v.to_pylist()
        sums = [None if r is None or None in r else float(np.cumsum([0.0, *r])[-1]) for r in rows]
        sizes = [None if r is None else len(r) for r in rows]
    else:
        sums = np.concatenate([np.cumsum(x[k:k + block], axis=1)[:, -1] for k in range(0, len(x), block)])
        sizes = np.full(len(x), x.shape[1])
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(sums, pa.float64())], ["n", "total"])


def pair_features(a: str | Column, b: str | Column) -> Column:
    """``[a, b, |a-b|, a*b]``, computed for a batch at once: Spark interprets a lambda for every entry."""
    @F.arrow_udf("array<double>")
    def features(x: pa.Array, y: pa.Array) -> pa.Array:
        return pair_batch(x, y)

    return features(col(a), col(b))


def size_and_sum(v: str | Column) -> Column:
    """``(n, total)`` of a vector: both null for a null vector, ``total`` if an entry is null.

    Right after ``pair_features`` the vectors do not return to Spark in between.
    """
    @F.arrow_udf("n int, total double")
    def folded(x: pa.Array) -> pa.Array:
        return folded_batch(x)

    return folded(col(v))


def fuse_vectors(*vectors: str | Column) -> Column:
    """Concatenation; a missing part is skipped."""
    empty = F.array().cast("array<double>")
    return F.concat(*[F.coalesce(as_double(v), empty) for v in vectors])


def logit_blend(a: str | Column, b: str | Column, alpha: float) -> Column:
    """``(1-alpha)*a + alpha*b``; ``a`` alone where ``b`` is missing."""
    return F.when(col(b).isNull(), col(a)).otherwise((1.0 - alpha) * col(a) + alpha * col(b))


def project(v: str | Column, weights: list[list[float]]) -> Column:
    """Matrix-vector product with a small given matrix (one row per output entry)."""
    rows = [F.array(*[F.lit(float(w)) for w in row]) for row in weights]
    return F.array(*[dot(v, row) for row in rows])


def nonzero_count(v: str | Column) -> Column:
    return F.size(F.filter(as_double(v), lambda x: x != 0))


def mean_pool(df: DataFrame, by: list[str], vec: str, out: str = "vec") -> DataFrame:
    """Mean vector per group, combined entry by entry before the shuffle."""
    entries = df.select(*by, F.posexplode(as_double(vec)).alias("_k", "_x"))
    means = entries.groupBy(*by, "_k").agg(F.avg("_x").alias("_m"))
    packed = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_k", "_m"))).alias("_v"))
    return packed.select(*by, F.transform("_v", lambda e: e["_m"]).alias(out))


def explode_vector(df: DataFrame, keep: list[str], vec: str) -> DataFrame:
    """Long form ``(keep..., dim, value)``."""
    return df.select(*keep, F.posexplode(as_double(vec)).alias("dim", "value"))
