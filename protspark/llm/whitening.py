"""Whitening of embeddings by shifted CholeskyQR.

Vectors become integers ``floor(256 * entry)``. The distinct integer vectors are the fit list. Its centred rows are never
gathered: each pass reads them where they lie, applies the triangular factors found so far by forward substitution, and adds
up one Gram matrix over all tasks. The driver takes its Cholesky factor (the first one of a shifted matrix, so that it always
exists) and goes on until the rows are orthonormal. The product of the factors is R of the centred table, and its singular
vectors are the components. The driver holds matrices of ``d * d`` numbers, tasks one batch of rows.

Rows whose vector is null, empty or holds null or non-finite entries are left out. If lengths differ, the commonest length among
distinct vectors counts (the longer of equally common ones), others are left out. Integers beyond a long are held at its ends.
A component without variance (fewer distinct vectors than dimensions, constant entries) has a null ``whitened``; it counts neither
for ``identity_error``, which is null if no component has variance. A ``deviation`` beyond a long is null. Equal rows give equal
results, a null id is kept, an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from protspark.llm.common import stored

COMPONENTS = 4
MAX_PASSES = 8
ROWS = 4096
LONG = 2**63
UNIT = np.finfo(np.float64).eps


def _integers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the usable vectors, all entries as integers, and the usable vectors' lengths."""
    valid = np.asarray(vectors.is_valid())
    sizes = np.diff(np.asarray(vectors.offsets)).astype(np.int64)
    sizes[~valid] = 0
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry is NaN
    row = np.repeat(np.arange(len(vectors)), sizes)
    good = valid & (sizes > 0)
    good[row[~np.isfinite(values)]] = False
    with np.errstate(over="ignore"):
        x = np.floor(256.0 * values[good[row]])
    low, high = x <= -float(LONG), x >= float(LONG)
    whole = np.where(low | high, 0.0, x).astype(np.int64)
    whole[low], whole[high] = -LONG, LONG - 1
    return np.flatnonzero(good), whole, sizes[good]


def _packed(rows: DataFrame) -> DataFrame:
    """Every usable vector as little-endian 64-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x, sizes = _integers(b.column(0))
            raw, ends = x.astype("<i8").tobytes(), np.cumsum(8 * sizes).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([raw[s:e] for s, e in zip([0, *ends], ends)], pa.binary())], ["x"])

    return rows.mapInArrow(run, "x binary")


def _totals(fit: DataFrame, d: int, kind: str, of: Callable[[np.ndarray], np.ndarray]) -> dict[int, object]:
    """Sums over the fit list of what ``of`` returns for a block of integer rows; one partial row per task and cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8").reshape(-1, d)
            for k in range(0, len(x), ROWS):
                part = of(x[k:k + ROWS])
                total = part if total is None else total + part
        if total is not None:
            values = pa.array(total.ravel().tolist(), pa.float64()) if kind == "double" else pa.array([str(v) for v in total.ravel()]).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), values], ["cell", "value"])

    parts = fit.mapInArrow(run, f"cell long, value {'double' if kind == 'double' else 'decimal(38,0)'}")
    return {r[0]: r[1] for r in parts.groupBy("cell").agg(F.sum("value")).collect()}  # d * d cells at most


def _solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows @ inverse(r) for an upper triangular r, column after column."""
    q = rows.copy()
    for j in range(r.shape[0]):
        if j:
            q[:, j] -= q[:, :j] @ r[:j, j]
        q[:, j] /= r[j, j]
    return q


class Fit:
    """n, sums S (exact integers), components as columns, their eigenvalues and the trace of the covariance."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, values: np.ndarray, trace: float) -> None:
        self.n, self.sums, self.components, self.values, self.trace = n, sums, components, values, trace
        self.mean = np.array([s / n for s in sums])
        self.varies = values > 64 * len(sums) * UNIT * max(trace, 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the roots of the eigenvalues; 0 where a component has no variance."""
        scale = np.where(self.varies, np.sqrt(np.where(self.varies, self.values, 1.0)), np.inf)
        return ((x - self.mean) @ self.components) / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over the dimensions, exact."""
        top = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums)) if len(x) else 0
        if top * top * len(self.sums) < LONG:
            c = self.n * x - np.array(self.sums, np.int64)
            return (c * c).sum(axis=1).tolist()
        s = self.sums
        exact = (sum((self.n * a - b) ** 2 for a, b in zip(row, s)) for row in x.tolist())
        return [v if v < LONG else None for v in exact]


def fit(vectors: DataFrame, col: str = "embedding", components: int = COMPONENTS) -> tuple[Fit, DataFrame] | None:
    """The model of a table's distinct vectors and the stored fit list; None if no vector is usable."""
    distinct = stored(_packed(vectors.select(F.col(col))).distinct(), "fit-list")
    lengths = distinct.groupBy(F.length("x").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).head(1)
    if not lengths:
        return None
    d, n = lengths[0][0] // 8, lengths[0][1]
    rows = distinct.filter(F.length("x") == 8 * d)

    def column_sums(x: np.ndarray) -> np.ndarray:
        if max(abs(int(x.min())), abs(int(x.max()))) < 2**48:
            return x.sum(axis=0).astype(object)
        return x.astype(object).sum(axis=0)

    found = _totals(rows, d, "decimal", column_sums)
    sums = [int(found[j]) for j in range(d)]
    mean = np.array([s / n for s in sums])
    upper = np.triu_indices(d)
    factors: list[np.ndarray] = []

    def gram() -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            q = x - mean
            for r in factors:
                q = _solved(q, r)
            return (q.T @ q)[upper]

        cells = _totals(rows, d, "double", of)
        g = np.zeros((d, d))
        g[upper] = [cells[k] for k in range(len(upper[0]))]
        return g + np.triu(g, 1).T

    g = gram()
    trace = float(np.trace(g)) / n
    r = np.eye(d)
    if trace > 0:
        for _ in range(MAX_PASSES):
            size = float(np.trace(g))
            least = float(np.linalg.eigvalsh(g)[0])
            shift = 0.0
            if not factors or least < 64 * d * UNIT * size:
                shift = min(11 * (n * d + d * (d + 1)) * UNIT, 1e-3) * size
            factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
            r = factors[-1] @ r
            g = gram()
            values = np.linalg.eigvalsh(g)
            if np.all((abs(values - 1) < 1e-12 * d) | (values < 64 * d * UNIT)):
                break
        # g is the identity but for directions without variance; its root takes those out again.
        values, turn = np.linalg.eigh(g)
        r = np.sqrt(np.maximum(values, 0))[:, None] * (turn.T @ r)
    else:
        r = np.zeros((d, d))
    _, singular, v = np.linalg.svd(r)
    k = min(components, d)
    return Fit(n, sums, v[:k].T.copy(), singular[:k] ** 2 / n, trace), rows


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every usable row."""
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, col, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], out)
    f, rows = model
    d, k = f.components.shape

    def moments(x: np.ndarray) -> np.ndarray:
        w = f.whitened(x)
        return np.vstack([w.sum(axis=0), w.T @ w])

    error = None
    if f.varies.any():
        cells = _totals(rows, d, "double", moments)
        m = np.array([cells[i] for i in range(k * (k + 1))]).reshape(k + 1, k) / f.n
        off = (m[1:] - np.outer(m[0], m[0]) - np.eye(k))[np.ix_(f.varies, f.varies)]
        error = float(abs(off).max())
    explained = (f.values / f.trace).tolist() if f.trace > 0 else [None] * k
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                good, x, sizes = _integers(b.column(1))
                x = x[np.repeat(sizes == d, sizes)].reshape(-1, d)
                ids = b.column(0).take(pa.array(good[sizes == d]))
                if not len(x):
                    continue
                again = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    ids.take(again), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(x) * k, f.n)),
                    pa.array(f.deviation(x), pa.int64()).take(again), pa.array(f.whitened(x).ravel(), mask=np.tile(~f.varies, len(x))),
                    pa.array(explained * len(x), pa.float64()), pa.array([error] * (len(x) * k), pa.float64())], schema=schema)

    return vectors.select(F.col(id_col).cast("long"), F.col(col)).mapInArrow(run, out)
