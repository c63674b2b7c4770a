"""Many small graphs in one task: the rounds of ``centrality`` on stacked matrices instead of joins.

A graph of at most ``SMALL_EDGES`` edge rows is one row, so an Arrow batch holds thousands of them. They are laid out as
matrices of equal width, in slices of a bounded number of entries, and every round is one product per slice. Graphs with more
rows, with an end or a graph id that is null, or with a negative weight are left to the joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from protspark.functions.lineage import written

KEY = "graph_id"
SMALL_EDGES = 128
ENTRIES = 1 << 20  # matrix entries of a slice

Solve = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def divided(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges ``(graph_id, i, j, w)`` of small graphs, and those of the others if there are any."""
    odd = F.max(F.col("i").isNull() | F.col("j").isNull() | F.col(KEY).isNull() | (F.col("w") < 0))
    sizes = edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("_m"), odd.alias("_odd"))
    others = written(sizes.where((F.col("_m") > SMALL_EDGES) | F.col("_odd")).select(F.col(KEY).alias("_g")))
    if others.isEmpty():
        return edges, None
    same = F.col(KEY).eqNullSafe(F.col("_g"))
    return edges.join(others, same, "left_anti"), edges.join(others, same, "left_semi")


def solved(edges: DataFrame, name: str, solve: Solve, least: bool = False) -> DataFrame:
    """``(graph_id, idx, name, failed)`` of small graphs.

    ``solve`` gets matrices (graphs, n, n) and the graphs' sizes, rows and columns beyond a size being empty, and gives a value
    per node and a mark per graph. Parallel edges are added up, or with ``least`` the shortest counts, none being infinite.
    """
    types = {c: edges.schema[c].dataType for c in (KEY, "i")}
    packed = edges.groupBy(KEY).agg(F.collect_list(F.struct("i", F.col("j").cast(types["i"]).alias("j"), "w")).alias("_e"))
    rows = packed.select(KEY, *[F.col(f"_e.{c}").alias(c) for c in ("i", "j", "w")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            graph = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy())
            i, j, w = (b.column(k).flatten() for k in (1, 2, 3))
            names, code = np.unique(np.concatenate([i.to_numpy(zero_copy_only=False), j.to_numpy(zero_copy_only=False)]), return_inverse=True)
            ends = np.concatenate([graph, graph]) * len(names) + code
            nodes = np.unique(ends)
            owner = nodes // len(names)
            sizes = np.bincount(owner, minlength=b.num_rows)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            place = np.searchsorted(nodes, ends) - first[owner[np.searchsorted(nodes, ends)]]
            row, col = place[:len(graph)], place[len(graph):]
            values, failed = np.zeros(len(nodes)), np.zeros(b.num_rows, bool)
            weights = w.to_numpy(zero_copy_only=False)
            for part in _slices(sizes):
                n = int(sizes[part].max())
                at = np.full(b.num_rows, -1)
                at[part] = np.arange(len(part))
                mine = np.flatnonzero(at[graph] >= 0)
                g, r, c, v = at[graph[mine]], row[mine], col[mine], weights[mine]
                m = np.full((len(part), n, n), np.inf if least else 0.0)
                for a, z in ((r, c), (c, r)):
                    (np.minimum if least else np.add).at(m, (g, a, z), v)
                found, bad = solve(m, sizes[part])
                failed[part] = bad
                mask = np.arange(n) < sizes[part][:, None]
                values[(first[part][:, None] + np.arange(n))[mask]] = found[mask]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(owner)), pa.array(names[nodes % len(names)], i.type), pa.array(values), pa.array(failed[owner])],
                [KEY, "idx", name, "failed"])

    return rows.mapInArrow(run, f"{KEY} {types[KEY].simpleString()}, idx {types['i'].simpleString()}, {name} double, failed boolean")


def _slices(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the graphs by size, each slice with at most ``ENTRIES`` matrix entries (a graph at least)."""
    order = np.argsort(sizes, kind="stable")
    while len(order):
        area = np.arange(1, len(order) + 1) * sizes[order].astype(np.int64) ** 2
        n = max(1, int(np.searchsorted(area, ENTRIES, "right")))
        yield order[:n]
        order = order[n:]


def pagerank(m: np.ndarray, sizes: np.ndarray, alpha: float, iters: int, tol: float | None, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    n = sizes[:, None].astype(float)
    inside = np.arange(m.shape[1]) < sizes[:, None]
    out = m.sum(axis=2)
    share = np.divide(m, out[:, :, None], out=np.zeros_like(m), where=out[:, :, None] > 0).transpose(0, 2, 1)
    stuck = inside & (out <= 0)
    even = (1 - alpha) / n
    if tol is not None:
        s = stuck.sum(axis=1, keepdims=True)
        even = even * (1 + alpha * s / (n - alpha * s))
    x, before, omega = inside / n, np.zeros_like(out), 1.0
    left = np.zeros(len(m))
    for k in range(1, iters + 1):
        step = np.where(inside, alpha * (share @ x[:, :, None])[:, :, 0] + even, 0.0)
        if tol is None:
            x = step + np.where(inside, alpha * (x * stuck).sum(axis=1, keepdims=True) / n, 0.0)
            continue
        x, before, left = omega * (step - before) + before, x, np.abs(step - x).sum(axis=1)
        if (k % rounds == 0 or k == iters) and (left <= tol * sizes).all():
            break
        omega = 2 / (2 - alpha * alpha) if k == 1 else 1 / (1 - alpha * alpha * omega / 4)
    return x, left > (np.inf if tol is None else tol * sizes)


def powers(m: np.ndarray, sizes: np.ndarray, iters: int) -> tuple[np.ndarray, np.ndarray]:
    x = (np.arange(m.shape[1]) < sizes[:, None]).astype(float)
    for _ in range(iters):
        x = (m @ x[:, :, None])[:, :, 0] + x
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x, np.zeros(len(m), bool)


def krylov(m: np.ndarray, sizes: np.ndarray, tol: float, cycles: int, kept: int, steps: int, best: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The cycles of ``centrality._krylov``; ``best`` finds the next vectors from the inner products."""
    inside = np.arange(m.shape[1]) < sizes[:, None]
    degree = m.sum(axis=2)
    top = degree.max(axis=1)
    top = np.where(top > 0, top, 1.0)
    m = m / top[:, None, None]
    values = np.zeros((len(m), kept))
    values[:, 0] = degree.sum(axis=1) / sizes / top
    q = np.zeros((len(m), m.shape[1], kept))
    q[:, :, 0] = inside / np.sqrt(sizes)[:, None]
    x, todo = np.zeros(inside.shape), np.arange(len(m))
    for _ in range(cycles):
        p = [(m @ q[:, :, :1])[:, :, 0] - values[:, :1] * q[:, :, 0]]
        for k in range(1, steps + 1):
            y = (m @ p[-1][:, :, None])[:, :, 0]
            p.append(y if k == 1 else 2 * y - p[-2])
        every = np.concatenate([q, np.stack(p, axis=2)], axis=2)
        gram = every.transpose(0, 2, 1) @ every
        left = np.sqrt(np.maximum(gram[:, kept, kept], 0.0))
        done = left <= tol
        x[todo[done]] = q[done, :, 0]
        if done.all():
            return x, np.zeros(len(x), bool)
        c, values = best(values[~done], gram[~done], every[~done, :, :-1].sum(axis=1))
        q = every[~done, :, :-1] @ c.reshape(-1, kept, kept + steps).transpose(0, 2, 1)
        m, todo = m[~done], todo[~done]
    failed = np.zeros(len(x), bool)
    failed[todo] = True
    return x, failed


def lengths(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edge lengths without loops and non-positive ones, and all distances, each summed along its path from the source on."""
    at = np.arange(m.shape[1])
    m = np.where(m > 0, m, np.inf)
    m[:, at, at] = np.inf
    d = np.full_like(m, np.inf)
    d[:, at, at] = 0.0
    while True:
        old = d.copy()
        for u in at:
            np.minimum(d, d[:, :, u, None] + m[:, None, u, :], out=d)
        if (old == d).all():
            return m, d


def closeness(m: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, d = lengths(m)
    r = ((d > 0) & (d < np.inf)).sum(axis=2).astype(float)
    s = np.where(d < np.inf, d, 0.0).sum(axis=2)
    some = (s > 0) & (sizes > 1)[:, None]
    return np.where(some, r / np.where(some, s, 1.0) * r / np.maximum(sizes - 1, 1)[:, None], 0.0), np.zeros(len(m), bool)


def betweenness(m: np.ndarray, sizes: np.ndarray, normalized: bool) -> tuple[np.ndarray, np.ndarray]:
    m, d = lengths(m)
    n = m.shape[1]
    total, failed = np.zeros(d.shape[:2]), np.zeros(len(m), bool)

    def settled(start: np.ndarray, links: np.ndarray) -> np.ndarray:
        x = start
        for _ in range(n + 1):
            x, old = start + (links @ x[:, :, None])[:, :, 0], x
            moved = (np.abs(x - old) > 1e-12 * x).any(axis=1)
            if not moved.any():
                return x
        failed[moved] = True  # a walk longer than the graph: lengths that a sum does not feel
        return x

    for s in range(n):
        far = d[:, s]
        tight = ((far[:, :, None] + m == far[:, None, :]) & (m < np.inf) & (far < np.inf)[:, :, None]).astype(float)  # from, to
        paths = settled(np.repeat((np.arange(n) == s)[None].astype(float), len(m), axis=0), tight.transpose(0, 2, 1))
        shares = settled(np.divide(1.0, paths, out=np.zeros_like(paths), where=paths > 0), tight)
        gained = np.where(paths > 0, paths * shares - 1, 0.0)
        gained[:, s] = 0.0
        total += gained
    pairs = (sizes - 1.0) * (sizes - 2.0)
    scale = np.where(sizes > 2, 1 / np.where(pairs > 0, pairs, 1.0), 1.0) if normalized else np.full(len(m), 0.5)
    return total * scale[:, None], failed
