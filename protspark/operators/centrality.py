"""Node centralities of many graphs at once, by joins on ``(graph_id, node)``; see ``small_graphs`` for small ones.

No large graph is handed to one task: small ones, whose number of edge rows is checked, are solved there many at a time without a
shuffle per round, unless nodes are given. In the joins a node's state is one row, and a round joins the edges with the state of their far end and
adds up per node. The edges hold one row from each node to itself, by which it keeps its own values, so that a round names
the state once and several rounds make one job, with one shuffle each, before the next checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from protspark.functions.lineage import written
from protspark.functions.ordered import ranked
from protspark.operators import small_graphs as S
from protspark.operators.residue_graph import KEY, adjacency, finite, graph_nodes

BLOCK = 16  # sources whose distances are kept at a time, in columns of one row per node
ROUNDS = 4  # rounds between two checkpoints
KEPT, STEPS = 6, 3  # eigenvector search: vectors kept from cycle to cycle, and new ones in a cycle
DEPENDENT = 1e-6  # a new direction whose squared length beside the kept vectors is below this depends on the others
INF = "double('Infinity')"


def _nodes(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    return graph_nodes(edges) if nodes is None else nodes.select(KEY, "idx").distinct()


def _stored(edges: DataFrame, weight: str | None) -> DataFrame:
    """The needed columns, written once: the rounds below read the edges many times."""
    return written(edges.select(KEY, "i", "j", *([weight] if weight else [])))


def _by_size(edges: DataFrame, weight: str | None, name: str, solve: S.Solve, large: Callable[[DataFrame, str | None], DataFrame],
             least: bool = False, error: Exception | None = None) -> DataFrame:
    """Small graphs by ``solve``, the others, if any, by ``large``; ``error`` if a small graph failed."""
    kind = graph_nodes(edges).schema["idx"].dataType
    w = finite(weight, 0.0).cast("double") if weight else F.lit(1.0)
    stored = written(edges.select(KEY, F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), w.alias("w")))
    small, rest = S.divided(stored)
    out = S.solved(small, name, solve, least)
    if error:
        out = written(out)
        if not out.where("failed").isEmpty():
            raise error
    out = out.drop("failed")
    return out if rest is None else out.unionByName(large(rest, weight and "w"))


def _sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))


def degree_centrality(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Degree over ``n - 1``."""
    every = _nodes(edges, nodes)
    simple = edges.select(KEY, "i", "j").distinct()
    degree = adjacency(simple, None).groupBy(KEY, "idx").agg(F.count(F.lit(1)).alias("_d"))
    return (every.join(degree, [KEY, "idx"], "left").join(_sizes(every), KEY)
            .select(KEY, "idx", F.when(F.col("_n") > 1, F.coalesce("_d", F.lit(0)) / (F.col("_n") - 1)).otherwise(1.0).alias("degree")))


def _with_self(adj: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges and one row from each node to itself (``own``), written once."""
    own = ids.select(KEY, "idx", F.col("idx").alias("nbr"), F.lit(True).alias("own"))
    return written(adj.withColumn("own", F.lit(False)).unionByName(own, allowMissingColumns=True))


def _round(adj: DataFrame, state: DataFrame, kept: list[str], sums: dict[str, str]) -> DataFrame:
    """One round: per node sums over its edges, its own row among them, and its own ``kept`` columns.

    The sums' terms are SQL text over the edge's columns and the far end's state; ``own`` marks the node's own row. Wide rows
    are written as text because a Python call per term would take longer than the round.
    """
    return (adj.join(state.withColumnRenamed("idx", "nbr"), [KEY, "nbr"]).groupBy(KEY, "idx")
            .agg(*[F.expr(f"sum({e}) AS {n}") for n, e in sums.items()], *[F.expr(f"max(CASE WHEN own THEN {c} END) AS {c}") for c in kept]))


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, alpha: float = 0.85, iters: int = 500,
             tol: float | None = 1e-6, weight: str | None = "w", rounds: int = 8) -> DataFrame:
    """PageRank of undirected graphs; dangling mass goes to all nodes of the graph.

    Stops when the residual summed over a graph is below ``tol * n`` in every graph, tested every ``rounds`` rounds. The step
    of an undirected graph has real eigenvalues between ``-alpha`` and ``alpha``, so each round is extrapolated by Chebyshev's
    rule from the two before: 1e-6 takes 24 rounds instead of 85. ``tol=None`` runs exactly ``iters`` plain rounds. With
    a tolerance that ``iters`` rounds do not reach an error is raised.
    """
    late = RuntimeError(f"PageRank did not converge to {tol} in {iters} rounds")
    if nodes is None:
        return _by_size(edges, weight, "pagerank", partial(S.pagerank, alpha=alpha, iters=iters, tol=tol, rounds=rounds),
                        lambda rest, w: pagerank(rest, graph_nodes(rest), alpha, iters, tol, w, rounds), error=None if tol is None else late)
    edges = _stored(edges, weight)
    ids = _nodes(edges, nodes)
    links = adjacency(edges, weight)
    out = links.groupBy(KEY, "idx").agg(F.sum("w").alias("_out"))
    steps = links.join(out.where(F.col("_out") > 0), [KEY, "idx"]).select(
        KEY, F.col("idx").alias("nbr"), F.col("nbr").alias("idx"), (F.col("w") / F.col("_out")).alias("share"))
    known = written(ids.join(out, [KEY, "idx"], "left").select(KEY, "idx", (F.coalesce("_out", F.lit(0.0)) <= 0).alias("_stuck")))
    sizes = known.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_stuck").alias("_s"))
    adj = _with_self(steps, known)
    # A dangling node receives the even share only, so the mass all of them hold is known from the start when it has settled.
    even = (1 - alpha) / F.col("_n")
    if tol is not None:
        even = even * (1 + alpha * F.col("_s") / (F.col("_n") - alpha * F.col("_s")))
    state = known.join(sizes, KEY).select(KEY, "idx", "_n", "_stuck", even.alias("even"), (1 / F.col("_n")).alias("x"), F.lit(0.0).alias("before"))
    if tol is None:
        state = state.withColumn("lost", F.col("x") * 0)
        has_stuck = not known.where("_stuck").isEmpty()
    omega = 1.0
    for k in range(1, iters + 1):
        if tol is None and has_stuck:
            lost = state.groupBy(KEY).agg(F.sum(F.when(F.col("_stuck"), F.col("x")).otherwise(0.0)).alias("_l"))
            state = state.join(lost, KEY).withColumn("lost", F.col("_l") / F.col("_n")).drop("_l")
        moved = _round(adj, state, [c for c in state.columns if c not in (KEY, "idx")], {"flow": "CASE WHEN own THEN 0D ELSE share * x END"})
        step = alpha * F.col("flow") + F.col("even") + (alpha * F.col("lost") if tol is None else F.lit(0.0))
        new = F.lit(omega) * (step - F.col("before")) + F.col("before")
        kept = [c for c in state.columns if c not in (KEY, "idx", "x", "before")]
        test = tol is not None and (k % rounds == 0 or k == iters)
        state = moved.select(KEY, "idx", *kept, new.alias("x"), F.col("x").alias("before"), *([F.abs(step - F.col("x")).alias("_left")] if test else []))
        if tol is not None:
            omega = 2 / (2 - alpha * alpha) if k == 1 else 1 / (1 - alpha * alpha * omega / 4)
        if test or (tol is None and (has_stuck or k % ROUNDS == 0)):
            state = written(state)
        if test:
            if state.groupBy(KEY).agg((F.sum("_left") <= tol * F.max("_n")).alias("ok")).where(~F.col("ok")).isEmpty():
                break
            state = state.drop("_left")
    else:
        if tol is not None:
            raise late
    return state.select(KEY, "idx", F.col("x").alias("pagerank"))


def eigenvector_centrality(edges: DataFrame, nodes: DataFrame | None = None, iters: int = 2_000, tol: float | None = 1e-8,
                           weight: str | None = "w") -> DataFrame:
    """Leading eigenvector with unit length per graph; isolated nodes are 0.

    With a tolerance: thick-restarted Lanczos. The residual of the best vector is multiplied by the edges ``STEPS`` times
    (Chebyshev recurrence); together with the ``KEPT`` best vectors so far it spans a small space per graph, in which the next
    best vectors are found from inner products, a few dozen numbers per graph. This goes on until the residual, relative to
    the largest weighted degree, is at most ``tol``; graphs that are done leave. More than ``iters`` rounds are an error.

    ``tol=None`` runs exactly ``iters`` rounds of power iteration on ``A + I``.
    """
    if nodes is None:
        large = lambda rest, w: eigenvector_centrality(rest, graph_nodes(rest), iters, tol, w)
        if tol is None:
            return _by_size(edges, weight, "eigen", partial(S.powers, iters=iters), large)
        solve = partial(S.krylov, tol=tol, cycles=_cycles(iters), kept=KEPT, steps=STEPS, best=_best_vectors)
        return _by_size(edges, weight, "eigen", solve, large, error=_unsolved(tol, iters))
    edges = _stored(edges, weight)
    ids = _nodes(edges, nodes)
    links = adjacency(edges, weight)
    x = _power_rounds(links, iters) if tol is None else _krylov(links, tol, iters)
    return ids.join(x, [KEY, "idx"], "left").select(KEY, "idx", F.coalesce("x", F.lit(0.0)).alias("eigen"))


def _power_rounds(links: DataFrame, iters: int) -> DataFrame:
    linked = links.select(KEY, "idx").distinct()
    adj = _with_self(links, linked)
    state = linked.withColumn("x", F.lit(1.0))
    for k in range(1, iters + 1):
        state = _round(adj, state, [], {"x": "CASE WHEN own THEN x ELSE w * x END"})
        if k % ROUNDS == 0 or k == iters:
            state = written(state)
            length = state.groupBy(KEY).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_l"))
            state = state.join(length, KEY).select(KEY, "idx", (F.col("x") / F.col("_l")).alias("x"))
    return state


def _cycles(iters: int) -> int:
    return -(-iters // (STEPS + 1))


def _unsolved(tol: float, iters: int) -> RuntimeError:
    return RuntimeError(f"eigenvector centrality did not converge to {tol} in {iters} rounds")


def _krylov(links: DataFrame, tol: float, iters: int) -> DataFrame:
    degree = links.groupBy(KEY, "idx").agg(F.sum("w").alias("_d"))
    scale = written(degree.groupBy(KEY).agg(F.max("_d").alias("_top"), F.avg("_d").alias("_mean"), F.count(F.lit(1)).alias("_n"))
                .selectExpr(KEY, "_n", "CASE WHEN _top > 0 THEN _top ELSE 1D END AS _top", "_mean"))
    adj = _with_self(links.join(scale, KEY).select(KEY, "idx", "nbr", (F.col("w") / F.col("_top")).alias("w")), degree)
    known = scale.selectExpr(KEY, f"transform(sequence(1, {KEPT}), k -> CASE WHEN k = 1 THEN _mean / _top ELSE 0D END) AS values")
    q, p = [f"q{k}" for k in range(KEPT)], [f"p{k}" for k in range(1, STEPS + 2)]
    state = degree.join(scale, KEY).selectExpr(KEY, "idx", "1 / sqrt(_n) AS q0", *[f"0D AS {c}" for c in q[1:]], "_mean / _top AS value")
    done = []
    for _ in range(_cycles(iters)):
        # p1 is the residual of q0, the others are Chebyshev polynomials of the edges on it.
        have = [*q, "value"]
        for k, c in enumerate(p):
            moved = _round(adj, state, have, {"y": f"CASE WHEN own THEN 0D ELSE w * {p[k - 1] if k else 'q0'} END"})
            new = "y - value * q0" if k == 0 else "y" if k == 1 else f"2 * y - {p[k - 2]}"
            state = moved.selectExpr(KEY, "idx", *have, f"{new} AS {c}")
            have = [*have, c]
        state = written(state)
        every = [*q, *p]
        products = [f"sum({a} * {b}) AS g{i}_{j}" for i, a in enumerate(every) for j, b in enumerate(every) if j >= i]
        gram = state.groupBy(KEY).agg(*map(F.expr, products), *[F.expr(f"sum({a}) AS s{i}") for i, a in enumerate(every[:-1])])
        best = written(_best_in_basis(known.join(gram, KEY)))
        turned = [" + ".join(f"c[{k * (KEPT + STEPS) + j}] * {v}" for j, v in enumerate(every[:-1])) + f" AS {c}" for k, c in enumerate(q)]
        both = state.drop("value").join(best, KEY)
        done.append(both.where(F.col("left") <= tol).selectExpr(KEY, "idx", "q0 AS x"))
        if best.where(F.col("left") > tol).isEmpty():
            return reduce(DataFrame.unionByName, done)
        state = both.where(F.col("left") > tol).selectExpr(KEY, "idx", *turned, "values[0] AS value")
        known = best.where(F.col("left") > tol).select(KEY, "values")
    raise _unsolved(tol, iters)


def _best_vectors(values: np.ndarray, g: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and eigenvalues of the leading vectors of many graphs, from inner products and the vectors' own sums.

    Near the end the new vectors are hardly longer than rounding, so they are not quite orthogonal to the kept ones. They are made so
    before those among them that depend on each other are left out: otherwise a part of the best vector is left out as well, and
    its residual stays above a small tolerance.
    """
    m = KEPT + STEPS
    times = np.zeros((len(g), m + 1, m))  # the edges applied to a new vector, in terms of all vectors
    for j in range(KEPT, m):
        times[:, j + 1, j] = 1.0 if j == KEPT else 0.5
        if j > KEPT:
            times[:, j - 1, j] = 0.5
    h = (g @ times)[:, :m]
    h[:, KEPT:, :KEPT] = h[:, :KEPT, KEPT:].transpose(0, 2, 1)
    at = np.arange(m)
    h[:, at[:KEPT], at[:KEPT]] = values  # the kept vectors are the leading ones of the last span
    h[:, :KEPT, 0] = h[:, 0, :KEPT] = g[:, :KEPT, KEPT] + values[:, :1] * g[:, :KEPT, 0]  # of the first one the residual knows better
    h = (h + h.transpose(0, 2, 1)) / 2
    diagonal = np.einsum("nii->ni", g)[:, :m]
    size = np.where(diagonal > 0, 1 / np.sqrt(np.where(diagonal > 0, diagonal, 1.0)), 0.0)
    unit = g[:, :m, :m] * size[:, :, None] * size[:, None, :]
    cross = unit[:, :KEPT, KEPT:]
    kept, known = _orthonormal(unit[:, :KEPT, :KEPT])
    away = -kept @ (kept.transpose(0, 2, 1) @ cross)
    fresh, new = _orthonormal(unit[:, KEPT:, KEPT:] + away.transpose(0, 2, 1) @ cross)
    w, used = np.zeros_like(unit), np.concatenate([known, new], axis=1)
    w[:, :KEPT, :KEPT], w[:, :KEPT, KEPT:], w[:, KEPT:, KEPT:] = kept, away @ fresh, fresh
    w *= size[:, :, None]
    small = w.transpose(0, 2, 1) @ h @ w
    small[:, at, at] = np.where(used, small[:, at, at], -4.0)  # beyond the spectrum, never among the best
    found, vectors = np.linalg.eigh(small)
    c, found = (w @ vectors)[:, :, :-KEPT - 1:-1], found[:, :-KEPT - 1:-1]
    c = np.where(found[:, None, :] < -2, 0.0, c)
    c[:, :, 0] *= np.where(np.einsum("ni,ni->n", c[:, :, 0], sums) < 0, -1.0, 1.0)[:, None]
    return c.transpose(0, 2, 1).reshape(len(g), -1), np.where(found < -2, 0.0, found)


def _orthonormal(products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of orthonormal vectors from inner products, and which of these vectors there are; the others are empty."""
    lengths, turn = np.linalg.eigh(products)
    used = lengths > DEPENDENT
    return turn * np.where(used, 1 / np.sqrt(np.where(used, lengths, 1.0)), 0.0)[:, None, :], used


def _best_in_basis(gram: DataFrame) -> DataFrame:
    """Per graph the leading vectors within the span of the kept ones and the new ones: (graph_id, c, values, left).

    ``c`` are their coefficients, one vector after the other, ``values`` their eigenvalues and ``left`` the length of the
    residual of the first kept vector. One row per graph comes in, of a fixed number of inner products and the vectors' own
    sums, which give the sign, and many graphs are solved in one call.
    """
    m = KEPT + STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g = np.zeros((b.num_rows, m + 1, m + 1))
            i, j = np.triu_indices(m + 1)
            numbers = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]], axis=1)
            g[:, i, j] = g[:, j, i] = numbers[:, :len(i)]
            c, values = _best_vectors(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, KEPT), g, numbers[:, len(i):])
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (c, values)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, pa.array(np.sqrt(np.maximum(g[:, KEPT, KEPT], 0.0)))], [KEY, "c", "values", "left"])

    key_type = gram.schema[KEY].dataType.simpleString()
    return gram.mapInArrow(run, f"{KEY} {key_type}, c array<double>, values array<double>, left double")


def _lengths(edges: DataFrame, weight: str | None) -> DataFrame:
    """The shortest edge per pair, both directions. An edge without a positive, finite length is no edge."""
    return adjacency(edges, weight).where("w > 0").groupBy(KEY, "idx", "nbr").agg(F.min("w").alias("w"))


def shortest_distances(edges: DataFrame, nodes: DataFrame | None = None, weight: str | None = None,
                       sources: DataFrame | None = None) -> DataFrame:
    """``(graph_id, source, idx, dist)`` from every node (or the given sources) to all it reaches.

    Only improved distances are sent on in the next round. The result is quadratic in the graph size, as
    all-pairs distances are; ``sources`` cuts it into blocks. Edges whose weight is null, NaN, infinite, zero or
    negative are left out, so the rounds end after at most as many as a graph has nodes.
    """
    adj = written(_lengths(edges, weight))
    start = (sources if sources is not None else _nodes(edges, nodes)).select(KEY, F.col("idx").alias("source"), "idx", F.lit(0.0).alias("dist"))
    dist = written(start.distinct())
    front = dist
    while True:
        tried = (front.join(adj, [KEY, "idx"]).groupBy(KEY, "source", F.col("nbr").alias("idx")).agg(F.min(F.col("dist") + F.col("w")).alias("dist")))
        known = dist.select(KEY, "source", "idx", F.col("dist").alias("_old"))
        front = written(tried.join(known, [KEY, "source", "idx"], "left").where(F.col("_old").isNull() | (F.col("dist") < F.col("_old"))).drop("_old"))
        if front.isEmpty():
            return dist
        dist = written(dist.unionByName(front).groupBy(KEY, "source", "idx").agg(F.min("dist").alias("dist")))


def _blocks(edges: DataFrame, ids: DataFrame, weight: str | None, block: int) -> Iterator[tuple[DataFrame, DataFrame, int, int]]:
    """Distances from one block of sources after another: (links, distances, number of the first source, width).

    ``d0, d1, ...`` of a node are its distances from the block's sources, infinite where there is no path, and ``no`` is its
    own number as a source. So the state is a block's width times the nodes, whatever the size of a graph.
    """
    if weight:
        lengths = _lengths(edges, weight)
    else:
        lengths = adjacency(edges, None).distinct()
    links = _with_self(lengths.where("idx <> nbr"), ids)
    numbered = written(ranked(ids, [KEY], [F.col("idx")], "no").join(_sizes(ids), KEY))
    largest = numbered.agg(F.max("_n")).first()[0] or 0
    width = min(block, largest)
    for first in range(1, largest + 1, max(width, 1)):
        own = [f"CASE WHEN no = {first + k} THEN 0D ELSE {INF} END AS d{k}" for k in range(width)]
        start = numbered.where(F.col("_n") >= first).selectExpr(KEY, "idx", "no", *own)
        yield links, _relaxed(links, start, width), first, width


def _relaxed(links: DataFrame, state: DataFrame, width: int) -> DataFrame:
    """Shorten all distances over the edges until nothing changes."""
    d = [f"d{k}" for k in range(width)]
    near = [f"min(CASE WHEN own THEN {c} ELSE {c} + w END) AS {c}" for c in d]
    old = [f"max(CASE WHEN own THEN {c} END) AS _{c}" for c in d]
    while True:
        for k in range(ROUNDS):
            columns = ["max(CASE WHEN own THEN no END) AS no", *near, *(old if k == ROUNDS - 1 else [])]
            state = links.join(state.withColumnRenamed("idx", "nbr"), [KEY, "nbr"]).groupBy(KEY, "idx").agg(*map(F.expr, columns))
        moved = " OR ".join(f"{c} < _{c}" for c in d)
        state = written(state.selectExpr(KEY, "idx", "no", *d, f"{moved} AS _moved"))
        if state.where("_moved").isEmpty():
            return state.drop("_moved")


def closeness(edges: DataFrame, nodes: DataFrame | None = None, weight: str | None = None, block: int = BLOCK) -> DataFrame:
    """``(r-1)/sum d * (r-1)/(n-1)`` with r reachable nodes; 0 for isolated nodes. Hops unless ``weight``.

    Distances are found for ``block`` sources at a time and added up per node at once; they are the same in both directions.
    """
    if nodes is None:
        return _by_size(edges, weight, "closeness", S.closeness, lambda rest, w: closeness(rest, graph_nodes(rest), w, block), least=True)
    edges = _stored(edges, weight)
    ids = written(_nodes(edges, nodes))
    total = None
    for _, d, _, width in _blocks(edges, ids, weight, block):
        found = " + ".join(f"CAST(d{k} > 0 AND d{k} < {INF} AS BIGINT)" for k in range(width))
        far = " + ".join(f"CASE WHEN d{k} < {INF} THEN d{k} ELSE 0D END" for k in range(width))
        total = _added(total, d.selectExpr(KEY, "idx", f"{found} AS _r", f"{far} AS _s"), ["_r", "_s"])
    value = F.when((F.col("_s") > 0) & (F.col("_n") > 1), F.col("_r") / F.col("_s") * F.col("_r") / (F.col("_n") - 1)).otherwise(0.0)
    if total is None:
        return ids.select(KEY, "idx", F.lit(0.0).alias("closeness"))
    return ids.join(total, [KEY, "idx"], "left").join(_sizes(ids), KEY).select(KEY, "idx", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def _added(total: DataFrame | None, part: DataFrame, cols: list[str]) -> DataFrame:
    """Node sums with one more block's; nothing of the block itself is kept."""
    if total is None:
        return part
    return written(total.unionByName(part).groupBy(KEY, "idx").agg(*[F.sum(c).alias(c) for c in cols]))


def betweenness(edges: DataFrame, nodes: DataFrame | None = None, weight: str | None = None, normalized: bool = True, block: int = BLOCK) -> DataFrame:
    """Share of shortest paths through each node, endpoints not counted. Hops unless ``weight``, which must be
    positive; other edges are left out.

    For ``block`` sources at a time the edges on shortest paths are marked, one bit per source; path counts flow along them
    and dependencies back, and what a block gives is added to the node sums at once.
    """
    if nodes is None:
        return _by_size(edges, weight, "betweenness", partial(S.betweenness, normalized=normalized),
                        lambda rest, w: betweenness(rest, graph_nodes(rest), w, normalized, block), least=True, error=_unequal())
    edges = _stored(edges, weight)
    ids = written(_nodes(edges, nodes))
    total = None
    for links, d, first, width in _blocks(edges, ids, weight, min(block, 62)):
        total = _added(total, _dependencies(links, d, first, width), ["_b"])
    if total is None:
        return ids.select(KEY, "idx", F.lit(0.0).alias("betweenness"))
    pairs = (F.col("_n") - 1) * (F.col("_n") - 2)
    scale = F.when(F.col("_n") > 2, 1 / pairs).otherwise(1.0) if normalized else F.lit(0.5)
    return (ids.join(total, [KEY, "idx"], "left").join(_sizes(ids), KEY)
            .select(KEY, "idx", (F.coalesce("_b", F.lit(0.0)) * scale).alias("betweenness")))


def _unequal() -> ValueError:
    return ValueError("edge lengths of one graph differ by more than a double can add up")


def _dependencies(links: DataFrame, d: DataFrame, first: int, width: int) -> DataFrame:
    """Summed dependencies of one block's sources per node."""
    ks = range(width)
    far = d.selectExpr(KEY, "idx AS nbr", *[f"d{k} AS _u{k}" for k in ks])
    near = d.selectExpr(KEY, "idx", *[f"d{k}" for k in ks])
    mask = " | ".join(f"CASE WHEN _u{k} < {INF} AND _u{k} + w = d{k} THEN {1 << k}L ELSE 0L END" for k in ks)
    tight = written(links.where("NOT own").join(far, [KEY, "nbr"]).join(near, [KEY, "idx"]).selectExpr(KEY, "idx", "nbr", f"{mask} AS mask").where("mask <> 0"))
    nodes = d.select(KEY, "idx")
    onto, back = _with_self(tight, nodes), _with_self(tight.selectExpr(KEY, "nbr AS idx", "idx AS nbr", "mask"), nodes)
    source = [f"CASE WHEN no = {first + k} THEN 1D ELSE 0D END" for k in ks]
    paths = _settled(onto, d.selectExpr(KEY, "idx", "no", *[f"{s} AS x{k}" for k, s in enumerate(source)]), ["no"], source)
    paths = paths.selectExpr(KEY, "idx", "no", *[f"x{k} AS s{k}" for k in ks])
    share = [f"CASE WHEN s{k} > 0 THEN 1 / s{k} ELSE 0D END" for k in ks]
    shares = _settled(back, paths.selectExpr("*", *[f"{s} AS x{k}" for k, s in enumerate(share)]), ["no", *[f"s{k}" for k in ks]], share)
    gained = " + ".join(f"CASE WHEN s{k} > 0 AND no <> {first + k} THEN s{k} * x{k} - 1 ELSE 0D END" for k in ks)
    return shares.selectExpr(KEY, "idx", f"{gained} AS _b")


def _settled(links: DataFrame, state: DataFrame, kept: list[str], start: list[str]) -> DataFrame:
    """``x_k = start_k + sum of x_k`` over the marked edges of column k, an acyclic set, round by round until nothing changes.

    A walk has fewer edges than its graph has nodes. A longer one would mean lengths so small beside others that a sum does
    not change, which is an error.
    """
    x = [f"x{k}" for k in range(len(start))]
    terms = {c: f"CASE WHEN own THEN {start[k]} WHEN mask & {1 << k}L <> 0 THEN {c} ELSE 0D END" for k, c in enumerate(x)}
    moved = " OR ".join(f"abs({c} - _{c}) > 1e-12D * {c}" for c in x)
    done, limit = 0, None
    while True:
        for k in range(ROUNDS):
            last = k == ROUNDS - 1
            now = state.selectExpr("*", *[f"{c} AS _{c}" for c in x]) if last else state
            state = _round(links, now, [*kept, *([f"_{c}" for c in x] if last else [])], terms)
        state = written(state.selectExpr(KEY, "idx", *kept, *x, f"{moved} AS _moved"))
        if state.where("_moved").isEmpty():
            return state.drop("_moved")
        done += ROUNDS
        limit = limit or (state.groupBy(KEY).count().agg(F.max("count")).first()[0] or 0)
        if done > limit + ROUNDS:
            raise _unequal()
