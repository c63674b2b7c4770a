"""Potentials, flux and edge memory on residue graphs. Edges: ``graph_id, i, j, dist, w[, g_mem]``, ``i < j``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from protspark.functions.lineage import cut, written
from protspark.functions.skew import spread, with_group_stats
from protspark.operators.geometry import knn_graph

KEY = "graph_id"
PACKED = 400_000  # edge rows of a structure that is solved as one row
IN_TASK = 20_000  # nodes and edge rows of a graph whose rounds run in one task


def finite(c: str, missing: float) -> Column:
    """The number, or ``missing`` for null, NaN and infinity."""
    ok = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(ok, F.col(c)).otherwise(F.lit(missing))


def adjacency(edges: DataFrame, weight: str | None = "w") -> DataFrame:
    """Both directions: ``(graph_id, idx, nbr, w)``."""
    w = finite(weight, 0.0) if weight else F.lit(1.0)
    one = edges.select(KEY, F.col("i").alias("idx"), F.col("j").alias("nbr"), w.cast("double").alias("w"))
    return one.unionByName(one.select(KEY, F.col("nbr").alias("idx"), F.col("idx").alias("nbr"), "w"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(KEY, F.col("i").alias("idx")).union(edges.select(KEY, "j")).distinct()


def _charges(nodes: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Nodes with ``b``: +1 at sources, -1 at sinks; a node that is both is a sink."""
    marks = (sources.select(KEY, "idx", F.lit(1.0).alias("m")).unionByName(sinks.select(KEY, "idx", F.lit(-1.0).alias("m")))
             .groupBy(KEY, "idx").agg(F.min("m").alias("b")))
    return nodes.select(KEY, "idx").distinct().join(marks, [KEY, "idx"], "left").na.fill(0.0, ["b"])


def potentials(edges: DataFrame, nodes: DataFrame, sources: DataFrame, sinks: DataFrame, eps: float = 1e-3,
               max_nodes: int = 256, tol: float = 1e-10, max_iter: int = 1_000, max_edges: int = 0) -> DataFrame:
    """Solve ``(L + eps I) phi = b`` per graph: ``(graph_id, idx, phi)``.

    Graphs of at most ``max_nodes`` nodes (a checked size) are rows of their own and solved densely. Larger
    ones are solved together by conjugate gradients on the edge table, whose steps are joins and sums; a residual
    above ``tol`` after ``max_iter`` rounds is an error. Graphs between, with at most ``max_edges`` edge rows and nodes
    (checked too), are rows as well, with the same conjugate gradients in their task.
    """
    edges = cut(edges.select(KEY, "i", "j", "w"))
    charged = cut(_charges(nodes, sources, sinks))
    sizes = charged.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > max_nodes)
    if max_edges:
        rows = edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("_m"))
        large = large.join(rows, KEY, "left").where((F.col("_n") > max_edges) | (F.col("_m") > max_edges))
    large = cut(large.select(KEY))
    small_nodes, small_edges = charged.join(large, KEY, "left_anti"), edges.join(large, KEY, "left_anti")
    dense = _solve_rows(small_edges, small_nodes, eps, max_nodes, tol, max_iter)
    if large.isEmpty():
        return dense
    rest = _solve_cg(edges.join(large, KEY, "left_semi"), charged.join(large, KEY, "left_semi"), eps, tol, max_iter)
    return dense.unionByName(rest)


def _gradients(at_i: np.ndarray, at_j: np.ndarray, w: np.ndarray, b: np.ndarray, eps: float, tol: float, max_iter: int) -> np.ndarray:
    """Conjugate gradients as in ``_solve_cg``, for the links of one graph (a loop links nothing)."""
    w = np.where(at_i == at_j, 0.0, w)
    a, z, ww = np.concatenate([at_i, at_j]), np.concatenate([at_j, at_i]), np.concatenate([w, w])
    d = np.bincount(a, ww, len(b)) + eps
    x, r = np.zeros(len(b)), b.astype(float)
    p, rz = r / d, r @ (r / d)
    for _ in range(max_iter):
        if np.sqrt(r @ r) < tol:
            return x
        ap = d * p - np.bincount(a, ww * p[z], len(b))
        step = rz / (p @ ap)
        x, r = x + step * p, r - step * ap
        rz, old = r @ (r / d), rz
        p = r / d + rz / old * p
    raise RuntimeError(f"conjugate gradients left a residual above {tol} after {max_iter} rounds")


def _solve_rows(edges: DataFrame, charged: DataFrame, eps: float, max_nodes: int, tol: float, max_iter: int) -> DataFrame:
    """One row per graph (its size is checked), many graphs per Arrow batch; dense up to ``max_nodes``."""
    key_type = charged.schema[KEY].dataType.simpleString()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, idx, phi = [], [], []
            for row in pdf.itertuples(index=False):
                key, ids, b, i, j, w = row
                order = np.argsort(ids)
                ids, n = ids[order], len(ids)
                keys += [key] * n
                idx.append(ids)
                if n > max_nodes:
                    i, j, w = (np.zeros(0), np.zeros(0), np.zeros(0)) if i is None else (i, j, w)
                    phi.append(_gradients(np.searchsorted(ids, i), np.searchsorted(ids, j), w, b[order], eps, tol, max_iter))
                    continue
                mat = np.zeros((n, n))
                if i is not None:
                    at_i, at_j = np.searchsorted(ids, i), np.searchsorted(ids, j)
                    mat[at_i, at_j] = mat[at_j, at_i] = -w
                np.fill_diagonal(mat, 0.0)
                np.fill_diagonal(mat, eps - mat.sum(axis=1))
                phi.append(np.linalg.solve(mat, b[order]))
            yield pd.DataFrame({KEY: keys, "idx": np.concatenate(idx) if idx else [], "phi": np.concatenate(phi) if phi else []})

    return _packed(edges, charged).mapInPandas(solve, f"{KEY} {key_type}, idx long, phi double")


def _packed(edges: DataFrame, charged: DataFrame) -> DataFrame:
    """One row per graph with its nodes and links as lists: ``(graph_id, idx, b, i, j, w)``."""
    links = edges.groupBy(KEY, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.max(finite("w", 0.0).cast("double")).alias("w"))
    lists = lambda df, *cols: df.groupBy(KEY).agg(F.collect_list(F.struct(*cols)).alias("_l")).select(KEY, *[F.col(f"_l.{c}").alias(c) for c in cols])
    nodes = lists(charged.select(KEY, F.col("idx").cast("long").alias("idx"), "b"), "idx", "b")
    return spread(nodes.join(lists(links, "i", "j", "w"), KEY, "left").select(KEY, "idx", "b", "i", "j", "w"), KEY)


def _in_step(graph: np.ndarray, a: np.ndarray, z: np.ndarray, w: np.ndarray, b: np.ndarray, eps: float, tol: float, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """The rounds of ``_rounds`` for the nodes of many graphs and their links in both directions: solution, residual per graph.

    A link from -1 comes from no node, one to -1 counts for its own node only.
    """
    a, z, w = a[a >= 0], z[a >= 0], w[a >= 0]
    d = np.bincount(a, w, len(b)) + eps
    a, z, w = a[z >= 0], z[z >= 0], w[z >= 0]
    per = lambda v: np.bincount(graph, v)
    x, r, p = np.zeros(len(b)), b.astype(float), b / d
    rz, left = per(r * r / d), np.sqrt(per(r * r))
    for _ in range(max_iter):
        if not (left >= tol).any():
            break
        ap = d * p - np.bincount(a, w * p[z], len(b))
        pap = per(p * ap)
        alpha = np.divide(rz, pap, out=np.zeros(len(rz)), where=(pap > 0) & (left >= tol))[graph]
        x, r = x + alpha * p, r - alpha * ap
        rz, old = per(r * r / d), rz
        p = r / d + np.divide(rz, old, out=np.zeros(len(rz)), where=old > 0)[graph] * p
        left = np.sqrt(per(r * r))
    return x, left


def _solve_cg(edges: DataFrame, charged: DataFrame, eps: float, tol: float, max_iter: int) -> DataFrame:
    """Conjugate gradients with a diagonal preconditioner, all graphs in step.

    The rounds of graphs of at most ``IN_TASK`` nodes and edge rows run where their rows are, so nothing is moved or written
    between rounds; those of larger ones are joins.
    """
    n = charged.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")).join(edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("_m")), KEY, "left")
    large = cut(n.where((F.col("_n") > IN_TASK) | (F.col("_m") > IN_TASK)).select(KEY))
    key_type = charged.schema[KEY].dataType.simpleString()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, sizes, ids, b, a, z, w, first = [], [], [], [], [], [], [], 0
            for key, idx, charge, i, j, links in pdf.itertuples(index=False):
                order = np.argsort(idx)
                idx = idx[order]
                keys.append(key)
                sizes.append(len(idx))
                ids.append(idx)
                b.append(charge[order])
                if i is not None:
                    at = [np.minimum(np.searchsorted(idx, v), len(idx) - 1) for v in (i, j)]
                    at_i, at_j = (np.where(idx[k] == v, first + k, -1) for k, v in zip(at, (i, j)))
                    a += [at_i, at_j]
                    z += [at_j, at_i]
                    w += [links, links]
                first += len(idx)
            if not keys:
                continue
            graph = np.repeat(np.arange(len(keys)), sizes)
            ends = [np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (a, z)]
            x, left = _in_step(graph, *ends, np.concatenate(w) if w else np.zeros(0), np.concatenate(b), eps, tol, max_iter)
            yield pd.DataFrame({KEY: [keys[g] for g in graph], "idx": np.concatenate(ids), "phi": x, "_res": left[graph]})

    few = charged.join(large, KEY, "left_anti")
    small = _packed(edges.where(F.col("i") != F.col("j")).join(large, KEY, "left_anti"), few.where("idx IS NOT NULL"))
    done = cut(small.mapInPandas(solve, f"{KEY} {key_type}, idx long, phi double, _res double"))
    if (done.agg(F.max("_res")).first()[0] or 0.0) >= tol:
        raise RuntimeError(f"conjugate gradients left a residual above {tol} after {max_iter} rounds")
    done = done.drop("_res").unionByName(few.where("idx IS NULL").select(KEY, F.col("idx").cast("long").alias("idx"), F.lit(0.0).alias("phi")))  # no charge
    if large.isEmpty():
        return done
    return done.unionByName(_rounds(edges.join(large, KEY, "left_semi"), charged.join(large, KEY, "left_semi"), eps, tol, max_iter))


def _rounds(edges: DataFrame, charged: DataFrame, eps: float, tol: float, max_iter: int) -> DataFrame:
    """The rounds as joins and sums of the edge table, two checkpoints per round."""
    adj = cut(adjacency(edges.where(F.col("i") != F.col("j")).groupBy(KEY, "i", "j").agg(F.max(finite("w", 0.0)).alias("w"))))
    degree = adj.groupBy(KEY, "idx").agg(F.sum("w").alias("_d"))
    v = (charged.join(degree, [KEY, "idx"], "left")
         .select(KEY, F.col("idx").cast("long").alias("idx"), (F.coalesce("_d", F.lit(0.0)) + eps).alias("d"), F.lit(0.0).alias("x"), F.col("b").alias("r")))
    v = cut(v.withColumn("p", F.col("r") / F.col("d")))
    for _ in range(max_iter):
        moved = (adj.join(v.select(KEY, F.col("idx").alias("nbr"), "p"), [KEY, "nbr"])
                 .groupBy(KEY, "idx").agg(F.sum(F.col("w") * F.col("p")).alias("_wp")))
        step = v.join(moved, [KEY, "idx"], "left").withColumn("ap", F.col("d") * F.col("p") - F.coalesce("_wp", F.lit(0.0))).drop("_wp")
        scal = step.groupBy(KEY).agg(F.sum(F.col("r") * F.col("r") / F.col("d")).alias("_rz"), F.sum(F.col("p") * F.col("ap")).alias("_pap"))
        # A solved graph has nothing left to move.
        alpha = F.when(F.col("_pap") > 0, F.col("_rz") / F.col("_pap")).otherwise(0.0)
        after = cut(step.join(scal, KEY).select(
            KEY, "idx", "d", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p", "_rz"))
        beta = after.groupBy(KEY).agg(F.try_divide(F.sum(F.col("r") * F.col("r") / F.col("d")), F.max("_rz")).alias("_beta"), F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("_res"))
        beta = cut(beta)
        v = after.join(beta, KEY).select(KEY, "idx", "d", "x", "r", (F.col("r") / F.col("d") + F.coalesce("_beta", F.lit(0.0)) * F.col("p")).alias("p"))
        if (beta.agg(F.max("_res")).first()[0] or 0.0) < tol:
            break
    else:
        raise RuntimeError(f"conjugate gradients left a residual above {tol} after {max_iter} rounds")
    return v.select(KEY, "idx", F.col("x").alias("phi"))


def edge_flux(edges: DataFrame, phi: DataFrame) -> DataFrame:
    """Add ``flux = |phi_i - phi_j| / (dist + 1e-6)``; an unusable distance is 1."""
    at = lambda end: phi.select(KEY, F.col("idx").alias(end), F.col("phi").alias(f"_phi_{end}"))
    joined = edges.join(at("i"), [KEY, "i"]).join(at("j"), [KEY, "j"])
    return joined.withColumn("flux", F.abs(F.col("_phi_i") - F.col("_phi_j")) / (finite("dist", 1.0) + 1e-6)).drop("_phi_i", "_phi_j")


def adapt_conductance(edges: DataFrame, alpha: float = 0.2, base: float = 1.0) -> DataFrame:
    """``g_mem <- (1-alpha) g + alpha (base + flux)``; a missing or non-finite g is ``base``."""
    have = edges if "g_mem" in edges.columns else edges.withColumn("g_mem", F.lit(None).cast("double"))
    return have.withColumn("g_mem", (1 - alpha) * finite("g_mem", base) + alpha * (base + F.col("flux")))


def minmax_by_graph(edges: DataFrame, col: str = "g_mem", jitter: float = 0.0, seed: int = 7) -> DataFrame:
    """Scale to [0, 1] per graph; a constant graph becomes 0 (or small noise with ``jitter``)."""
    span = with_group_stats(edges, [KEY], _lo=F.min(col), _hi=F.max(col))
    noise = F.randn(seed) * jitter if jitter else F.lit(0.0)
    scaled = (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-12)
    return span.withColumn(col, F.when(F.col("_hi") == F.col("_lo"), noise).otherwise(scaled)).drop("_lo", "_hi")


def flux_target(edges: DataFrame, flux: DataFrame) -> DataFrame:
    """Add ``target = 0.05 + 0.95 f/(max f + 1e-12)``; edges without flux count 0, direction is ignored."""
    lo, hi = F.least("i", "j").alias("_lo"), F.greatest("i", "j").alias("_hi")
    known = flux.groupBy(KEY, lo, hi).agg(F.max("flux").alias("_f"))
    joined = edges.select("*", lo, hi).join(known, [KEY, "_lo", "_hi"], "left").na.fill(0.0, ["_f"])
    scaled = with_group_stats(joined, [KEY], _m=F.max("_f"))
    share = F.when(F.col("_m") > 0, F.col("_f") / (F.col("_m") + 1e-12)).otherwise(F.col("_f"))
    return scaled.withColumn("target", 0.05 + 0.95 * share).select(*edges.columns, "target")


def build_graphs(residues: DataFrame, topk: int = 6, min_sep: int = 2, sigma: float = 8.0, eps: float = 1e-3,
                 min_residues: int = 8, alpha: float = 0.3) -> DataFrame:
    """Edges with distance, weight, flux and edge memory for each structure of at least ``min_residues``.

    The source is the first residue by position and the sink the seventh (or the last).
    """
    big = residues.groupBy("model_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_residues)
    kept = residues.join(big.select("model_id"), "model_id", "left_semi")
    edges = cut(knn_graph(kept, topk, min_sep, sigma).withColumnRenamed("model_id", KEY))
    from protspark.functions.skew import first_n

    nodes = kept.select(F.col("model_id").alias(KEY), F.col("idx").cast("long").alias("idx"))
    heads = first_n(nodes, [KEY], ["idx"], 7, "_k")
    sources = heads.where(F.col("_k") == 1)
    sinks = heads.groupBy(KEY).agg(F.max("idx").alias("idx"))
    phi = potentials(edges, nodes, sources, sinks, eps, max_edges=PACKED)
    return minmax_by_graph(adapt_conductance(edge_flux(edges, phi), alpha))


def fit_scalers(vectors: DataFrame, vec: str = "features", kind: str = "node") -> DataFrame:
    """Population mean and std (+1e-6) per entry over all rows: ``(kind, dim, mean, std)``."""
    long = vectors.select(F.posexplode(F.col(vec).cast("array<double>")).alias("dim", "v"))
    return long.groupBy("dim").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") + 1e-6).alias("std")).select(F.lit(kind).alias("kind"), "dim", "mean", "std")


def apply_scalers(vectors: DataFrame, scalers: DataFrame, vec: str = "features", keep_raw: int | None = None) -> DataFrame:
    """Z-score each entry; entry ``keep_raw`` stays as it is. The scaler table has one row per entry."""
    stats = {r["dim"]: (r["mean"], r["std"]) for r in scalers.collect()}
    dims = sorted(stats)
    mean = F.array(*[F.lit(float(stats[d][0])) for d in dims])
    std = F.array(*[F.lit(float(stats[d][1])) for d in dims])
    pairs = F.arrays_zip(F.col(vec).cast("array<double>").alias("x"), mean.alias("m"), std.alias("s"))

    def one(e: Column, k: Column) -> Column:
        z = (e["x"] - e["m"]) / (e["s"] + 1e-6)
        return F.when(k == keep_raw, e["x"]).otherwise(z) if keep_raw is not None else z

    return vectors.withColumn(vec, F.transform(pairs, one))


def memory_scores(edges: DataFrame, response: DataFrame, cutoff: float = 7.0) -> DataFrame:
    """Edge memory ``q^2 / k`` with ``k = 1/d^2`` for pairs within ``cutoff``; ``response``: graph_id, i, j, q."""
    near = edges.where(F.col("dist") <= cutoff)
    return near.join(response, [KEY, "i", "j"]).withColumns({
        "k": F.try_divide(F.lit(1.0), F.col("dist") * F.col("dist")), "memory": F.col("q") ** 2 * F.col("dist") * F.col("dist")})


def node_memory(edges: DataFrame) -> DataFrame:
    """Sum of the memory of a node's edges."""
    ends = edges.select(KEY, F.col("i").alias("idx"), "memory").unionAll(edges.select(KEY, "j", "memory"))
    return ends.groupBy(KEY, "idx").agg(F.sum("memory").alias("memory"))


def normalize_weights(edges: DataFrame, ligand_pairs: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Weights divided by ten times the graph's mean; ligand edges (weight 1) only between known nodes."""
    scaled = with_group_stats(edges, [KEY], _m=F.avg("w")).withColumn("w", F.try_divide(F.col("w"), F.col("_m") * 10.0)).select(KEY, "i", "j", "w")
    if ligand_pairs is None:
        return scaled
    ids = nodes.select(KEY, "idx").distinct()
    linked = (ligand_pairs.join(ids.withColumnRenamed("idx", "i"), [KEY, "i"], "left_semi")
              .join(ids.withColumnRenamed("idx", "j"), [KEY, "j"], "left_semi"))
    # Written, because a union of two co-partitioned sides would hold the sorts of both in one task.
    return scaled.unionByName(written(linked.select(KEY, "i", "j", F.lit(1.0).alias("w")).distinct()))
