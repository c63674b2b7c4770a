"""Population-stability drift on binned distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from protspark.functions.ordered import exact_quantiles
from protspark.functions.vectors import l2_norm


def quantile_edges(df: DataFrame, col: str, k: int = 10) -> list[float]:
    """At most ``k+1`` distinct quantile edges; [0, 1] for no data, a narrow bin for one value."""
    row = exact_quantiles(df.select(F.col(col).cast("double").alias("v")), [], "v", [i / k for i in range(k + 1)]).first()
    values = sorted({v for v in row if v is not None}) if row else []
    if not values:
        return [0.0, 1.0]
    return values if len(values) > 1 else [values[0] - 1e-6, values[0] + 1e-6]


def bin_of(value: Column, edges: list[float]) -> Column:
    """0-based bin, half-open except the last; null outside the edges."""
    last = len(edges) - 2
    out = F.when(value == edges[-1], last)
    for k in range(last + 1):
        out = out.when((value >= edges[k]) & (value < edges[k + 1]), k)
    return out


def hist_props(df: DataFrame, col: str, edges: list[float], by: list[str] = [], empty: str = "uniform") -> DataFrame:
    """Proportion per bin ``(by, bin, p)``, with all bins present; an empty histogram is uniform or zero."""
    bins = len(edges) - 1
    counts = [F.coalesce(F.sum((F.col("_b") == k).cast("long")), F.lit(0)).alias(f"_{k}") for k in range(bins)]
    wide = df.select(*by, bin_of(F.col(col).cast("double"), edges).alias("_b")).groupBy(*by).agg(*counts)
    total = sum((F.col(f"_{k}") for k in range(bins)), F.lit(0))
    blank = 1.0 / bins if empty == "uniform" else 0.0
    props = F.array(*[F.when(total > 0, F.col(f"_{k}") / total).otherwise(blank) for k in range(bins)])
    return wide.select(*by, F.posexplode(props).alias("bin", "p"))


def psi(base: DataFrame, cur: DataFrame, by: list[str] = [], eps: float = 1e-12) -> DataFrame:
    """``sum (p-q) ln(p/q)`` over bins, with proportions clipped to [eps, 1]."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(eps)), F.lit(1.0))
    joined = base.select(*by, "bin", F.col("p").alias("_p")).join(cur.select(*by, "bin", F.col("p").alias("_q")), [*by, "bin"])
    term = (clip("_p") - clip("_q")) * F.log(clip("_p") / clip("_q"))
    return joined.groupBy(*by).agg(F.sum(term).alias("psi"))


# Limits and names of the three verdict schemes (``open`` limits are exclusive).
VERDICTS = {
    "four": ("open", [(0.1, "stable"), (0.25, "slight_shift"), (0.5, "moderate_shift")], "major_shift"),
    "watch": ("closed", [(0.10, "stable"), (0.25, "watch")], "drift"),
    "report": ("open", [(0.1, "no drift"), (0.25, "monitor")], "investigate"),
}


def psi_verdict(value: str | Column, scheme: str = "four") -> Column:
    kind, limits, above = VERDICTS[scheme]
    v = F.col(value) if isinstance(value, str) else value
    out = F.lit(above)
    for limit, name in reversed(limits):
        out = F.when(v < limit if kind == "open" else v <= limit, name).otherwise(out)
    return out


def build_baseline(inputs: dict[str, tuple[DataFrame, str, list[float]]], empty: str = "zero") -> DataFrame:
    """``(metric, bin, lo, hi, p)`` of several metrics: name -> (table, column, edges)."""
    out = None
    for name, (df, col, edges) in inputs.items():
        lo = F.array(*[F.lit(float(e)) for e in edges])
        part = hist_props(df, col, edges, empty=empty).select(
            F.lit(name).alias("metric"), "bin", F.element_at(lo, F.col("bin") + 1).alias("lo"), F.element_at(lo, F.col("bin") + 2).alias("hi"), "p")
        out = part if out is None else out.unionByName(part)
    return out


def psi_report(baseline: DataFrame, current: DataFrame, scheme: str = "report", eps: float = 1e-6) -> DataFrame:
    """PSI and verdict per metric of two baseline-shaped tables."""
    return psi(baseline, current, ["metric"], eps).withColumn("verdict", psi_verdict("psi", scheme))


def baseline_edges(baseline: DataFrame, metric: str) -> list[float]:
    """Bin edges of one metric (as many rows as bins)."""
    rows = baseline.where(F.col("metric") == metric).select("bin", "lo", "hi").orderBy("bin").collect()
    return [r["lo"] for r in rows] + [rows[-1]["hi"]]


def monitor_scores(scores: DataFrame, col: str, baseline: DataFrame, metric: str = "score", by: list[str] = [],
                   eps: float = 1e-6, scheme: str = "watch") -> DataFrame:
    """PSI of a score column against a stored baseline, with verdict."""
    edges = baseline_edges(baseline, metric)
    cur = hist_props(scores, col, edges, by, empty="zero")
    base = baseline.where(F.col("metric") == metric).select("bin", "p")
    joined = cur.select(*by, "bin", F.col("p").alias("_q")).join(base.withColumnRenamed("p", "_p"), "bin")
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(eps)), F.lit(1.0))
    term = (clip("_p") - clip("_q")) * F.log(clip("_p") / clip("_q"))
    return joined.groupBy(*by).agg(F.sum(term).alias("psi")).withColumn("verdict", psi_verdict("psi", scheme))


def embedding_norms(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("norm", l2_norm(vec))


def separations(pairs: DataFrame, label: str = "y") -> DataFrame:
    """Sequence separation of positive pairs."""
    return pairs.where(F.col(label) > 0.5).withColumn("sep", F.col("j") - F.col("i"))


def sequence_lengths(residues: DataFrame, by: list[str]) -> DataFrame:
    return residues.groupBy(*by).agg(F.count(F.lit(1)).alias("length"))
