"""Drift of a score stream against a stored baseline, per tumbling window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from protspark.operators.drift import bin_of, psi_verdict


def monitor_stream(scores: DataFrame, ts: str, col: str, edges: list[float], proportions: list[float],
                   window: str = "1 day", delay: str = "1 hour", eps: float = 1e-6, scheme: str = "watch") -> DataFrame:
    """One row per closed window: scores in range, PSI and verdict. Works on a stream and on a table.

    The state of a window is one counter per bin, so it does not grow with the feed. Rows later than
    ``delay`` are dropped by the watermark.
    """
    timed = scores.withColumn("_ts", F.col(ts).cast("timestamp")).withColumn("_b", bin_of(F.col(col).cast("double"), edges))
    bins = range(len(edges) - 1)
    counts = (timed.withWatermark("_ts", delay).groupBy(F.window("_ts", window))
              .agg(*[F.coalesce(F.sum((F.col("_b") == k).cast("long")), F.lit(0)).alias(f"_{k}") for k in bins]))
    total = sum((F.col(f"_{k}") for k in bins), F.lit(0))
    clip = lambda c: F.least(F.greatest(c, F.lit(eps)), F.lit(1.0))
    psi = F.lit(0.0)
    for k in bins:
        p = F.lit(min(max(float(proportions[k]), eps), 1.0))
        q = clip(F.when(total > 0, F.col(f"_{k}") / total).otherwise(0.0))
        psi = psi + (p - q) * F.log(p / q)
    return counts.select(F.col("window.start").alias("window_start"), total.alias("n"), psi.alias("psi")).withColumn("verdict", psi_verdict("psi", scheme))


def start_monitor(report: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append closed windows to a Parquet table (exactly once, by the sink's own log)."""
    writer = report.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
