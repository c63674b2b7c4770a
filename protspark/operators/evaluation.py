"""Ranking, classification and regression metrics as aggregations.

``by`` is a list of group columns; an empty list gives one pooled row. Score-ordered metrics count the
distinct scores first and order only those, by range, so one huge group is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protspark.functions.ordered import ranked, running_totals, value_ranks
from protspark.functions.skew import first_n, salted_join

TAUS = [round(0.10 + 0.05 * k, 2) for k in range(17)]


def _score_counts(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))


def score_curve(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Per distinct score, from the top: ``tp`` and ``seen`` up to and including it, plus its own counts."""
    return running_totals(_score_counts(df, score, label, by), by, [F.desc("score")], {"tp": F.col("pos"), "seen": F.col("n")})


def roc_auc(df: DataFrame, score: str, label: str, by: list[str] = [], curve: DataFrame | None = None) -> DataFrame:
    """Area under the ROC curve; ties count half. NaN for one class only."""
    c = curve if curve is not None else score_curve(df, score, label, by)
    neg = F.col("n") - F.col("pos")
    # Positives strictly above, plus half of those at the same score, for each negative.
    # As doubles: a product of two counts leaves the range of a long at a few billion rows.
    pos, lost = F.col("pos").cast("double"), neg.cast("double")
    wins = lost * (F.col("tp") - F.col("pos")) + lost * pos / 2
    agg = c.groupBy(*by).agg(F.sum(wins).alias("_w"), F.sum("pos").alias("_p"), F.sum(neg).alias("_n"))
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return agg.select(*by, F.when(both, F.col("_w") / F.col("_p") / F.col("_n")).otherwise(float("nan")).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str, by: list[str] = [], curve: DataFrame | None = None) -> DataFrame:
    """Sum of precision times recall step over distinct thresholds; 0 without positives."""
    c = curve if curve is not None else score_curve(df, score, label, by)
    agg = c.groupBy(*by).agg(F.sum(F.col("pos").cast("double") * F.col("tp") / F.col("seen")).alias("_s"), F.sum("pos").alias("_p"))
    return agg.select(*by, F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")).otherwise(0.0).alias("ap"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    prec = tp / F.greatest(tp + fp, F.lit(1))
    rec = tp / F.greatest(tp + fn, F.lit(1))
    return 2 * prec * rec / F.greatest(prec + rec, F.lit(1e-8))


def _confusion(score: str, label: str, tau: float) -> tuple[Column, Column, Column]:
    hot, yes = F.col(score) >= tau, F.col(label).cast("int") == 1
    count = lambda c: F.sum(c.cast("long"))
    return count(hot & yes), count(hot & ~yes), count(~hot & yes)


def f1_at(df: DataFrame, score: str, label: str, tau: float = 0.5, by: list[str] = []) -> DataFrame:
    return df.groupBy(*by).agg(_f1(*_confusion(score, label, tau)).alias("f1"))


def best_f1(df: DataFrame, score: str, label: str, by: list[str] = [], taus: list[float] = TAUS) -> DataFrame:
    """Best F1 over the grid and the smallest threshold that reaches it; (0, 0.5) when nothing is positive.

    All thresholds are conditional sums of one pass; the rows are not repeated.
    """
    scored = [_f1(*_confusion(score, label, t)).alias(f"_f{k}") for k, t in enumerate(taus)]
    wide = df.groupBy(*by).agg(*scored)
    options = F.array(*[F.struct(F.col(f"_f{k}").alias("f1"), F.lit(-t).alias("neg_tau")) for k, t in enumerate(taus)])
    best = F.array_max(F.filter(options, lambda o: o["f1"] > 0))
    return wide.withColumn("_b", best).select(
        *by, F.coalesce("_b.f1", F.lit(0.0)).alias("best_f1"), F.coalesce(-F.col("_b.neg_tau"), F.lit(0.5)).alias("tau"))


def precision_at(df: DataFrame, score: str, label: str, by: list[str], order: list[Column], k_rule: str = "length",
                 frac: float = 1.0, length: str | None = None) -> DataFrame:
    """Precision among the top k pairs of each example: ``(by, k, precision)``.

    k is ``length`` (that column), ``sqrt`` = round(sqrt(2n)) or ``frac`` = floor(frac * L) with L from
    n = L(L-1)/2; always between 1 and n. ``order`` breaks score ties.
    """
    n = F.col("_n")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), (F.max(length) if length else F.lit(0)).alias("_len"))
    k = {
        "length": F.col("_len"),
        "sqrt": F.bround(F.sqrt(n * 2.0)),
        "frac": F.floor(F.lit(frac) * F.floor((1.0 + F.sqrt(1.0 + 8.0 * n)) / 2.0)),
    }[k_rule]
    sizes = sizes.select(*by, F.least(F.greatest(k, F.lit(1)), n).cast("long").alias("_k"))
    placed = ranked(df.select(*by, score, label, *[c for c in _names(order) if c not in (*by, score, label)]), by, [F.desc(score), *order], "_rank")
    return (placed.join(sizes, by).where(F.col("_rank") <= F.col("_k"))
            .groupBy(*by, F.col("_k").alias("k")).agg(F.avg(F.col(label).cast("double")).alias("precision")))


def _names(order: list) -> list[str]:
    return [o for o in order if isinstance(o, str)]


def masked_bce(df: DataFrame, logit: str, label: str, mask: str, by: list[str] = []) -> DataFrame:
    """Mean binary cross-entropy of logits over masked rows."""
    x, y, m = F.col(logit), F.col(label), F.col(mask)
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return df.groupBy(*by).agg((F.sum(loss * m) / F.greatest(F.sum(m), F.lit(1.0))).alias("loss"))


def regression_metrics(df: DataFrame, y: str, pred: str, by: list[str] = []) -> DataFrame:
    """MSE, RMSE, MAE, R2 (NaN below two rows or for a constant target) and N in one pass."""
    t, p = F.col(y).cast("double"), F.col(pred).cast("double")
    agg = df.groupBy(*by).agg(F.avg((t - p) ** 2).alias("mse"), F.avg(F.abs(t - p)).alias("mae"),
                              F.var_pop(t).alias("_v"), F.count(F.lit(1)).alias("n"))
    fit = 1 - F.col("mse") * F.col("n") / (F.col("_v") * F.col("n") + 1e-12)
    usable = (F.col("n") >= 2) & (F.abs("_v") > 1e-8)
    return agg.select(*by, "mse", F.sqrt("mse").alias("rmse"), "mae", F.when(usable, fit).otherwise(float("nan")).alias("r2"), "n")


def combined_metrics(df: DataFrame, err1: str, err2: str, by: list[str] = []) -> DataFrame:
    a, b = F.col(err1), F.col(err2)
    agg = df.groupBy(*by).agg(F.avg((a * a + b * b) / 2).alias("mse"), F.avg((F.abs(a) + F.abs(b)) / 2).alias("mae"), F.count(F.lit(1)).alias("n"))
    return agg.select(*by, "mse", F.sqrt("mse").alias("rmse"), "mae", "n")


def guarded_corr(x: Column, y: Column, missing: float = float("nan")) -> Column:
    """Correlation aggregate; Spark's own fails on a constant side under ANSI rules."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    usable = (F.count(F.lit(1)) >= 2) & (sx > 1e-8) & (sy > 1e-8)
    return F.when(usable, F.try_divide(F.covar_pop(x, y), sx * sy)).otherwise(missing)


def safe_pearson(df: DataFrame, x: str, y: str, by: list[str] = [], missing: float = float("nan")) -> DataFrame:
    """Pearson correlation, or ``missing`` below two rows or for a constant side."""
    return df.groupBy(*by).agg(guarded_corr(F.col(x).cast("double"), F.col(y).cast("double"), missing).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] = [], ties: str = "average", ord_col: str | None = None,
             missing: float = float("nan")) -> DataFrame:
    """Rank correlation with average ranks, or ordinal ranks in which ties follow ``ord_col``."""
    if ties == "ordinal":
        rx = ranked(df.select(*by, x, y, ord_col), by, [F.col(x), F.col(ord_col)], "_rx")
        both = ranked(rx, by, [F.col(y), F.col(ord_col)], "_ry")
        return both.groupBy(*by).agg(guarded_corr(F.col("_rx").cast("double"), F.col("_ry").cast("double"), missing).alias("spearman"))
    # Equal (x, y) rows are counted first; ranks of distinct values are joined back, salted for hot values.
    cells = df.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_c"))
    rx = value_ranks(cells, by, x, F.col("_c")).select(*by, x, F.col("avg_rank").alias("_rx"))
    ry = value_ranks(cells, by, y, F.col("_c")).select(*by, y, F.col("avg_rank").alias("_ry"))
    placed = salted_join(salted_join(cells, rx, [*by, x]), ry, [*by, y])
    c, a, b = F.col("_c"), F.col("_rx"), F.col("_ry")
    m = placed.groupBy(*by).agg(F.sum(c).alias("n"), F.sum(c * a).alias("sa"), F.sum(c * b).alias("sb"),
                                F.sum(c * a * a).alias("saa"), F.sum(c * b * b).alias("sbb"), F.sum(c * a * b).alias("sab"))
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    va = F.col("saa") - F.col("sa") ** 2 / F.col("n")
    vb = F.col("sbb") - F.col("sb") ** 2 / F.col("n")
    usable = (F.col("n") >= 2) & (va > 1e-8) & (vb > 1e-8)
    return m.select(*by, F.when(usable, cov / F.sqrt(va) / F.sqrt(vb)).otherwise(missing).alias("spearman"))


def sign_agreement(df: DataFrame, x: str, y: str, tau: float, by: list[str] = []) -> DataFrame:
    """Share of equal signs among rows where both magnitudes exceed ``tau``; NaN when there are none."""
    big = (F.abs(x) > tau) & (F.abs(y) > tau)
    same = F.when(big, (F.signum(x) == F.signum(y)).cast("double"))
    return df.groupBy(*by).agg(F.coalesce(F.avg(same), F.lit(float("nan"))).alias("sign_agreement"))


def binary_report(df: DataFrame, truth: str, pred: str, by: list[str] = [], threshold: float = 0.0) -> DataFrame:
    """Confusion counts, precision, recall, F1 and accuracy of ``value < threshold`` on both sides."""
    t, p = F.col(truth) < threshold, F.col(pred) < threshold
    count = lambda c: F.sum(c.cast("long"))
    agg = df.groupBy(*by).agg(count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"), count(~t & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return agg.select(*by, "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                      ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def rollup_metrics(df: DataFrame, score: str, label: str, example: str, tau: float = 0.5) -> DataFrame:
    """Count, positives, F1, AUC and AP per example and pooled (null example), in one report."""
    sums = df.rollup(example).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"),
                                  _f1(*_confusion(score, label, tau)).alias("f1"), F.grouping(example).alias("_g"))
    def ordered(by: list[str]) -> DataFrame:
        curve = score_curve(df, score, label, by)
        a, p = roc_auc(df, score, label, by, curve), average_precision(df, score, label, by, curve)
        if by:
            return a.join(p, by).select(F.lit(0).alias("_g"), F.col(example).cast("string").alias("_e"), "auc", "ap")
        one = curve.sparkSession.createDataFrame([(a.first()[0], p.first()[0])], "auc double, ap double")
        return one.select(F.lit(1).alias("_g"), F.lit("").alias("_e"), "auc", "ap")

    metrics = ordered([example]).unionByName(ordered([]))
    keyed = sums.withColumn("_e", F.when(F.col("_g") == 1, "").otherwise(F.col(example).cast("string")))
    return keyed.join(metrics, ["_g", "_e"]).drop("_g", "_e")


def sweep_summary(df: DataFrame, graph: str, mean_col: str, safe_col: str) -> DataFrame:
    """Per graph the mean of one column and the mean of the finite values of another; then the means of both."""
    finite = F.when(~F.isnan(safe_col) & (F.abs(safe_col) != float("inf")), F.col(safe_col))
    per = df.groupBy(graph).agg(F.avg(mean_col).alias("_a"), F.avg(finite).alias("_b"))
    return per.agg(F.avg("_a").alias("mean_abs"), F.avg("_b").alias("mean_safe"), F.count(F.lit(1)).alias("graphs"))


def prediction_report(targets: DataFrame, estimates: DataFrame, key: list[str]) -> DataFrame:
    """Target, estimate and signed error per key (columns ``target`` and ``estimate``)."""
    return targets.join(estimates, key).select(*key, "target", "estimate", (F.col("estimate") - F.col("target")).alias("error"))


def describe_target(df: DataFrame, col: str, by: list[str] = []) -> DataFrame:
    return df.groupBy(*by).agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"),
                               F.stddev_pop(col).alias("std"), F.var_pop(col).alias("variance"), F.count(F.lit(1)).alias("n"))


def distinct_head(df: DataFrame, col: str, by: list[str] = [], n: int = 10, ord_col: str | None = None) -> DataFrame:
    """The first ``n`` distinct values per group with their counts: in order of ``ord_col``'s first place, or the smallest."""
    values = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"), *([F.min(ord_col).alias("_at")] if ord_col else []))
    return first_n(values, by, ["_at", col] if ord_col else [col], n, "place").drop("_at")


def mean_identity(hits: DataFrame, by: list[str], identity: str) -> DataFrame:
    return hits.groupBy(*by).agg(F.avg(identity).alias("mean_identity"))
