"""Position mappings from alignments, pair alignment, and template priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from protspark.functions.columns import parse_subject
from protspark.functions.skew import first_n, pair_join, spread
from protspark.operators.geometry import AXES, distance, located
from protspark.schemas import DISTANCE_EDGES

GAP = "-"


def aligned_columns(hits: DataFrame, key: list[str]) -> DataFrame:
    """One row per alignment column with 0-based positions on both sides.

    The window runs over the columns of one alignment, which sit in one row of the input.
    """
    width = F.least(F.length("qaln"), F.length("taln"))
    chars = F.arrays_zip(F.split(F.substring("qaln", 1, 2_147_483_647), "").alias("q"), F.split("taln", "").alias("t"))
    cols = hits.select(*key, "qstart", "tstart", width.alias("_w"), F.posexplode(chars).alias("col", "c")).where(F.col("col") < F.col("_w"))
    w = Window.partitionBy(*key).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    steps = lambda side: F.sum((F.col(f"c.{side}") != GAP).cast("int")).over(w)
    return cols.select(*key, "col", F.col("c.q").alias("q"), F.col("c.t").alias("t"),
                       (F.col("qstart") - 2 + steps("q")).alias("q_idx"), (F.col("tstart") - 2 + steps("t")).alias("t_idx"))


def hit_alignments(hits: DataFrame) -> DataFrame:
    """Accept both spellings of the alignment fields; missing starts are 1."""
    def pick(*names: str) -> Column:
        have = [F.col(n) for n in names if n in hits.columns]
        return F.coalesce(*have) if have else F.lit(None)
    start = lambda *names: F.coalesce(pick(*names).cast("string").try_cast("int"), F.lit(1))
    return hits.withColumns({"qaln": pick("qaln", "q_aln").cast("string"), "taln": pick("taln", "t_aln").cast("string"),
                             "qstart": start("qstart", "q_start"), "tstart": start("tstart", "t_start")})


def map_aligned(hits: DataFrame, key: list[str]) -> DataFrame:
    """``(key, q_idx, t_idx)`` of residue-to-residue columns inside the query (column ``query_len``)."""
    rows = hit_alignments(hits).where(F.col("qaln").isNotNull() & F.col("taln").isNotNull())
    lens = hits.select(*key, "query_len")
    cols = aligned_columns(rows, key).where((F.col("q") != GAP) & (F.col("t") != GAP))
    return (cols.join(lens, key).where((F.col("q_idx") >= 0) & (F.col("q_idx") < F.col("query_len")))
            .select(*key, "q_idx", "t_idx"))


def mapping_stats(hits: DataFrame, key: list[str]) -> DataFrame:
    """Identity over aligned columns and coverage of the query; 0 for hits without an alignment."""
    rows = hit_alignments(hits).where(F.col("qaln").isNotNull() & F.col("taln").isNotNull())
    cols = aligned_columns(rows, key).where((F.col("q") != GAP) & (F.col("t") != GAP))
    inside = (F.col("q_idx") >= 0) & (F.col("q_idx") < F.col("query_len"))
    stats = cols.join(hits.select(*key, "query_len"), key).groupBy(*key).agg(
        F.avg((F.col("q") == F.col("t")).cast("double")).alias("identity"), F.sum(inside.cast("int")).alias("mapped"))
    return (hits.select(*key, "query_len").join(stats, key, "left")
            .select(*key, F.coalesce("identity", F.lit(0.0)).alias("identity"),
                    F.when(F.col("query_len") > 0, F.coalesce("mapped", F.lit(0)) / F.col("query_len")).otherwise(0.0).alias("coverage")))


def project_to_query(hits: DataFrame, key: list[str]) -> DataFrame:
    """Subject letters on query coordinates; query positions without a subject letter are gaps."""
    rows = hit_alignments(hits)
    cols = aligned_columns(rows, key).where((F.col("q") != GAP) & (F.col("t") != GAP)).select(*key, F.col("q_idx").alias("pos"), F.upper("t").alias("_ch"))
    spine = hits.select(*key, F.explode(F.expr("sequence(0, int(query_len) - 1)")).alias("pos"))
    return spine.join(cols, [*key, "pos"], "left").select(*key, "pos", F.coalesce("_ch", F.lit(GAP)).alias("ch"))


# ---- pair alignment ------------------------------------------------------------------------------

# Fixed values: (match, mismatch, gap open, gap extend) of the three scoring schemes.
SCHEMES = {
    "canonical": (2.0, -1.0, -2.0, -0.2),
    "template": (2.0, -1.0, -10.0, -0.5),
    "identity": (1.0, 0.0, 0.0, 0.0),
}


CELLS = 1 << 20  # cells of a score table that is held whole
DIAGONAL, UP, SIDE = range(3)  # steps: both letters, a query letter on a gap, a target letter on a gap


class _Aligner:
    """Global alignment with affine gaps in memory that grows with the sequences, not with their product.

    A table of up to ``CELLS`` cells is traced back (ties prefer the diagonal). A larger one is halved by query rows: the
    scores of the upper half from the start and of the lower half from the end meet in one row, whose best place splits
    the problem in two. A vertical gap may cross that row, so each part knows what the first residue of a gap at its ends costs.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, scheme: tuple[float, float, float, float]) -> None:
        self.match, self.mismatch, self.opening, self.extend = scheme
        self.score, self.steps = self._solve(x, y, self.opening, self.opening)

    def _row(self, fits: np.ndarray, best: np.ndarray, up: np.ndarray, first: float, ramp: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next row's scores: best, ending in a vertical gap, ending in a horizontal gap."""
        new_up = np.maximum(best + self.opening, up + self.extend)
        new_up[0] = first
        base = np.empty_like(best)
        base[0] = first
        np.maximum(best[:-1] + fits, new_up[1:], out=base[1:])
        # A gap along the row may start at any earlier column: a running maximum gives them all at once.
        start = base + (self.opening - self.extend) - ramp
        side = np.full_like(best, -np.inf)
        side[1:] = (np.maximum.accumulate(start) + ramp)[:-1] + self.extend
        return np.maximum(base, side), new_up, side

    def _ends(self, y: np.ndarray, top: float) -> tuple[np.ndarray, ...]:
        best = np.empty(len(y) + 1)
        best[0], best[1:] = 0.0, self.opening + self.extend * np.arange(len(y))
        return best, np.full(len(y) + 1, -np.inf), self.extend * np.arange(len(y) + 1)

    def _fits(self, x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
        return {c: np.where(y == c, self.match, self.mismatch) for c in np.unique(x).tolist()}

    def _last_row(self, x: np.ndarray, y: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
        best, up, ramp = self._ends(y, top)
        fits = self._fits(x, y)
        for r, c in enumerate(x.tolist()):
            best, up, _ = self._row(fits[c], best, up, top + self.extend * r, ramp)
        return best, up

    def _solve(self, x: np.ndarray, y: np.ndarray, top: float, bottom: float) -> tuple[float, list[int]]:
        """Score and steps; ``top`` and ``bottom`` are the costs of the first residue of a vertical gap at the ends."""
        n, m = len(x), len(y)
        if (n + 1) * (m + 1) <= CELLS or n < 2:
            return self._traced(x, y, top, bottom)
        mid = n // 2
        above, above_up = self._last_row(x[:mid], y, top)
        below, below_up = (v[::-1] for v in self._last_row(x[mid:][::-1], y[::-1], bottom))
        apart, across = above + below, above_up + below_up - self.opening + self.extend
        j, k = int(apart.argmax()), int(across.argmax())
        if apart[j] >= across[k] - 1e-9 * max(1.0, abs(across[k])):
            return float(apart[j]), self._solve(x[:mid], y[:j], top, self.opening)[1] + self._solve(x[mid:], y[j:], self.opening, bottom)[1]
        head = self._solve(x[:mid - 1], y[:k], top, self.extend)[1]
        return float(across[k]), head + [UP, UP] + self._solve(x[mid + 1:], y[k:], self.extend, bottom)[1]

    def _traced(self, x: np.ndarray, y: np.ndarray, top: float, bottom: float) -> tuple[float, list[int]]:
        n, m = len(x), len(y)
        best, up, side = (np.empty((n + 1, m + 1)) for _ in range(3))
        best[0], up[0], ramp = self._ends(y, top)
        side[0] = best[0]
        fits = self._fits(x, y)
        for r, c in enumerate(x.tolist()):
            best[r + 1], up[r + 1], side[r + 1] = self._row(fits[c], best[r], up[r], top + self.extend * r, ramp)
        close = lambda p, q: abs(p - q) <= 1e-9 * max(1.0, abs(p))
        last = up[n, m] - self.opening + bottom
        score = max(best[n, m], last)
        steps, r, c = [], n, m
        state = UP if n and last > best[n, m] and not close(last, best[n, m]) else DIAGONAL
        while r or c:
            if state == DIAGONAL:
                if r and c and close(best[r, c], best[r - 1, c - 1] + fits[int(x[r - 1])][c - 1]):
                    r, c = r - 1, c - 1
                    steps.append(DIAGONAL)
                    continue
                state = UP if r and close(best[r, c], up[r, c]) else SIDE
            if state == UP:
                opened = close(up[r, c], best[r - 1, c] + self.opening)
                r -= 1
            else:
                opened = close(side[r, c], best[r, c - 1] + self.opening)
                c -= 1
            steps.append(state)
            if opened:
                state = DIAGONAL
        return float(score), steps[::-1]


def _align(a: str, b: str, scheme: tuple[float, float, float, float]) -> tuple[str, str, float]:
    """Aligned strings and the score."""
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    found = _Aligner(x, y, scheme)
    steps = np.array(found.steps, np.int8)
    sides = []
    for letters, gap in ((x, SIDE), (y, UP)):
        out = np.full(len(steps), ord(GAP), np.uint32)
        out[steps != gap] = letters
        sides.append(out.tobytes().decode("utf-32-le"))
    return sides[0], sides[1], found.score


def align_pairs(pairs: DataFrame, key: list[str], scheme: str = "canonical", query: str = "query", target: str = "target") -> DataFrame:
    """Global alignment of each row's two sequences: ``(key, qaln, taln, score, query_len)``.

    One row is one alignment; the rows are spread first, because few of them can mean much work.
    """
    fields = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in key)
    params = SCHEMES[scheme]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [_align(q, t, params) for q, t in zip(pdf[query], pdf[target])]
            out = pdf[key].copy()
            out["qaln"], out["taln"], out["score"] = ([d[k] for d in done] for k in range(3))
            out["query_len"] = pdf[query].str.len().astype("int32")
            yield out

    rows = pairs.where(F.col(query).isNotNull() & F.col(target).isNotNull()).select(*key, query, target)
    return spread(rows, *key).mapInPandas(run, f"{fields}, qaln string, taln string, score double, query_len int")


# ---- template priors -------------------------------------------------------------------------------

def distance_bin(d: Column, edges: list[float] = DISTANCE_EDGES) -> Column:
    """Index of the half-open bin; beyond the last edge is the last bin."""
    out = F.lit(len(edges) - 2)
    for k in reversed(range(len(edges) - 2)):
        out = F.when(d < edges[k + 1], k).otherwise(out)
    return out


def mapped_pairs(mapping: DataFrame, coords: DataFrame) -> DataFrame:
    """Query position pairs ``qi < qj`` seen in a template with both coordinates, with their distance.

    ``mapping``: query_id, template_id, q_idx, t_idx. ``coords``: template_id, t_idx, x, y, z. A pair
    value is due for every mapped pair, so the result is quadratic in the mapped length; the block join
    spreads that work.
    """
    placed = mapping.join(located(coords), ["template_id", "t_idx"])
    pairs = pair_join(placed, ["query_id", "template_id"], "q_idx", list(AXES))
    return pairs.select("query_id", "template_id", F.col("q_idx_i").alias("qi"), F.col("q_idx_j").alias("qj"), distance().alias("dist"))


def template_priors(mapping: DataFrame, coords: DataFrame, edges: list[float] = DISTANCE_EDGES,
                    max_hits: int | None = None, order: str = "template_id") -> DataFrame:
    """Distance-bin distribution per query pair over all, or the first ``max_hits``, templates: ``(query_id, qi, qj, bin, p)``.

    Only bins that occur are written; a pair that is written is a valid pair.
    """
    used = first_templates(mapping, max_hits, order) if max_hits else mapping
    binned = mapped_pairs(used, coords).withColumn("bin", distance_bin(F.col("dist"), edges))
    counts = binned.groupBy("query_id", "qi", "qj", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("query_id", "qi", "qj")  # at most one row per bin
    return counts.select("query_id", "qi", "qj", "bin", (F.col("n") / F.sum("n").over(w)).alias("p"))


def first_templates(mapping: DataFrame, max_hits: int, order: str = "template_id") -> DataFrame:
    """Rows of the first ``max_hits`` templates per query."""
    ids = mapping.groupBy("query_id", "template_id").agg(F.min(order).alias("_o"))
    keep = first_n(ids, ["query_id"], ["_o", "template_id"], max_hits).select("query_id", "template_id")
    return mapping.join(keep, ["query_id", "template_id"], "left_semi")


def templates_used(mapping: DataFrame, coords: DataFrame) -> DataFrame:
    return (mapping.join(located(coords), ["template_id", "t_idx"], "left_semi")
            .select("query_id", "template_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("templates_used")))


def soft_prior(mapping: DataFrame, coords: DataFrame, bin_edges: list[float] = DISTANCE_EDGES) -> DataFrame:
    """Per pair: ``max 1/(1+(d/8)^2)`` over templates, and a count per first edge with ``d <= edge``."""
    pairs = mapped_pairs(mapping, coords)
    d = F.col("dist")
    first_edge = F.lit(None).cast("int")
    for k in reversed(range(len(bin_edges))):
        first_edge = F.when(d <= bin_edges[k], k).otherwise(first_edge)
    counts = [F.sum((F.col("_e") == k).cast("int")).alias(f"n{k}") for k in range(len(bin_edges))]
    agg = pairs.withColumn("_e", first_edge).groupBy("query_id", "qi", "qj").agg(F.max(1 / (1 + (d / 8.0) ** 2)).alias("prior"), *counts)
    return agg.na.fill(0)


def contact_prior(priors: DataFrame, edges: list[float] = DISTANCE_EDGES, within: float = 8.0) -> DataFrame:
    """Contact probability: the mass of the bins that end at or below ``within``."""
    last = max(k for k in range(len(edges) - 1) if edges[k + 1] <= within)
    return priors.groupBy("query_id", "qi", "qj").agg(F.sum(F.when(F.col("bin") <= last, F.col("p")).otherwise(0.0)).alias("prior"))


def usable_hits(hits: DataFrame, structures: DataFrame, n: int | None = None, order: str = "ord", first: int | None = None) -> DataFrame:
    """Hits per query with a parsable template id whose structure is at hand; the first ``n`` of them if a cap is given.

    ``structures``: column ``code``. ``first`` looks at the first hits only, before availability is checked, so a query
    may then have fewer usable hits than there are.
    """
    rows = hits.withColumn("_p", parse_subject("subject")).where(F.col("_p").isNotNull())
    if first is not None:
        rows = first_n(rows, ["query_id"], [order], first).drop("_rn")
    keyed = rows.select(*hits.columns, F.col("_p.code").alias("code"), F.col("_p.chain").alias("template_chain"))
    usable = keyed.join(structures.select(F.upper("code").alias("code")).distinct(), "code", "left_semi")
    return usable if n is None else first_n(usable, ["query_id"], [order], n).drop("_rn")
