"""Distance joins on residue coordinates."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from protspark.functions.lineage import cut
from protspark.functions.ordered import running_totals
from protspark.functions.skew import first_n, pair_join, salted_join

AXES = ("x", "y", "z")
CROWDED_CELL = 20_000  # points of one grid cell per task
STEP, RUNGS = 2**0.5, 64  # sizes of cubes that are counted, from the cutoff down
TIE = 1e-14  # distances that differ by less may give one score
NEIGHBOURS = list(itertools.product((-1, 0, 1), repeat=3))
# Half of the neighbourhood: every pair of adjacent cells is met from one side only.
HALF = [o for o in NEIGHBOURS if o >= (0, 0, 0)]


def distance(a: str = "_i", b: str = "_j") -> Column:
    return F.sqrt(sum(((F.col(f"{c}{a}") - F.col(f"{c}{b}")) ** 2 for c in AXES), F.lit(0.0)))


def located(df: DataFrame) -> DataFrame:
    """Rows with all three coordinates present and finite."""
    ok = F.lit(True)
    for c in AXES:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return df.where(ok)


def _measured(df: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Add ``_small``: the group has at most ``limit`` points, so one cell is cheaper than neighbour copies."""
    sizes = df.groupBy(*by).agg((F.count(F.lit(1)) <= limit).alias("_small"))
    return df.join(sizes, by)


def _cells(size: float | Column) -> list[Column]:
    """Grid cell of a point; a small group is one cell."""
    return [F.when(F.col("_small"), F.lit(0).cast("long")).otherwise(F.floor(F.col(c) / size).cast("long")).alias(f"_c{c}") for c in AXES]


def _shifted(df: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Repeat each row once per neighbouring cell it must meet; ``_o`` numbers the offset."""
    entry = lambda k: F.struct(*[F.lit(v).alias(c) for c, v in zip(AXES, offsets[k])], F.lit(k).alias("n"))
    every, own = F.array(*[entry(k) for k in range(len(offsets))]), F.array(entry(offsets.index((0, 0, 0))))
    spread = df.withColumn("_s", F.explode(F.when(F.col("_small"), own).otherwise(every)))
    moved = {f"_c{c}": F.col(f"_c{c}") + F.col(f"_s.{c}") for c in AXES}
    return spread.withColumns({**moved, "_o": F.col("_s.n")}).drop("_s", "_small")


def _side(df: DataFrame, by: list[str], cols: list[str], suffix: str) -> list[Column]:
    return [*[F.col(b) for b in by], *[F.col(c).alias(f"{c}{suffix}") for c in (*AXES, *cols)]]


def radius_pairs(points: DataFrame, by: list[str], idx: str, cutoff: float | str, cols: list[str] | None = None,
                 closed: bool = True) -> DataFrame:
    """Unordered pairs ``idx_i < idx_j`` of one group within ``cutoff``, a number or a column with one of each group, with ``dist``.

    Points go to grid cells as wide as the cutoff; each cell meets itself and 13 of its neighbours, so
    every pair is built once. The join key is the cell, so a large group is spread over its cells, and a
    crowded cell is salted. A group with no more points than cells to meet is one cell.
    """
    cols = [idx, *(cols or [])]
    own = [cutoff] if isinstance(cutoff, str) else []
    reach = F.col(cutoff) if own else cutoff
    cell = [f"_c{c}" for c in AXES]
    pts = _measured(located(points).select(*by, *AXES, *cols, *own), by, 2 * len(HALF))
    left = _shifted(pts.select(*_side(pts, by, cols, "_i"), *own, "_small", *_cells(reach)), HALF)
    right = pts.select(*_side(pts, by, cols, "_j"), *_cells(reach))
    joined = salted_join(right, left, [*by, *cell], CROWDED_CELL)
    near = distance() <= reach if closed else distance() < reach
    i, j = F.col(f"{idx}_i"), F.col(f"{idx}_j")
    same_cell = F.col("_o") == HALF.index((0, 0, 0))
    met = joined.where(near & (~same_cell | (i < j)) & (i != j))
    swap = i > j
    ends = [F.when(swap, F.col(f"{c}_j")).otherwise(F.col(f"{c}_i")).alias(f"{c}_i") for c in cols]
    others = [F.when(swap, F.col(f"{c}_i")).otherwise(F.col(f"{c}_j")).alias(f"{c}_j") for c in cols]
    return met.select(*by, *ends, *others, distance().alias("dist"))


def radius_join(left: DataFrame, right: DataFrame, by: list[str], cutoff: float, left_cols: list[str],
                right_cols: list[str], closed: bool = True) -> DataFrame:
    """Pairs of two different point sets within ``cutoff``; the left side meets 27 cells.

    Where the right set of a group has at most 27 points the group is one cell.
    """
    cell = [f"_c{c}" for c in AXES]
    b = _measured(located(right).select(*by, *AXES, *right_cols), by, len(NEIGHBOURS))
    # The sizes of the right side decide for both; a group without right points has no pairs.
    a = located(left).select(*by, *AXES, *left_cols).join(b.groupBy(*by).agg(F.first("_small").alias("_small")), by)
    spread = _shifted(a.select(*_side(a, by, left_cols, "_i"), "_small", *_cells(cutoff)), NEIGHBOURS).drop("_o")
    other = b.select(*_side(b, by, right_cols, "_j"), *_cells(cutoff))
    joined = salted_join(other, spread, [*by, *cell], CROWDED_CELL)
    near = distance() <= cutoff if closed else distance() < cutoff
    return joined.where(near).select(*by, *[f"{c}_i" for c in left_cols], *[f"{c}_j" for c in right_cols], distance().alias("dist"))


def contacts(residues: DataFrame, cutoff: float | str = 8.0, weight: float = 1.0, contact_type: str = "intra_protein",
             by: list[str] = ["model_id"], closed: bool = True, cols: list[str] = []) -> DataFrame:
    """Residue pairs ``i < j`` of a model within ``cutoff``, as contact rows.

    ``cols`` of the residues follow as ``<col>_i`` and ``<col>_j``: joined to a residue once, not to each of its pairs.
    """
    pairs = radius_pairs(residues, by, "idx", cutoff, cols, closed=closed)
    return pairs.select(*by, F.col("idx_i").alias("i"), F.col("idx_j").alias("j"), "dist",
                        F.lit(float(weight)).alias("w"), F.lit(contact_type).alias("contact_type"),
                        *[f"{c}_{end}" for end in "ij" for c in cols])


def _pair_counts(points: DataFrame, by: list[str], idx: str, cutoff: float) -> DataFrame:
    """(by, ``_rung``, ``_pairs``): at least so many pairs of the group lie within ``cutoff / STEP ** _rung``, at -1 at distance zero.

    Points in a cube whose diagonal is a distance are within it; no pair is built. An id counts once.
    """
    once = points.where(F.col(idx).isNotNull()).groupBy(*by, idx).agg(F.min(F.struct(*AXES)).alias("_p")).select(*by, "_p.*")
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("rung"), F.lit(cutoff * 0.577 / STEP**k).alias("side")) for k in range(RUNGS)]))
    cubes = once.withColumn("_s", at).where(F.greatest(*[F.abs(c) for c in AXES]) < F.col("_s.side") * 2.0**40)  # else the quotient is no cell
    cubes = cubes.groupBy(*by, F.col("_s.rung").alias("_rung"), *[F.floor(F.col(c) / F.col("_s.side")).alias(f"_c{c}") for c in AXES]).count()
    places = once.groupBy(*by, F.lit(-1).alias("_rung"), *AXES).count()
    n = F.col("count").cast("double")
    return cubes.select(*by, "_rung", "count").unionByName(places.select(*by, "_rung", "count")).where("count > 1").groupBy(*by, "_rung").agg(F.sum(n * (n - 1) / 2).alias("_pairs"))


def _first_copies(points: DataFrame, by: list[str], want: str) -> DataFrame:
    """The pairs at one place that may be among the group's first ``want`` by (i, j): those of its first ids, counted before they are built."""
    rows = points.where(F.col("idx").isNotNull())
    here = running_totals(rows.groupBy(*by, *AXES, "idx", want).agg(F.count(F.lit(1)).alias("_m")), [*by, *AXES], [F.col("idx")], {"_upto": F.col("_m")})
    sizes = here.groupBy(*by, *AXES).agg(F.sum("_m").alias("_all"))
    pairs = here.join(sizes, [*by, *AXES]).groupBy(*by, "idx", want).agg(F.sum(F.col("_m") * (F.col("_all") - F.col("_upto"))).alias("_pairs"))
    first = running_totals(pairs.where("_pairs > 0"), by, [F.col("idx")], {"_total": F.col("_pairs")}).where(F.col("_total") - F.col("_pairs") < F.col(want))
    lead = rows.join(first.select(*by, "idx"), [*by, "idx"], "left_semi").select(*by, *AXES, F.col("idx").alias("i"))
    met = salted_join(rows.select(*by, *AXES, F.col("idx").alias("j")), lead, [*by, *AXES], CROWDED_CELL)
    return met.where("i < j").select(*by, "i", "j", F.lit(0.0).alias("dist"))


def _tied_places(points: DataFrame, by: list[str]) -> DataFrame:
    """Pairs at different places that are so near that their scores may equal those of copies."""
    places = points.select(*by, *AXES).distinct().withColumns({"_place": F.struct(*AXES), "_reach": F.lit(TIE)})
    near = radius_pairs(places, by, "_place", "_reach")
    end = lambda c: points.select(*by, F.struct(*AXES).alias(f"_place_{c}"), F.col("idx").alias(c))
    met = near.join(end("i"), [*by, "_place_i"]).join(end("j"), [*by, "_place_j"]).where("i != j")
    return met.select(*by, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "dist")


def closest_contacts(residues: DataFrame, wanted: DataFrame, want: str, cutoff: float = 8.0, by: list[str] = ["model_id"]) -> DataFrame:
    """Contacts of a model that hold its first ``want`` ones by (dist, i, j): ``(by, i, j, dist)``, about as many as wanted.

    ``wanted`` has a row per model. Cubes of ``RUNGS`` sizes are counted first, and only pairs within the smallest size that
    surely holds enough are built, so the work follows the points and what is wanted, not the square of a crowd. Where the
    copies at one place are enough, their pairs are counted per id and those of the first ids built.
    """
    pts = cut(located(residues).select(*by, "idx", *AXES).join(wanted.select(*by, F.greatest(want, F.lit(1)).alias("_want")), by))
    enough = (_pair_counts(pts, by, "idx", cutoff).join(wanted.select(*by, F.greatest(want, F.lit(1)).alias("_want")), by).where("_pairs >= _want")
              .groupBy(*by).agg(F.max("_rung").alias("_rung"), (F.min("_rung") < 0).alias("_copies")))
    known = cut(pts.join(enough, by, "left"))
    copies, others = known.where("_copies"), known.where(~F.coalesce("_copies", F.lit(False)))
    # A little wider, so that no pair is lost whose rounded score equals that of a pair within.
    reach = F.least(F.lit(cutoff), F.pow(F.lit(STEP), -F.greatest("_rung", F.lit(0))) * cutoff * (1 + 1e-9) + TIE)
    near = contacts(others.withColumn("_reach", F.coalesce(reach, F.lit(cutoff))), "_reach", by=by).select(*by, "i", "j", "dist")
    if copies.isEmpty():
        return cut(near)
    return cut(near.unionByName(_first_copies(copies, by, "_want")).unionByName(_tied_places(copies, by)))


def contact_labels(residues: DataFrame, thr: float = 8.0, closed: bool = True, dense: bool = False,
                   by: list[str] = ["model_id"]) -> DataFrame:
    """Contact label ``y`` per valid pair ``i < j`` (both coordinates known).

    Sparse by default: only the pairs with ``y = 1``; the rest of the valid pairs are 0 (their number is
    in ``valid_pairs``). ``dense`` writes every valid pair, by block join.
    """
    if not dense:
        return contacts(residues, thr, by=by, closed=closed).select(*by, "i", "j", F.lit(1).alias("y"))
    pairs = pair_join(located(residues), by, "idx", list(AXES))
    near = distance() <= thr if closed else distance() < thr
    return pairs.select(*by, F.col("idx_i").alias("i"), F.col("idx_j").alias("j"), near.cast("int").alias("y"))


def valid_pairs(residues: DataFrame, by: list[str] = ["model_id"]) -> DataFrame:
    """Residues, located residues and valid pairs ``m(m-1)/2`` per model."""
    known = F.lit(True)
    for c in AXES:
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    m = F.sum(known.cast("long"))
    return residues.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), m.alias("located"), (m * (m - 1) / 2).cast("long").alias("valid"))


def inter_contacts(residues: DataFrame, thr: float = 8.0, closed: bool = True) -> DataFrame:
    """Contacts between two chains ``chain_a < chain_b`` of one model."""
    a = residues.select("model_id", "chain", "idx", *AXES)
    met = radius_join(a, a, ["model_id"], thr, ["chain", "idx"], ["chain", "idx"], closed)
    return met.where(F.col("chain_i") < F.col("chain_j")).select(
        "model_id", F.col("chain_i").alias("chain_a"), F.col("idx_i").alias("i"), F.col("chain_j").alias("chain_b"), F.col("idx_j").alias("j"), "dist")


def concat_chains(residues: DataFrame) -> DataFrame:
    """Global index over the sorted chains of a model: ``gidx`` = offset of the chain + position, and ``chain_no``."""
    from pyspark.sql.window import Window

    # One row per chain: the window holds the chains of one model, not its residues.
    sizes = residues.groupBy("model_id", "chain").agg((F.max("idx") + 1).alias("len"))
    w = Window.partitionBy("model_id").orderBy("chain")
    offsets = sizes.select("model_id", "chain", (F.sum("len").over(w) - F.col("len")).alias("offset"), (F.row_number().over(w) - 1).alias("chain_no"))
    return residues.join(offsets, ["model_id", "chain"]).withColumn("gidx", F.col("offset") + F.col("idx"))


def complex_contacts(residues: DataFrame, thr: float = 8.0, include_inter: bool = False) -> DataFrame:
    """Contacts over the concatenated chains; cross-chain pairs only on request."""
    placed = concat_chains(residues)
    pairs = radius_pairs(placed.drop("idx").withColumnRenamed("gidx", "idx"), ["model_id"], "idx", thr, ["chain_no"])
    kept = pairs if include_inter else pairs.where(F.col("chain_no_i") == F.col("chain_no_j"))
    return kept.select("model_id", F.col("idx_i").alias("i"), F.col("idx_j").alias("j"), "chain_no_i", "chain_no_j", "dist")


def neighbours(residues: DataFrame, topk: int = 6, min_sep: int = 2, by: str = "model_id") -> DataFrame:
    """The ``topk`` nearest residues ``j`` of each residue ``i`` with ``|i-j| >= min_sep``, ties by ``j``.

    Growing grids: with cells of width h, all points within h lie in the 27 cells around a point. A
    point is done when its k-th valid neighbour is within h; the others try again with 2h. So dense
    places finish with small cells and no model is joined with itself as a whole. Of points at the very
    same place only the first ``topk + 2*min_sep - 1`` can be anyone's neighbours, so only they are
    candidates.
    """
    pts = cut(located(residues).select(by, F.col("idx").cast("long").alias("idx"), *AXES))
    candidates = first_n(pts, [by, *AXES], ["idx"], topk + 2 * min_sep - 1).drop("_rn")
    box = pts.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), *[(F.max(c) - F.min(c)).alias(f"_d{c}") for c in AXES])
    span = F.greatest(*[F.col(f"_d{c}") for c in AXES])
    volume = F.lit(1.0)
    for c in AXES:
        volume = volume * F.greatest(F.col(f"_d{c}"), span / 1000, F.lit(1e-9))
    box = cut(box.select(by, span.alias("_span"), F.pow(volume / F.col("_n"), F.lit(1 / 3)).alias("_h0"), (F.col("_n") <= len(NEIGHBOURS)).alias("_small")))
    sized = cut(candidates.join(box, by))
    open_points, done, scale = pts.join(box, by), [], 1.0
    while True:
        h = F.col("_h0") * scale
        covered = F.col("_small") | (F.col("_h0") * scale >= 2 * F.col("_span"))
        left = _shifted(open_points.select(by, "idx", *AXES, "_h0", covered.alias("_all"), "_small", *_cells(h)), NEIGHBOURS).drop("_o")
        left = left.select(by, F.col("idx").alias("i"), *[F.col(c).alias(f"{c}_i") for c in AXES], "_h0", "_all", *[f"_c{c}" for c in AXES])
        right = sized.select(by, F.col("idx").alias("j"), *[F.col(c).alias(f"{c}_j") for c in AXES], *_cells(h))
        met = (salted_join(right, left, [by, *[f"_c{c}" for c in AXES]], CROWDED_CELL)
               .where(F.abs(F.col("i") - F.col("j")) >= min_sep)
               .select(by, "i", "j", distance().alias("dist"), "_h0", "_all"))
        best = cut(first_n(met, [by, "i"], ["dist", "j"], topk, "rank"))
        # Complete: k found within the guaranteed radius, or the radius covers the whole model.
        state = best.groupBy(by, "i").agg(F.sum((F.col("dist") <= F.col("_h0") * scale).cast("int")).alias("_sure"),
                                          F.max("_all").alias("_all"))
        closed_now = state.where((F.col("_sure") >= topk) | F.col("_all")).select(by, "i")
        done.append(best.join(closed_now, [by, "i"], "left_semi").select(by, "i", "j", "dist", "rank"))
        rest = open_points.join(closed_now.withColumnRenamed("i", "idx"), [by, "idx"], "left_anti").where(~covered)
        open_points = cut(rest)
        if open_points.isEmpty():
            break
        scale *= 2.0
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def knn_graph(residues: DataFrame, topk: int = 6, min_sep: int = 2, sigma: float = 8.0, by: str = "model_id") -> DataFrame:
    """Undirected union of the nearest-neighbour lists with ``w = exp(-d^2 / 2 sigma^2)``."""
    found = neighbours(residues, topk, min_sep, by)
    return (found.groupBy(by, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("dist").alias("dist"))
            .withColumn("w", F.exp(-F.col("dist") ** 2 / (2 * sigma ** 2))))


def knn_from_scores(scores: DataFrame, topk: int = 6, min_sep: int = 2, by: str = "graph_id") -> DataFrame:
    """The same graph from pair scores (both directions given): top scores, ``dist = 1/max(s, 1e-6)``."""
    valid = scores.where((F.abs(F.col("i") - F.col("j")) >= min_sep) & F.col("score").isNotNull() & ~F.isnan("score")
                         & (F.abs("score") != float("inf")))
    best = first_n(valid, [by, "i"], [F.desc("score"), F.col("j")], topk)
    return (best.groupBy(by, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("score").alias("w"))
            .withColumn("dist", 1.0 / F.greatest(F.col("w"), F.lit(1e-6))))


def ligand_contacts(ca: DataFrame, ligand: DataFrame, cutoff: float = 4.0) -> DataFrame:
    """Distinct residues whose alpha carbon is within ``cutoff`` of a ligand atom."""
    met = radius_join(ca, ligand, ["model_id"], cutoff, ["idx"], [])
    return met.select("model_id", F.col("idx_i").alias("idx")).distinct()


def hbond_pairs(protein: DataFrame, ligand: DataFrame, cutoff: float = 3.5, limit: int | None = None) -> DataFrame:
    """N/O atom pairs of ligand and protein within ``cutoff``; all, or the first ``limit`` per model."""
    polar = lambda df: df.where(F.upper("element").isin("N", "O"))
    met = radius_join(polar(ligand), polar(protein), ["model_id"], cutoff, ["idx"], ["idx"])
    out = met.select("model_id", F.col("idx_i").alias("ligand_idx"), F.col("idx_j").alias("protein_idx"), "dist")
    return first_n(out, ["model_id"], ["ligand_idx", "protein_idx"], limit).drop("_rn") if limit else out


def canonical_positions(contact_rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Re-key ``i`` and ``j`` by ``mapping`` (model_id, idx, pos); unmapped indices become ``idx + 1``."""
    out = contact_rows
    for end in ("i", "j"):
        m = mapping.select("model_id", F.col("idx").alias(end), F.col("pos").alias(f"_{end}"))
        out = out.join(m, ["model_id", end], "left").withColumn(f"{end}_pos", F.coalesce(f"_{end}", F.col(end) + 1)).drop(f"_{end}")
    return out


def long_range(pairs: DataFrame, min_sep: int = 6) -> DataFrame:
    return pairs.where(F.col("j") - F.col("i") >= min_sep)
