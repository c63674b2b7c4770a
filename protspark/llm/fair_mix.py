"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their id and queue up. A document's virtual finish time is the number
of words its source has served when it is done, divided by the source's target, so all sources reach their targets
at time 1. A source whose target exceeds its size queues its documents again. All queues are sorted together by
finish time, over ranges, and cut off at the total budget. Only whole documents are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from protspark.functions.lineage import cut
from protspark.llm.common import LOWEST, id_of, key_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> dict:
    """Target words per source: the share of all words by weight, at most ``epochs`` times a source's size.

    Weights repeat over the sources in code point order, null last. What a source cannot take is shared again among
    the others by weight until no source is above its limit.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(float(epochs * sizes[s]) for s in full)
        parts = sum(weight[s] for s in names if s not in full)
        out = {s: float(epochs * sizes[s]) if s in full else weight[s] * rest / parts for s in names}
        over = {s for s in names if s not in full and out[s] > epochs * sizes[s]}
        if not over:
            return out
        full |= over


def running_sum(df: DataFrame, by: list[str], order: list[str | Column], value: str, name: str) -> DataFrame:
    """Inclusive running sum per group without ever holding a group in one task: ranges, local sums, offsets."""
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    parts = cut(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    sums = parts.groupBy("_range", *by).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", *by, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (parts.withColumn("_local", F.sum(value).over(local)).join(offsets, ["_range", *by])
            .withColumn(name, F.col("_local") + F.col("_before")).drop("_range", "_local", "_before"))


def _sized(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their size and source number, the source table, and the budget in words."""
    spark: SparkSession = docs.sparkSession
    rows = cut(docs.select(key_of().alias("key"), F.xxhash64("text", "source").alias("tie"), F.col("source").cast("string").alias("source"),
                           F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    sizes = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("size")).collect()}  # one number per source
    goal = targets(sizes) if sizes else {}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    table = spark.createDataFrame([(k, s, sizes[s], goal[s]) for k, s in enumerate(names)], "src int, _name string, source_size long, target double")
    rows = rows.join(table, rows["source"].eqNullSafe(table["_name"])).drop("_name", "source")
    return rows, table, int(SHARE * sum(sizes.values()))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document with ``copies``, the times the mix takes it; keys, sizes and targets beside it."""
    rows, _, budget = _sized(docs)
    rows = cut(rows)
    shuffled = F.md5(F.concat_ws("-", F.coalesce(F.when(F.col("key") != LOWEST, F.col("key").cast("string")), F.lit("null")), F.lit(SEED)))
    queue = running_sum(rows.where("size > 0").withColumn("shuffled", shuffled), ["src"], ["shuffled", "key", "tie", "row"], "size", "served")
    again = queue.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))))
    timed = again.select("row", "src", "shuffled", "key", "tie", "epoch", "size",
                         ((F.col("epoch") * F.col("source_size") + F.col("served")) / F.col("target")).alias("finish"))
    order = ["finish", "src", "epoch", "shuffled", "key", "tie", "row"]
    taken = running_sum(timed, [], order, "size", "total").where(F.col("total") <= budget).groupBy("row").agg(F.count("*").alias("copies"))
    return rows.join(taken, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))


def mix_table(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    Null and empty texts have size 0 and are never taken; a source of such texts alone has target 0. Equal rows
    queue apart. An empty table gives an empty result. Reruns give the same result.
    """
    return mix(docs).select(id_of("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them."""
    copies = mix(docs).groupBy("key", "tie").agg(F.sum("copies").alias("_n")).where("_n > 0").select(F.col("key").alias("_k"), F.col("tie").alias("_t"), "_n")
    keyed = docs.select(key_of().alias("_key"), F.xxhash64("text", "source").alias("_tie"), F.struct(*docs.columns).alias("_row"))
    once = keyed.join(copies, (F.col("_key") == F.col("_k")) & (F.col("_tie") == F.col("_t"))).dropDuplicates(["_key", "_tie"])
    return (once.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
            .select(*[F.col("_row")[c].alias(c) for c in docs.columns]))


SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS src FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size / w AS reach, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
f AS (SELECT a.source, a.source_size, a.w, a.src, a.total,
             a.reach < (a.total - coalesce(sum(2.0::DOUBLE * b.source_size) FILTER (b.reach < a.reach), 0)) / sum(b.w) FILTER (b.reach >= a.reach) AS is_full
      FROM r a, r b GROUP BY a.source, a.source_size, a.w, a.src, a.total, a.reach),
g AS (SELECT *, total - coalesce(sum(2.0::DOUBLE * source_size) FILTER (is_full) OVER (), 0) AS rest, sum(w) FILTER (NOT is_full) OVER () AS parts FROM f),
t AS (SELECT source, source_size, src, total, CASE WHEN is_full THEN 2.0::DOUBLE * source_size ELSE w * rest / parts END AS target FROM g),
q AS (SELECT d.doc_id, d.size, t.*, md5(coalesce(d.doc_id::VARCHAR, 'null') || '-mix-1') AS h FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY src ORDER BY h, doc_id) AS served FROM q WHERE size > 0),
e AS (SELECT *, ((n * source_size + served)::DOUBLE) / target AS finish FROM c, (VALUES (0), (1)) AS v(n)),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, src, n, h, doc_id ROWS UNBOUNDED PRECEDING) AS so_far FROM e),
k AS (SELECT doc_id, count(*) AS copies FROM o WHERE so_far <= floor(total) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, (coalesce(k.copies, 0) * q.size)::BIGINT AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""
