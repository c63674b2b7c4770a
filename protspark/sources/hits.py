"""Search-hit files: tabular, pairwise text, XML and nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from protspark.functions.skew import first_n
from protspark.schemas import HITS_SCHEMA
from protspark.sources.files import read_lines, stem

HIT_COLUMNS = ["subject", "pident", "alnlen", "qstart", "qend", "evalue", "bits"]


def read_m8(spark: SparkSession, path: str) -> DataFrame:
    """Tabular hits. Short rows keep the subject only; one bad number empties all statistics of its row."""
    c = F.split(F.trim("value"), r"\s+")
    at = lambda k: F.try_element_at(F.col("c"), F.lit(k + 1))
    rows = (read_lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
            .select("path", "ord", c.alias("c")))
    full = F.size("c") >= 12
    numbers = {"pident": (2, "double"), "alnlen": (3, "int"), "qstart": (6, "int"), "qend": (7, "int"),
               "evalue": (10, "double"), "bits": (11, "double")}
    cast = {n: F.when(full, at(k).try_cast(t)) for n, (k, t) in numbers.items()}
    parsed = rows.select("path", "ord", F.when(full, at(0)).alias("query"),
                         F.coalesce(at(1), at(0)).alias("subject"), *[e.alias(n) for n, e in cast.items()])
    good = F.lit(True)
    for n in numbers:
        good = good & F.col(n).isNotNull()
    return parsed.select("path", "ord", "query", "subject", *[F.when(good, F.col(n)).alias(n) for n in numbers])


def read_blast_text(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Aligned rows of pairwise text: blocks joined, gaps as ``-``, hits of unequal length dropped.

    Text before the first ``>`` of a file is the report head and no hit.
    """
    chunks = read_lines(spark, path, separator="\n>")
    first = chunks.groupBy("path").agg(F.min("ord").alias("_first"))
    hits = chunks.join(first, "path").where(F.col("ord") > F.col("_first"))

    def joined(tag: str):
        parts = F.regexp_extract_all("value", F.lit(rf"(?m)^{tag}\s+\S+\s+(\S+)"), F.lit(1))
        return F.upper(F.translate(F.array_join(parts, ""), "._", "--"))

    rows = (hits.select(stem().alias("query"), "ord", F.regexp_extract("value", r"^\s*(\S+)", 1).alias("subject"),
                        joined("Query").alias("qaln"), joined("Sbjct").alias("saln"))
            .where((F.col("qaln") != "") & (F.length("qaln") == F.length("saln"))))
    return first_n(rows, ["query"], ["ord"], max_rows).drop("_rn") if max_rows else rows


def read_blast_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per HSP of an XML report; HSPs without the three needed fields are dropped."""
    schema = "`Hsp_qseq` string, `Hsp_hseq` string, `Hsp_identity` string, `Hsp_align-len` string"
    raw = spark.read.format("xml").option("rowTag", "Hsp").schema(schema).load(path)
    return raw.select(
        F.trim("Hsp_hseq").alias("hseq"), F.trim("Hsp_qseq").alias("qseq"),
        F.col("Hsp_identity").try_cast("int").alias("identity"), F.col("`Hsp_align-len`").try_cast("int").alias("align_len"),
    ).where(F.col("hseq").isNotNull() & F.col("identity").isNotNull() & F.col("align_len").isNotNull())


def read_hits_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Flat hits of nested JSON; a query without hits keeps one row with a null subject.

    One document per line, as ``write_hits_json`` makes them (such files are split), or one document
    per file with ``multi_line``.
    """
    queries = (spark.read.option("multiLine", multi_line).schema(HITS_SCHEMA).json(path)
               .select(F.explode("queries").alias("q")))
    return (queries.select("q.query_id", "q.length", "q.error", F.posexplode_outer("q.hits").alias("ord", "hit"))
            .select("query_id", "length", "error", "ord", *[F.col(f"hit.{c}").alias(c) for c in HIT_COLUMNS]))


def write_hits_json(hits: DataFrame, path: str) -> None:
    """One JSON document per query (``hits`` = its capped hit list), written by the executors."""
    entry = F.struct("ord", F.struct(*HIT_COLUMNS).alias("hit"))
    packed = (hits.groupBy("query_id").agg(F.max("length").alias("length"),
                                           F.array_sort(F.collect_list(F.when(F.col("subject").isNotNull(), entry))).alias("_h"))
              .select(F.array(F.struct("query_id", "length", F.transform("_h", lambda e: e["hit"]).alias("hits"))).alias("queries")))
    packed.write.mode("overwrite").json(path)
