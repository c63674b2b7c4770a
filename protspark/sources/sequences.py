"""FASTA, A3M and aligned-FASTA scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from protspark.functions.ordered import ranked
from protspark.functions.skew import first_n
from protspark.sources.files import read_lines, stem


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA-like files: ``(path, ord, header, seq)``, split at ``>`` by the text reader."""
    chunk = F.regexp_replace("value", "\r", "")
    text = F.regexp_replace(chunk, r"^\s*>", "")
    header = F.trim(F.substring_index(text, "\n", 1))
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise("")
    return (read_lines(spark, path, separator="\n>")
            .select("path", "ord", header.alias("header"), F.regexp_replace(body, r"\s*\n\s*", "").alias("seq"))
            .select("path", "ord", "header", F.trim("seq").alias("seq"))
            .where((F.col("header") != "") | (F.col("seq") != "")))


def read_fasta(spark: SparkSession, path: str, id_mode: str = "line") -> DataFrame:
    """``(path, ord, name, seq)``; empty sequences are dropped, unnamed records become ``seq_<n>``.

    ``id_mode``: ``line`` keeps the whole header, ``token`` its first word.
    """
    name = F.col("header") if id_mode == "line" else F.regexp_extract("header", r"^(\S*)", 1)
    named = read_records(spark, path).where(F.col("seq") != "").select("path", "ord", name.alias("name"), "seq")
    if named.where(F.col("name") == "").isEmpty():
        return named
    placed = ranked(named, [], [F.col("path"), F.col("ord")], "_n")
    return placed.select("path", "ord", F.when(F.col("name") == "", F.concat(F.lit("seq_"), F.col("_n"))).otherwise(F.col("name")).alias("name"), "seq")


def _with_query_width(rows: DataFrame) -> DataFrame:
    """Keep the rows as wide as the first row of their file."""
    first = rows.groupBy("path").agg(F.min_by(F.length("seq"), F.col("ord")).alias("_width"))
    return rows.join(first, "path").where(F.length("seq") == F.col("_width")).drop("_width")


def read_a3m(spark: SparkSession, path: str) -> DataFrame:
    """A3M rows with insertions (lower case) removed; the first record of a file is the query."""
    rows = read_records(spark, path).withColumn("seq", F.regexp_replace("seq", "[^A-Z-]", ""))
    return _with_query_width(rows).select(stem().alias("msa_id"), "ord", F.col("header").alias("name"), "seq")


def read_aligned_fasta(spark: SparkSession, path: str, max_seqs: int | None = None) -> DataFrame:
    """Aligned rows with insertions kept: ``.``/``_`` become ``-``, letters upper; all rows, or the first ``max_seqs``."""
    rows = read_records(spark, path).where(F.col("seq") != "").withColumn("seq", F.upper(F.translate("seq", "._", "--")))
    wide = _with_query_width(rows)
    kept = first_n(wide, ["path"], ["ord"], max_seqs) if max_seqs else wide
    return kept.select(stem().alias("msa_id"), "ord", F.col("header").alias("name"), "seq")
