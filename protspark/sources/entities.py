"""Delimited entity files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from protspark.schemas import ENTITY_COLUMNS


def read_entity_csv(spark: SparkSession, path: str, kind: str | None = None, sep: str = ",") -> DataFrame:
    """Header CSV with every column as text; blanks stay blank, never null.

    Columns are matched by header name. For a known ``kind``, the expected columns come first and any
    extra columns follow; an expected column that the file lacks is left out.
    """
    raw = (spark.read.option("header", True).option("inferSchema", False).option("sep", sep)
           .option("quote", '"').option("escape", '"').csv(path))
    known = [c for c in ENTITY_COLUMNS.get(kind, []) if c in raw.columns]
    extra = [c for c in raw.columns if c not in known]
    return raw.select(*known, *extra).na.fill("")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator of the header line: the most frequent of comma, tab and semicolon."""
    line = spark.read.text(path).limit(1).first()
    text = line[0] if line else ""
    return max([",", "\t", ";"], key=text.count)


def read_table_auto(spark: SparkSession, path: str, sniff: bool = False) -> DataFrame:
    """Delimiter by suffix (``.tsv``/``.txt`` tab, else comma), or from the header when ``sniff``."""
    if sniff:
        sep = sniff_separator(spark, path)
    else:
        sep = "\t" if path.lower().endswith((".tsv", ".txt")) else ","
    return read_entity_csv(spark, path, sep=sep)


def normalize_headers(df: DataFrame, synonyms: dict[str, list[str]], required: list[str] | None = None) -> DataFrame:
    """Rename columns by case-insensitive synonyms; the schema is checked without reading data."""
    target = {s: name for name, words in synonyms.items() for s in words}
    renames = {c: target[c.strip().lower()] for c in df.columns if c.strip().lower() in target}
    renamed = df.withColumnsRenamed(renames)
    missing = [c for c in required or [] if c not in renamed.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return renamed


def apply_mapping(df: DataFrame, mapping: dict) -> DataFrame:
    """Standard variant columns from a mapping: column names, default chain and weight, 1-based positions."""
    def given(key: str):
        return F.col(mapping[key]) if mapping.get(key) and mapping[key] in df.columns else F.lit(None)

    shift = 1 if str(mapping.get("indexing", "")).startswith("1") else 0
    return df.select(
        given("protein_id").cast("string").alias("protein_id"),
        F.coalesce(given("chain_id").cast("string"), F.lit(mapping.get("default_chain"))).alias("chain_id"),
        (given("residue_index").cast("int") - shift).alias("pos"),
        given("wt_col").cast("string").alias("wt"),
        given("mut_col").cast("string").alias("mut"),
        given("label_distal").cast("string").alias("distal"),
        F.lit(mapping.get("evidence_source")).cast("string").alias("evidence"),
        F.lit(mapping.get("default_weight")).cast("double").alias("weight"),
    )
