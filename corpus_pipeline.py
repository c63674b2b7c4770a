"""A training-data pipeline: toxicity, near-duplicates, benchmark leaks, source mix, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet in the session's
shared folder and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from protspark.functions.lineage import shared_folder
from protspark.llm import byte_index, decontaminate, deobfuscate, fair_mix, wavelet
from protspark.llm.common import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return deobfuscate.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (op9's fingerprints and byte-position index) the document with the smallest id stays."""
    return byte_index.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix of sources takes them."""
    return fair_mix.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet-matrix shards in the shared folder, and every document read back from them."""
    return wavelet.encode_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("token_output", token_output)]

#: Two stages score with trained models and one counts tokens of a library, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
