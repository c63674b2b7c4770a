"""The operators of this subpackage as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from protspark.llm import (byte_index, centroids, credentials, decontaminate, deobfuscate, divergence, fair_mix, fill_in_middle, nbsvm, sentence_pieces,
                           superkmers, wavelet, whitening)
from protspark.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


@query("op1_distribution_divergence")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality_rules(table(spark, sf_dir, "documents"))


@query("op2_simhash_windows", decontaminate.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_credential_linking")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(table(spark, sf_dir, "documents"))


@query("op4_wavelet_matrix")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_documents(table(spark, sf_dir, "documents"))


@query("op5_weighted_fair_queueing", fair_mix.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix_table(table(spark, sf_dir, "documents"))


@query("op6_noisy_channel")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deobfuscate.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_super_kmers", superkmers.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.repeated_words(table(spark, sf_dir, "documents"))


@query("op8_nearest_centroid")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.languages(table(spark, sf_dir, "documents"))


@query("op9_byte_position_index")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_index.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_nb_support_vectors")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_shifted_cholesky_qr")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_swar_units", fill_in_middle.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


@query("op13_vectorised_merges")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"))
