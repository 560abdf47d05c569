"""Registered queries of this folder and their DuckDB equivalents, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, decontamination, licenses, line_dedup, ngram_join, oracles, quality, secrets, sharding, suffix_dedup, toxicity
from tidemill.llm.common import table

#: A passage of over 50 words.
PASSAGE_WORDS = 51

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op2_toxicity_chain")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda n: F.col(f"f.{n}").alias(n)
    judged = quality.judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", f("n_words"), f("word_chars"), f("n_symbols"), f("n_dup_lines"), f("n_repeat_words"), "base_failed", "kept", "p_good")


@query("op4_license_scan", oracles.LICENSES)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup_strings(table(spark, sf_dir, "documents"), passage_words=PASSAGE_WORDS)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeats"), "shares_passage")


@query("op6_fuzzy_lines")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


@query("op8_minimax_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op9_bm25_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_ngram_jaccard", oracles.NGRAM_JOIN)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))
