"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

Every stage works on all that its predecessor kept. The first four return the columns of
documents; the last returns digests of the ids of each remaining text and of their decoded bytes. A stage deletes what it
staged for itself but for what its result reads, so stages may be chained before any of them has run.

Cases, in every stage: a null text counts as an empty one, which the first stage rejects; equal rows are repeated documents,
of which line dedup keeps the lines once; rows without an id keep it; columns beyond those of documents pass through,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import bpe, decontamination, line_dedup, ngram_join, quality
from tidemill.llm.common import staged, table, temporary

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the weighted votes of the rules reject go."""
    return quality.keep_good(docs)


def fuzzy_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays; documents left without a line go."""
    return line_dedup.remove_lines(docs)


def ngram_jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, Jaccard 0.8 or more) the one with the smallest id stays."""
    return ngram_join.keep_one_each(docs, ngram_join.Similarity(5, 8, 10))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what remains: its ids, and the bytes that they decode to."""
    return bpe.round_trip_digest(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("fuzzy_line_dedup", fuzzy_line_dedup),
    ("ngram_jaccard_dedup", ngram_jaccard_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: Line and document similarity, BM25 retrieval and BPE are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with temporary(spark):
        for name, stage in STAGES[:-1]:
            docs = staged(stage(spark, docs, sf_dir), keep=name == STAGES[-2][0])
    return STAGES[-1][1](spark, docs, sf_dir)
