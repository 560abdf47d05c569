"""Order-independent fingerprints of tables and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_line(keys: list[str]) -> F.Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def table_fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of the sorted key lines. One group holds them all: for bounded tables, as batch manifests."""
    lines = F.sort_array(F.collect_list(key_line(keys)))
    return df.agg(F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256).alias("fingerprint"), F.count("*").alias("row_count"))


def bucketed_fingerprint(df: DataFrame, keys: list[str], buckets: int = 256) -> DataFrame:
    """The same idea for tables of any size: key lines hash to buckets, whose sums and counts are hashed in order.

    Sums of hashes are additive, so partial aggregation leaves one row a bucket for the last step.
    """
    digest = F.sha2(key_line(keys), 256)
    part = lambda i: F.conv(F.substring(digest, i, 12), 16, 10).cast("decimal(38,0)")
    hashed = df.select(F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets)).alias("b"), part(9).alias("x"), part(21).alias("y"))
    summed = hashed.groupBy("b").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("n"))
    lines = F.sort_array(F.collect_list(F.struct("b", F.concat_ws(":", "b", "x", "y", "n").alias("line"))))
    return summed.agg(F.sha2(F.array_join(F.transform(lines, lambda s: s["line"]), "\n"), 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"))


def duplicate_content(df: DataFrame, content: str, name: str) -> DataFrame:
    """Groups of two or more rows with one content hash."""
    return df.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min(name).alias("first_name")).where("n > 1")
