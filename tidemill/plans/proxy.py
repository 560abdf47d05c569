"""The example tables seen as the campaign domain: parts are campaigns, suppliers influencers, line items observations.

Used by the registered queries only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import read_table

#: The same views in DuckDB, to start an oracle with.
OBSERVATIONS_SQL = """obs AS (
  SELECT l_partkey AS campaign_id, l_suppkey AS influencer_id,
    CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS selected,
    CASE l_linestatus WHEN 'F' THEN true WHEN 'O' THEN false END AS confirmed,
    l_extendedprice AS fee, l_quantity AS follower, l_discount AS engagement,
    'book_' || CAST(l_orderkey % 12 AS VARCHAR) AS source_filename, l_orderkey, l_linenumber
  FROM lineitem)"""
FACT_SQL = """fact AS (
  SELECT campaign_id, influencer_id, CAST(count(*) AS BIGINT) AS observation_count,
    CASE WHEN count(*) FILTER (WHERE selected) > 0 AND count(*) FILTER (WHERE NOT selected) > 0 THEN 'conflict'
      WHEN count(*) FILTER (WHERE selected) > 0 THEN 'selected' WHEN count(*) FILTER (WHERE NOT selected) > 0 THEN 'not_selected' ELSE 'unknown' END AS selected_status,
    CASE WHEN count(*) FILTER (WHERE confirmed) > 0 AND count(*) FILTER (WHERE NOT confirmed) > 0 THEN 'conflict'
      WHEN count(*) FILTER (WHERE confirmed) > 0 THEN 'confirmed' WHEN count(*) FILTER (WHERE NOT confirmed) > 0 THEN 'not_confirmed' ELSE 'unknown' END AS confirmed_status,
    CASE count(DISTINCT fee) WHEN 0 THEN 'missing' WHEN 1 THEN 'consistent' ELSE 'conflict' END AS fee_status,
    min(fee) AS fee_min, max(fee) AS fee_max, min(follower) AS follower_snapshot_min, max(follower) AS follower_snapshot_max,
    min(engagement) AS engagement_snapshot_min, max(engagement) AS engagement_snapshot_max,
    CAST(count(DISTINCT source_filename) AS BIGINT) AS workbook_count
  FROM obs GROUP BY 1, 2),
fact_dq AS (SELECT *, concat_ws(';', CASE WHEN observation_count > 1 THEN 'DQ_DUPLICATE_CAMPAIGN_INFLUENCER_SOURCE' END,
    CASE WHEN selected_status = 'conflict' THEN 'DQ_SELECTED_STATUS_CONFLICT' END, CASE WHEN confirmed_status = 'conflict' THEN 'DQ_CONFIRMED_STATUS_CONFLICT' END,
    CASE WHEN fee_status = 'conflict' THEN 'DQ_FEE_CONFLICT' END) AS dq_codes FROM fact)"""


def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("influencer_id"),
        F.lit("tiktok").alias("platform"),
        F.lower("s_name").alias("canonical_handle"),
        F.when(F.col("s_suppkey") % 5 == 0, "reviewed_evidence").otherwise("deterministic_exact").alias("identity_confidence"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("campaign_id"), F.col("p_brand").alias("brand_id"), F.col("p_name").alias("campaign_name"), F.col("p_type").alias("campaign_type"), "p_size")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read_table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_partkey").alias("campaign_id"),
        F.col("l_suppkey").alias("influencer_id"),
        F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("selected"),
        F.when(F.col("l_linestatus") == "F", True).when(F.col("l_linestatus") == "O", False).alias("confirmed"),
        F.col("l_extendedprice").alias("fee"),
        F.col("l_quantity").alias("follower"),
        F.col("l_discount").alias("engagement"),
        F.concat(F.lit("book_"), (F.col("l_orderkey") % 12).cast("string")).alias("source_filename"),
        "l_orderkey",
        "l_linenumber",
    )


def deliverables(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, o = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    posted = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return x.join(o, x.l_orderkey == o.o_orderkey).select(F.col("l_suppkey").alias("influencer_id"), F.col("l_partkey").alias("campaign_id"), posted.alias("posted"), "l_orderkey", "l_linenumber")


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read_table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_suppkey").alias("influencer_id"),
        F.col("l_partkey").alias("campaign_id"),
        (F.col("l_quantity") * 100).alias("views"),
        F.when(F.col("l_linenumber") > 1, F.col("l_quantity") * 3).alias("likes"),
        F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).alias("comments"),
        F.lit(None).cast("double").alias("saves"),
        F.lit(None).cast("double").alias("shares"),
        F.col("l_extendedprice").alias("gmv"),
        F.lit(None).cast("double").alias("sales_amount"),
        F.lit(1.0).alias("orders"),
    )
