"""Historical features: one row a master, from pre-aggregated facts, deliverables and performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.plans.history import campaign_facts
from tidemill.plans.proxy import FACT_SQL, OBSERVATIONS_SQL, deliverables, masters, observations, performance, registry

INTERACTIONS = ["likes", "comments", "saves", "shares"]
#: The governed features: name, meaning.
CONTRACT = {
    "campaign_count": "distinct campaigns with a fact",
    "brand_count": "distinct brands of those campaigns; blank brands don't count",
    "selected_rate": "selected over known selection outcomes",
    "confirmed_rate": "confirmed over known confirmations",
    "fee_observed_median": "exact median of consistent fees",
    "follower_observed_median": "exact median of both ends of each fact's follower range",
    "engagement_observed_median": "exact median of both ends of each fact's engagement range",
    "posted_rate": "posted over known deliverables",
    "views_total": "sum of views, 0 without",
    "views_median": "exact median of views",
    "weighted_content_engagement_rate": "interactions over views, where views are positive and an interaction is known",
    "gmv_observed_median": "exact median of gross merchandise value",
    "sales_observed_median": "exact median of sales",
    "orders_observed_median": "exact median of orders",
}


def rate(true: Column, known: Column) -> Column:
    return F.when(known > 0, true / known)


def fact_features(facts: DataFrame, campaigns: DataFrame, keys: list[str]) -> DataFrame:
    """Features from campaign facts, a row for each of `keys`."""
    joined = facts.join(campaigns.select("campaign_id", "brand_id"), "campaign_id", "left")
    status = lambda column, value: F.count_if(F.col(column) == value)
    fee = F.when((F.col("fee_status") == "consistent") & (F.abs(F.col("fee_min") - F.col("fee_max")) < 1e-9), F.col("fee_min"))

    def range_features(name: str) -> list[Column]:
        low, high = F.col(f"{name}_snapshot_min"), F.col(f"{name}_snapshot_max")
        both = F.flatten(F.collect_list(F.array_compact(F.array(low, high))))
        ordered = F.array_sort(both)
        n = F.size(ordered)
        middle = (F.try_element_at(ordered, ((n + 1) / 2).cast("int")) + F.try_element_at(ordered, (n / 2 + 1).cast("int"))) / 2
        return [F.min(low).alias(f"{name}_observed_min"), middle.alias(f"{name}_observed_median"), F.max(high).alias(f"{name}_observed_max")]

    out = joined.groupBy(*keys).agg(
        F.count_distinct("campaign_id").alias("campaign_count"),
        F.count_distinct(F.nullif(F.col("brand_id"), F.lit(""))).alias("brand_count"),
        status("selected_status", "selected").alias("selected_campaign_count"),
        (status("selected_status", "selected") + status("selected_status", "not_selected")).alias("selected_known_campaign_count"),
        status("confirmed_status", "confirmed").alias("confirmed_campaign_count"),
        (status("confirmed_status", "confirmed") + status("confirmed_status", "not_confirmed")).alias("confirmed_known_campaign_count"),
        status("campaign_history_dq_status", "WARN").alias("campaign_history_dq_warn_count"),
        F.count(fee).alias("fee_known_campaign_count"),
        F.min(fee).alias("fee_observed_min"),
        F.median(fee).alias("fee_observed_median"),
        F.max(fee).alias("fee_observed_max"),
        *range_features("follower"),
        *range_features("engagement"),
    )
    return out.withColumns(
        {
            "selected_rate": rate(F.col("selected_campaign_count"), F.col("selected_known_campaign_count")),
            "confirmed_rate": rate(F.col("confirmed_campaign_count"), F.col("confirmed_known_campaign_count")),
        }
    )


def deliverable_features(rows: DataFrame, keys: list[str]) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.count("*").alias("deliverable_count"), F.count("posted").alias("posted_known_deliverable_count"), F.count_if("posted").alias("posted_deliverable_count"))
    return out.withColumn("posted_rate", rate(F.col("posted_deliverable_count"), F.col("posted_known_deliverable_count")))


def performance_features(rows: DataFrame, keys: list[str]) -> DataFrame:
    known = F.array_compact(F.array(*INTERACTIONS))
    counts = (F.col("views") > 0) & (F.size(known) > 0)
    total = F.when(counts, F.aggregate(known, F.lit(0.0), lambda a, x: a + x))
    measures = []
    for column, prefix in (("gmv", "gmv"), ("sales_amount", "sales"), ("orders", "orders")):
        measures += [F.count(column).alias(f"{prefix}_record_count"), F.median(column).alias(f"{prefix}_observed_median"), F.max(column).alias(f"{prefix}_observed_max")]
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("performance_record_count"),
        F.count_distinct("campaign_id").alias("performance_campaign_count"),
        F.count("views").alias("views_record_count"),
        F.coalesce(F.sum("views"), F.lit(0.0)).alias("views_total"),
        F.avg("views").alias("views_average"),
        F.median("views").alias("views_median"),
        F.max("views").alias("views_max"),
        F.count(total).alias("interaction_record_count"),
        F.coalesce(F.sum(total), F.lit(0.0)).alias("interactions_total"),
        F.sum(F.when(counts, F.col("views"))).alias("interaction_views"),
        *measures,
    )
    return out.withColumn("weighted_content_engagement_rate", rate(F.col("interactions_total"), F.col("interaction_views"))).drop("interaction_views")


COUNTS = [
    "campaign_count", "brand_count", "selected_campaign_count", "selected_known_campaign_count", "confirmed_campaign_count", "confirmed_known_campaign_count", "campaign_history_dq_warn_count",
    "fee_known_campaign_count", "deliverable_count", "posted_known_deliverable_count", "posted_deliverable_count", "performance_record_count", "performance_campaign_count", "views_record_count",
    "interaction_record_count", "gmv_record_count", "sales_record_count", "orders_record_count",
]


def historical_features(people: DataFrame, campaigns: DataFrame, facts: DataFrame, delivered: DataFrame, performed: DataFrame) -> DataFrame:
    """One row of every master; facts of others are dropped; counts and totals are 0, other features null, without evidence."""
    key = ["influencer_id"]
    joined = people.join(fact_features(facts, campaigns, key), key, "left").join(deliverable_features(delivered, key), key, "left").join(performance_features(performed, key), key, "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in COUNTS} | {c: F.coalesce(c, F.lit(0.0)) for c in ("views_total", "interactions_total")})
    return filled.withColumns(
        {
            "has_campaign_history": F.col("campaign_count") > 0,
            "has_performance_history": F.col("performance_record_count") > 0,
            "has_fee_history": F.col("fee_known_campaign_count") > 0,
            "has_post_history": F.col("posted_known_deliverable_count") > 0,
        }
    )


def features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the example tables."""
    return historical_features(masters(spark, sf_dir), registry(spark, sf_dir), campaign_facts(observations(spark, sf_dir)), deliverables(spark, sf_dir), performance(spark, sf_dir))


def contract_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONTRACT.items()), "feature string, meaning string")


FEATURES_SQL = f"""WITH {OBSERVATIONS_SQL}, {FACT_SQL},
  fb AS (SELECT f.*, p_brand AS brand_id, CASE WHEN fee_status = 'consistent' AND abs(fee_min - fee_max) < 1e-9 THEN fee_min END AS fee1 FROM fact_dq f LEFT JOIN part ON p_partkey = campaign_id),
  ff AS (SELECT influencer_id, count(DISTINCT campaign_id) AS campaign_count, count(DISTINCT brand_id) AS brand_count, count(*) FILTER (WHERE selected_status = 'selected') AS sel, count(*) FILTER (WHERE selected_status IN ('selected', 'not_selected')) AS selk,
    count(*) FILTER (WHERE dq_codes <> '') AS warn, count(fee1) AS fees, median(fee1) AS fee_median FROM fb GROUP BY 1),
  fv AS (SELECT influencer_id, median(v) AS follower_median FROM (SELECT influencer_id, follower_snapshot_min AS v FROM fact UNION ALL SELECT influencer_id, follower_snapshot_max FROM fact) GROUP BY 1),
  dd AS (SELECT l_suppkey AS influencer_id, count(*) AS n, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
  pp AS (SELECT l_suppkey AS influencer_id, count(*) AS n, median(l_quantity * 100) AS vm, sum(l_quantity * 100) AS vt, median(l_extendedprice) AS gm,
    sum(CASE WHEN l_linenumber > 1 THEN l_quantity * 3 + CASE WHEN l_linenumber > 2 THEN l_quantity ELSE 0 END END) AS it, sum(CASE WHEN l_linenumber > 1 THEN l_quantity * 100 END) AS iv FROM lineitem GROUP BY 1),
  features AS (SELECT s_suppkey AS influencer_id, lower(s_name) AS canonical_handle, CASE WHEN s_suppkey % 5 = 0 THEN 'reviewed_evidence' ELSE 'deterministic_exact' END AS identity_confidence,
    coalesce(campaign_count, 0) AS campaign_count, coalesce(brand_count, 0) AS brand_count, coalesce(selk, 0) AS selk, CASE WHEN selk > 0 THEN sel / selk END AS selected_rate, coalesce(warn, 0) AS warn, coalesce(fees, 0) AS fees, fee_median,
    follower_median, coalesce(k, 0) AS postk, CASE WHEN k > 0 THEN t / k END AS posted_rate, coalesce(pp.n, 0) AS perf, vm AS views_median, coalesce(vt, 0) AS views_total, gm AS gmv_median, CASE WHEN iv > 0 THEN it / iv END AS engagement_rate
    FROM supplier LEFT JOIN ff ON s_suppkey = ff.influencer_id LEFT JOIN fv ON s_suppkey = fv.influencer_id LEFT JOIN dd ON s_suppkey = dd.influencer_id LEFT JOIN pp ON s_suppkey = pp.influencer_id)"""


@query(
    "historical_features",
    FEATURES_SQL
    + """ SELECT influencer_id, canonical_handle, CAST(campaign_count AS BIGINT) AS campaign_count, CAST(brand_count AS BIGINT) AS brand_count, round(selected_rate, 6) AS selected_rate, CAST(warn AS BIGINT) AS campaign_history_dq_warn_count,
    CAST(fees AS BIGINT) AS fee_known_campaign_count, round(fee_median, 3) AS fee_observed_median, round(follower_median, 3) AS follower_observed_median, round(posted_rate, 6) AS posted_rate, round(views_median, 3) AS views_median,
    round(views_total, 1) AS views_total, round(gmv_median, 3) AS gmv_observed_median, round(engagement_rate, 6) AS weighted_content_engagement_rate FROM features""",
)
def features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c, n: F.round(c, n).alias(c)
    return features_of(spark, sf_dir).select(
        "influencer_id", "canonical_handle", "campaign_count", "brand_count", r("selected_rate", 6), "campaign_history_dq_warn_count", "fee_known_campaign_count", r("fee_observed_median", 3),
        r("follower_observed_median", 3), r("posted_rate", 6), r("views_median", 3), r("views_total", 1), r("gmv_observed_median", 3), r("weighted_content_engagement_rate", 6),
    )
