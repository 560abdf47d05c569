"""Sheets made of the example tables: queries that send whole sheets through the adapters, with their DuckDB equivalents.

Customers are the rows of one workbook, with a sheet a nation; the remainders of a customer's key choose what a row holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import query, read_table
from tidemill.functions.identity import strong_identity_cell
from tidemill.functions.parse import first_number, lenient_date, strict_date
from tidemill.functions.requirements import age_fit, age_overlap, budget_scope, gender_fit, gender_fit_status
from tidemill.functions.text import column_letters, normalized
from tidemill.operators.fingerprint import duplicate_content
from tidemill.operators.reconcile import gate, reconciliation
from tidemill.plans.deliverables import campaign_performance, deliverables_and_performance, influencer_rows, seller_snapshot
from tidemill.plans.history import attach_campaign, registries
from tidemill.plans.identity import cluster_counters, clusters
from tidemill.plans.sheets import candidate_observations, classify, next_nonempty


def key() -> Column:
    return F.col("c_custkey")


def cell(kind: str, text: Column | str | None, number: Column | None = None) -> Column:
    s = text if isinstance(text, Column) else F.lit(text)
    n = number if number is not None else F.lit(None)
    return F.struct(F.when(s.isNotNull(), kind).otherwise("none").alias("t"), s.cast("string").alias("s"), n.cast("double").alias("n"))


def words(*values: Column | str | None) -> Column:
    return F.array(*[cell("str", v) for v in values])


def sheet_rows(spark: SparkSession, sf_dir: str, cells: Column, sheet: Column | None = None) -> DataFrame:
    name = sheet if sheet is not None else F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))
    return read_table(spark, sf_dir, "customer").select(F.lit("book").alias("file"), name.alias("sheet"), key().alias("row_number"), cells.alias("cells"))


def candidate_cells() -> Column:
    name = F.concat(F.lit("creator_"), key().cast("string"))
    link = F.when(key() % 4 == 0, F.concat(F.lit("https://www.tiktok.com/@"), name)).when(key() % 4 == 1, F.concat(F.lit("Name (@other_"), key().cast("string"), F.lit(") | TikTok"))).when(key() % 4 == 3, "-")
    follower = F.when(key() % 5 == 2, cell("int", "500", F.lit(500))).otherwise(cell("str", F.when(key() % 5 == 1, "12K").when(key() % 5 == 3, "x").when(key() % 5 == 4, "1,234")))
    engagement = cell("str", F.when(key() % 3 == 0, "5%").when(key() % 3 == 2, "abc"))
    fee = F.when(key() % 7 == 1, "Barter").when(key() % 7 == 2, "100/hr").when(key() % 7 == 3, "1500").when(key() % 7 == 4, "odd").when(key() % 7 == 5, "*Free*")
    budget = F.when(key() % 7 == 6, cell("int", "2000", F.lit(2000))).otherwise(cell("str", fee))
    body = F.array(cell("int", key().cast("string"), key()), cell("str", name), cell("str", link), follower, engagement, budget)
    return (
        F.when(key() % 25 == 0, words("Number", "Influencer", "Link TikTok", "Follower", "Engagement %", "BUDGET"))
        .when(key() % 25 == 13, words("No", "Influencer", "Link Lemon8", "Follower"))
        .when(key() % 25 == 5, words(F.concat(F.lit("Tier "), F.col("c_mktsegment"))))
        .otherwise(body)
    )


@query(
    "candidate_observations",
    """WITH r AS (SELECT c_nationkey AS s, c_custkey AS k, c_custkey % 25 AS m, CASE WHEN c_custkey % 25 = 5 THEN 'Tier ' || c_mktsegment END AS tier FROM customer),
    w AS (SELECT *, max(CASE WHEN m IN (0, 13) THEN k END) OVER (PARTITION BY s ORDER BY k) AS h, list(tier) OVER (PARTITION BY s ORDER BY k ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS near FROM r),
    b AS (SELECT b.s, b.k, b.h, coalesce(array_to_string(list_filter(h.near, lambda t: t IS NOT NULL)[-2:], ' || '), '') AS context FROM w b JOIN w h ON h.s = b.s AND h.k = b.h AND h.m = 0 WHERE b.k > b.h AND b.m NOT IN (5) AND b.k % 5 IN (1, 2, 4)),
    v AS (SELECT *, CASE k % 5 WHEN 1 THEN 12000 WHEN 2 THEN 500 ELSE 1234 END AS f, CASE WHEN k % 3 = 0 THEN 0.05 END AS e,
      CASE k % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'barter' WHEN 2 THEN 'hourly' WHEN 4 THEN 'unknown' WHEN 5 THEN 'free' ELSE 'fixed' END AS model, CASE k % 7 WHEN 1 THEN 0 WHEN 2 THEN 100 WHEN 3 THEN 1500 WHEN 5 THEN 0 WHEN 6 THEN 2000 END AS amount FROM b)
    SELECT 'nation_' || s AS source_sheet_name, k AS source_row_number, h AS source_section_header_row, context AS section_context_raw, 'creator_' || k || CASE WHEN k % 4 = 1 THEN ';other_' || k ELSE '' END AS normalized_handle_candidates,
      CASE WHEN k % 4 = 1 THEN '' ELSE 'creator_' || k END AS canonical_handle_candidate, CAST(f AS DOUBLE) AS follower_normalized, CAST(e AS DOUBLE) AS engagement_normalized, model AS fee_model, CAST(amount AS DOUBLE) AS fee_amount_normalized,
      CASE model WHEN 'hourly' THEN 'hour' WHEN 'missing' THEN '' WHEN 'unknown' THEN '' ELSE 'campaign' END AS fee_unit, CASE WHEN k % 4 = 1 THEN 'ERROR' WHEN k % 3 <> 0 OR model IN ('unknown', 'missing') THEN 'WARN' ELSE 'PASS' END AS dq_status,
      concat_ws(';', CASE WHEN k % 4 = 1 THEN 'DQ_IDENTITY_CONFLICT' END, CASE k % 3 WHEN 2 THEN 'DQ_ENGAGEMENT_INVALID' WHEN 1 THEN 'DQ_ENGAGEMENT_MISSING' END, CASE model WHEN 'unknown' THEN 'DQ_FEE_INVALID' WHEN 'missing' THEN 'DQ_FEE_MISSING' END) AS dq_codes FROM v""",
)
def candidate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidate_observations(sheet_rows(spark, sf_dir, candidate_cells()))
    return found.select(
        "source_sheet_name", "source_row_number", "source_section_header_row", "section_context_raw", "normalized_handle_candidates", "canonical_handle_candidate", "follower_normalized",
        "engagement_normalized", "fee_model", "fee_amount_normalized", "fee_unit", "dq_status", "dq_codes",
    )


SHEET_NAMES = {0: "Ads", 1: "GMV", 2: "Report Oct", 3: "Misc", 4: "Content"}


@query(
    "sheet_classification",
    """WITH r AS (SELECT c_nationkey AS n, c_custkey AS k, c_custkey % 25 = 0 AND c_nationkey % 2 = 0 AS h FROM customer),
    g AS (SELECT n, min(k) FILTER (WHERE h) AS first_row, CAST(count(*) FILTER (WHERE h) AS INTEGER) AS n_headers FROM r GROUP BY 1)
    SELECT CASE n % 5 WHEN 0 THEN 'Ads ' WHEN 1 THEN 'GMV ' WHEN 2 THEN 'Report Oct ' WHEN 3 THEN 'Misc ' ELSE 'Content ' END || n AS sheet,
      CASE WHEN first_row IS NOT NULL THEN 'influencer_candidate' ELSE CASE n % 5 WHEN 0 THEN 'ads' WHEN 1 THEN 'sales_gmv' WHEN 2 THEN 'monthly_performance' WHEN 3 THEN 'other_operations' ELSE 'content_timeline' END END AS sheet_type,
      CASE WHEN first_row IS NOT NULL THEN 'high' WHEN n % 5 = 3 THEN 'low' ELSE 'medium' END AS confidence,
      CASE WHEN first_row IS NOT NULL THEN 'candidate header signature score=11' ELSE CASE n % 5 WHEN 0 THEN 'sheet-name rule: ads' WHEN 1 THEN 'sheet-name rule: gmv' WHEN 2 THEN 'sheet-name rule: report oct' WHEN 3 THEN 'no candidate signature or known name rule' ELSE 'sheet-name rule: content' END END AS basis,
      first_row AS primary_header_row, n_headers FROM g""",
)
def classification_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = (key() % 25 == 0) & (F.col("c_nationkey") % 2 == 0)
    cells = F.when(header, words("Number", "Influencer", "Link TikTok", "Follower", "Engagement %", "BUDGET")).otherwise(words(F.col("c_name"), F.col("c_mktsegment")))
    kind = F.create_map(*[F.lit(x) for pair in SHEET_NAMES.items() for x in pair])[F.col("c_nationkey") % 5]
    rows = sheet_rows(spark, sf_dir, cells, F.concat(kind, F.lit(" "), F.col("c_nationkey").cast("string"))).withColumn("ord", F.col("row_number"))
    return classify(rows).select("sheet", "sheet_type", "confidence", "basis", "primary_header_row", F.size("detected_header_rows").alias("n_headers"))


def delivery_cells() -> Column:
    name = F.when(key() % 11 == 0, "Total").when(key() % 11 == 1, "").otherwise(F.concat(F.lit("creator_"), key().cast("string")))
    date = F.when(key() % 4 == 0, "45000").when(key() % 4 == 1, "2026-04-13").when(key() % 4 == 2, "#N/A").otherwise("TBC")
    url = F.when(key() % 3 == 0, F.concat(F.lit("https://tiktok.com/"), key().cast("string"))).when(key() % 3 == 1, "none").otherwise("")
    views = F.when(key() % 5 == 0, "12K").when(key() % 5 == 1, "#DIV/0!").when(key() % 5 == 2, "1,500").when(key() % 5 == 3, "-").otherwise("7%")
    body = words(F.concat(F.lit("row "), key().cast("string")), name, None, date, url, views, F.when(key() % 2 == 0, "5"))
    return (
        F.when(key() % 30 == 0, words("No", "Influencer", "Follower", "วันที่ลงโพสต์", "ลิงค์โพสต์", "VideoView", "Like"))
        .when(key() % 30 == 20, words("Date", "Revenue", "Order", "Traffic", "ROAS"))
        .when(key() % 30 == 29, words("Report Oct"))
        .otherwise(body)
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    rule = lambda position, text, campaign: F.struct(F.lit(position).alias("p"), F.lit(text).alias("t"), F.lit(campaign).alias("c"))
    listed = F.when(n % 3 == 0, F.array(rule(0, "Report Oct", "c_oct"), rule(1, "", "c_any"))).when(n % 3 == 1, F.array(rule(0, "Report Oct", "c_oct")))
    rows = read_table(spark, sf_dir, "nation").select(n, F.inline(listed).alias("rule_position", "section_contains", "campaign_id"))
    return rows.select(F.lit("book").alias("source_filename"), F.concat(F.lit("nation_"), n.cast("string")).alias("source_sheet_name"), "rule_position", "section_contains", "campaign_id")


#: Rows under a header, with the header's kind, the campaign of the first rule that fits, and the fields that a row gives.
DELIVERY_SQL = """r AS (SELECT c_nationkey AS s, c_custkey AS k, c_custkey % 30 AS m FROM customer),
  w AS (SELECT *, max(CASE WHEN m IN (0, 20) THEN k END) OVER (PARTITION BY s ORDER BY k) AS h, count(CASE WHEN m = 29 THEN 1 END) OVER (PARTITION BY s ORDER BY k ROWS BETWEEN 68 PRECEDING AND 1 PRECEDING) > 0 AS oct FROM r),
  b AS (SELECT b.s, b.k, b.m, h.m AS kind, CASE WHEN h.oct THEN 'Report Oct' ELSE '' END AS label, CASE b.s % 3 WHEN 0 THEN CASE WHEN h.oct THEN 'c_oct' ELSE 'c_any' END WHEN 1 THEN CASE WHEN h.oct THEN 'c_oct' END END AS campaign_id FROM w b JOIN w h ON h.s = b.s AND h.k = b.h WHERE b.k > b.h AND b.m NOT IN (0, 20)),
  d AS (SELECT 'nation_' || s AS sheet, k AS row_number, campaign_id, 'creator_' || k AS identity_raw, label AS section_label, CASE WHEN k % 3 = 0 THEN 'https://tiktok.com/' || k ELSE '' END AS post_url, CASE k % 4 WHEN 0 THEN '2023-03-15' WHEN 1 THEN '2026-04-13' WHEN 2 THEN '' ELSE 'TBC' END AS posted_date,
    CAST(CASE k % 5 WHEN 0 THEN 12000 WHEN 2 THEN 1500 WHEN 4 THEN 7 END AS DOUBLE) AS views, CAST(CASE WHEN k % 2 = 0 THEN 5 END AS DOUBLE) AS likes FROM b WHERE kind = 0 AND m <> 29 AND k % 11 > 1)"""


@query("influencer_rows", f"WITH {DELIVERY_SQL} SELECT * FROM d")
def influencer_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = influencer_rows(sheet_rows(spark, sf_dir, delivery_cells()), rules(spark, sf_dir))
    return found.select("sheet", "row_number", "campaign_id", "identity_raw", "section_label", "post_url", "posted_date", "views", "likes")


def example_deliveries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = influencer_rows(sheet_rows(spark, sf_dir, delivery_cells()), rules(spark, sf_dir))
    return deliverables_and_performance(rows.withColumn("influencer_id", F.when(F.col("row_number") % 6 != 0, F.concat(F.lit("inf_"), F.col("row_number").cast("string")))))


@query(
    "influencer_performance",
    f"""WITH {DELIVERY_SQL} SELECT campaign_id, CASE WHEN row_number % 6 <> 0 THEN 'inf_' || row_number END AS influencer_id, 'dlv_' || substr(sha256('book|' || sheet || '|' || row_number), 1, 16) AS deliverable_id, posted_date AS event_date, views, likes,
    concat_ws(';', CASE WHEN campaign_id IS NULL THEN 'CAMPAIGN_UNMAPPED' END, CASE WHEN row_number % 6 = 0 THEN 'IDENTITY_UNRESOLVED_EXACT_ONLY' END) AS dq_codes FROM d WHERE coalesce(views, likes) IS NOT NULL""",
)
def performance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example_deliveries(spark, sf_dir)[1].select("campaign_id", "influencer_id", "deliverable_id", "event_date", "views", "likes", "dq_codes")


@query(
    "deliverable_issues",
    f"WITH {DELIVERY_SQL} SELECT sheet, row_number, 'CAMPAIGN_UNMAPPED' AS dq_code FROM d WHERE campaign_id IS NULL UNION ALL SELECT sheet, row_number, 'IDENTITY_UNRESOLVED_EXACT_ONLY' FROM d WHERE row_number % 6 = 0",
)
def issues_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example_deliveries(spark, sf_dir)[2].select("sheet", "row_number", "dq_code")


@query("campaign_performance", f"WITH {DELIVERY_SQL} SELECT 'nation_' || s AS sheet, k AS row_number, campaign_id, 'campaign' AS performance_scope, 'row ' || k AS event_date, 45000 :: DOUBLE AS traffic FROM b WHERE kind = 20 AND m <> 29 AND k % 4 = 0")
def campaign_performance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = campaign_performance(sheet_rows(spark, sf_dir, delivery_cells()), rules(spark, sf_dir), "campaign")
    return kept.select("sheet", "row_number", "campaign_id", "performance_scope", "event_date", "traffic")


@query("metric_error_literals", f"WITH {DELIVERY_SQL} SELECT 'nation_' || s AS sheet, k AS row_number, 'SOURCE_METRIC_ERROR_LITERAL' AS dq_code FROM b WHERE kind = 20 AND m <> 29 AND (k % 4 = 2 OR k % 5 = 1)")
def literals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign_performance(sheet_rows(spark, sf_dir, delivery_cells()), rules(spark, sf_dir), "campaign")[1].select("sheet", "row_number", "dq_code")


@query(
    "seller_snapshot",
    """SELECT c_custkey AS row_number, c_name AS identity_raw, CAST(CASE c_custkey % 3 WHEN 0 THEN 1250.5 WHEN 1 THEN 3000 END AS DOUBLE) AS gmv, CAST(c_nationkey AS DOUBLE) AS impressions, CAST(CASE WHEN c_custkey % 2 = 0 THEN 7 END AS DOUBLE) AS orders FROM customer WHERE c_custkey > 1 AND c_custkey % 8 > 0""",
)
def seller_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = [None] * 11
    cells = words(None, F.when(key() % 8 > 0, F.col("c_name")).otherwise(" "), F.when(key() % 3 == 0, "1,250.5").when(key() % 3 == 1, "3K").otherwise("#N/A"), *rest, F.col("c_nationkey").cast("string"), F.when(key() % 2 == 0, "7").otherwise("-"))
    return seller_snapshot(sheet_rows(spark, sf_dir, cells)).select("row_number", "identity_raw", "gmv", "impressions", "orders")


@query(
    "campaign_registry",
    """WITH m AS (SELECT DISTINCT p_brand AS f, p_type AS t FROM part), c AS (SELECT 'cmp_' || substr(sha256(lower(f) || '|' || lower(t)), 1, 16) AS campaign_id, 'brd_' || substr(sha256(lower(f)), 1, 16) AS brand_id, f, t FROM m)
    SELECT campaign_id, brand_id, f AS source_filename, t AS source_sheet_name, 'unspecified' AS campaign_period_label, 'tiktok' AS platform, CAST((SELECT count(*) FROM part WHERE p_brand = f AND p_type = t AND p_size <= 25) AS BIGINT) AS n_mapped FROM c""",
)
def registry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, none = read_table(spark, sf_dir, "part"), F.lit(None).cast("string")
    mapping = part.select(F.col("p_brand").alias("source_filename"), F.col("p_type").alias("source_sheet_name"), F.upper("p_brand").alias("canonical_brand_name"), none.alias("campaign_period_label"), none.alias("platform"), "p_partkey")
    _, campaigns = registries(mapping, F.col("p_partkey"))
    rows = part.select(F.col("p_brand").alias("source_filename"), F.when(F.col("p_size") <= 25, F.col("p_type")).otherwise("unmapped").alias("source_sheet_name"), "p_partkey")
    counted = attach_campaign(rows, campaigns)[0].groupBy("campaign_id").agg(F.count("*").alias("n"))
    return campaigns.join(counted, "campaign_id", "left").select("*", F.coalesce("n", F.lit(0)).cast("long").alias("n_mapped")).drop("n")


@query(
    "gender_and_age_fit",
    """WITH x AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'all' WHEN 1 THEN 'female_only' WHEN 2 THEN 'male_only' WHEN 3 THEN 'mixed_weighted' WHEN 4 THEN 'unknown' END AS mode, CASE c_custkey % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'mixed' END AS g,
      CASE c_custkey % 7 WHEN 0 THEN 0.5 WHEN 1 THEN 0 ELSE 0.7 END AS f, c_custkey % 5 AS n, CASE WHEN c_custkey % 9 > 0 THEN 18 END AS lo, CASE WHEN c_custkey % 10 > 0 THEN 20 + c_custkey % 10 END AS band FROM customer)
    SELECT k AS c_custkey, CAST(CASE WHEN mode IS NULL OR mode = 'unknown' THEN NULL WHEN n = 0 THEN 50 WHEN mode = 'all' THEN 100
        WHEN mode IN ('female_only', 'male_only') THEN CASE WHEN g IS NULL THEN 50 WHEN g || '_only' = mode THEN 100 WHEN g = 'mixed' THEN 70 ELSE 0 END
        ELSE CASE WHEN g = 'mixed' THEN 100 WHEN f = 0.5 OR (f = 0) THEN 80 WHEN g = 'female' THEN 90 ELSE 50 END END AS DOUBLE) AS gender_score,
      CASE WHEN mode IS NULL OR mode = 'unknown' THEN 'target_unknown' WHEN g IS NULL THEN 'evidence_missing' WHEN mode IN ('all', 'mixed_weighted') OR g || '_only' = mode THEN 'match' WHEN g = 'mixed' THEN 'partial_match' ELSE 'mismatch' END AS gender_status,
      CASE WHEN lo IS NOT NULL THEN CASE WHEN band IS NULL THEN 50 ELSE round(least(100, 100.0 * greatest(0, least(24, band + 4) - greatest(18, band) + 1) / 5), 4) END END AS age_score,
      CASE WHEN lo IS NOT NULL AND band IS NOT NULL THEN round(100.0 * greatest(0, least(24, band + 4) - greatest(18, band) + 1) / 5, 4) END AS overlap FROM x""",
)
def fit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(key() % 6 == 0, "all").when(key() % 6 == 1, "female_only").when(key() % 6 == 2, "male_only").when(key() % 6 == 3, "mixed_weighted").when(key() % 6 == 4, "unknown")
    gender = F.when(key() % 4 == 0, "female").when(key() % 4 == 1, "male").when(key() % 4 == 2, "mixed")
    share = F.when(key() % 7 == 0, 0.5).when(key() % 7 == 1, 0.0).otherwise(0.7)
    rest = F.when(share == 0.7, 0.3).otherwise(share)
    low, high, band = F.when(key() % 9 > 0, 18), F.lit(24), F.when(key() % 10 > 0, 20 + key() % 10)
    return read_table(spark, sf_dir, "customer").select(
        key(), gender_fit(mode, share, rest, gender, key() % 5, 50.0).alias("gender_score"), gender_fit_status(mode, gender).alias("gender_status"), F.round(age_fit(low, high, band, band + 4, 50.0), 4).alias("age_score"), age_overlap(low, high, band, band + 4).alias("overlap")
    )


@query(
    "scalar_suite",
    """SELECT c_custkey, lower(c_mktsegment) || ' x' AS plain, CASE c_custkey % 3 WHEN 0 THEN 2500 WHEN 1 THEN 12 END :: DOUBLE AS first_number, CASE WHEN c_custkey % 4 = 0 THEN DATE '2026-02-03' END AS strict, CASE WHEN c_custkey % 4 <= 1 THEN DATE '2026-02-03' END AS lenient,
      CASE c_custkey % 3 WHEN 0 THEN 'influencer_tiktok' WHEN 1 THEN 'campaign_total' ELSE 'candidate_pool_unspecified' END AS scope, CASE c_custkey % 4 WHEN 0 THEN 'tiktok_url' WHEN 1 THEN 'parenthesized_at' WHEN 2 THEN 'bare_at' END AS strength,
      CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'end' END AS to_the_right, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'Z' ELSE 'AB' END AS letters FROM customer""",
)
def scalar_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda m, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (key() % m).cast("int") + 1)
    at = F.concat(F.lit("@h"), key().cast("string"))
    strength = F.when(key() % 4 == 0, F.concat(F.lit("https://TikTok.com/"), at)).when(key() % 4 == 1, F.concat(F.lit("Name ("), at, F.lit(")"))).when(key() % 4 == 2, at).otherwise("plain")
    row = F.array(F.lit("a"), F.when(key() % 2 == 0, F.col("c_name")).otherwise(" "), F.lit(None).cast("string"), F.lit("end"))
    date = one(4, "2026-02-03", "2026-2-3", "03/02/2026", "")
    return read_table(spark, sf_dir, "customer").select(
        key(), normalized(F.concat(F.lit("\t "), F.col("c_mktsegment"), F.lit("  \n X "))).alias("plain"), first_number(one(3, "12 of 2,500 in 9000", "12 or 7", "none")).alias("first_number"), strict_date(date).alias("strict"),
        lenient_date(date).alias("lenient"), budget_scope(one(3, "Influencer on TikTok", "งบรวม 5", "pool")).alias("scope"), strong_identity_cell(strength).alias("strength"), next_nonempty(row, 0).alias("to_the_right"),
        column_letters(one(3, 0, 25, 27)).alias("letters"),
    )


@query("duplicate_content", "SELECT sha256(p_type) AS content_hash, CAST(count(*) AS BIGINT) AS n, min(p_name) AS first_name FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_content_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_content(read_table(spark, sf_dir, "part"), "p_type", "p_name")


@query(
    "reconciliation_gate",
    """WITH m AS (SELECT 'nation_' || c_nationkey AS metric, CAST(count(*) AS BIGINT) AS value, CAST(count(*) FILTER (WHERE c_acctbal < 0) AS BIGINT) AS rejected FROM customer GROUP BY 1),
    s AS (SELECT *, CASE WHEN 10 * rejected > value THEN 'FAIL' WHEN rejected > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM m) SELECT *, CASE WHEN (SELECT count(*) FROM s WHERE status = 'FAIL') > 0 THEN 2 ELSE 0 END AS exit_code FROM s""",
)
def reconciliation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    metrics = c.groupBy(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("metric")).agg(F.count("*").alias("value"), F.count_if(F.col("c_acctbal") < 0).alias("rejected"))
    checked = reconciliation(metrics, 10 * F.col("rejected") > F.col("value"), F.col("rejected") > 0)
    return checked.withColumn("exit_code", F.lit(0 if gate(checked)[0] else 2))


@query(
    "cluster_counters",
    """WITH o AS (SELECT lower(c_mktsegment) || c_nationkey AS h, c_custkey % 12 AS f FROM customer), c AS (SELECT h, count(*) AS n, count(DISTINCT f) AS books FROM o GROUP BY 1)
    SELECT CAST(count(*) AS BIGINT) AS clusters, CAST(sum(n) AS BIGINT) AS observations, CAST(count(*) FILTER (WHERE books > 1) AS BIGINT) AS multi_workbook_clusters FROM c""",
)
def counters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").select(
        F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("canonical_handle_candidate"), F.concat(F.lit("book_"), (key() % 12).cast("string")).alias("source_filename"), F.lit("s").alias("source_sheet_name"), F.col("c_name").alias("identity_primary_raw")
    )
    return cluster_counters(clusters(rows))
