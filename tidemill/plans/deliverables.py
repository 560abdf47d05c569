"""Deliverables and performance from sheets: header blocks, row adapters, campaign lookup, promotion and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import query, read_table
from tidemill.functions.identity import stable_id
from tidemill.functions.parse import excel_date, known_truth, parse_metric
from tidemill.functions.pii import pii_safe_text
from tidemill.functions.text import ERROR_LITERALS, codes, contains_any, normalized, safe_text
from tidemill.operators.dedupe import ordered_list
from tidemill.plans.sheets import header_kind, map_headers, texts, with_nearest_label, with_segments

#: Rows that sum up or repeat the header.
SUMMARY_WORDS = ["total", "รวม", "influencer", "kols name"]
PERSON_METRICS = ["views", "likes", "comments", "saves", "shares", "gmv", "sales", "orders"]
CAMPAIGN_METRICS = ["revenue", "orders", "traffic", "viewers", "views", "gmv", "sales", "cost", "roi", "roas", "ctr", "impressions", "clicks", "likes", "comments", "shares"]
#: Positions of the affiliate snapshot's columns, from 0.
SELLER_COLUMNS = {"identity": 1, "gmv": 2, "impressions": 14, "orders": 15}


def blocks(grid: DataFrame) -> DataFrame:
    """Rows under an influencer or performance header, with kind, the header's columns by field, and a label; the last block runs to the sheet's end."""
    keys = ["file", "sheet"]
    v = texts(F.col("cells"))
    marked = with_nearest_label(grid.withColumn("kind", header_kind(v)), "section_label", keys, "row_number")
    marked = with_segments(marked, F.col("kind").isNotNull(), keys, "row_number")
    headers = marked.where("kind is not null").select(*keys, "header_row", F.col("kind").alias("block_kind"), map_headers(v).alias("columns"), F.col("section_label").alias("block_label"))
    body = marked.where(F.col("row_number") > F.col("header_row")).drop("kind", "section_label")
    return body.join(headers, [*keys, "header_row"])


def field_text(name: str) -> Column:
    """The text of a field's cell; null where the header hasn't the field or the row is too short."""
    return F.try_element_at("cells", F.try_element_at("columns", F.lit(name)) + 1)["s"]


def attach_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows(file, sheet, block_label) with the campaign of the first rule of their source whose text is in the label; a rule without text always fits."""
    r = rules.select(F.col("source_filename").alias("file"), F.col("source_sheet_name").alias("sheet"), "rule_position", F.col("section_contains").alias("part"), F.col("campaign_id").alias("rule_campaign"))
    r = r.groupBy("file", "sheet").agg(F.array_sort(F.collect_list(F.struct("rule_position", "part", "rule_campaign"))).alias("rules"))
    joined = rows.join(r, ["file", "sheet"], "left")
    fits = F.filter("rules", lambda x: (F.coalesce(x["part"], F.lit("")) == "") | F.contains(F.lower(F.col("block_label")), F.lower(x["part"])))
    return joined.withColumn("campaign_id", F.try_element_at(fits, F.lit(1))["rule_campaign"]).drop("rules")


def influencer_rows(grid: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of influencer blocks with an identity, their fields read; summary rows and repeated headers are left out."""
    rows = blocks(grid).where("block_kind = 'influencer'")
    identity = safe_text(field_text("identity"))
    rows = attach_rule(rows.withColumn("identity_raw", identity), rules).where((F.col("identity_raw") != "") & ~normalized(F.col("identity_raw")).isin(*SUMMARY_WORDS))
    url = safe_text(field_text("post_url"))
    return rows.select(
        "file", "sheet", "row_number", "campaign_id", "identity_raw", F.col("block_label").alias("section_label"), F.when(contains_any(F.lower(url), ["tiktok", "http"]), url).otherwise("").alias("post_url"),
        excel_date(field_text("posted_date")).alias("posted_date"), excel_date(field_text("schedule_date")).alias("schedule_date"), safe_text(field_text("confirmed")).alias("confirmed_raw"),
        safe_text(field_text("posted")).alias("posted_raw"), pii_safe_text(field_text("product")).alias("product"), *[parse_metric(field_text(m)).alias(m) for m in PERSON_METRICS],
    )


def deliverables_and_performance(resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(deliverables, performance, issues) of influencer rows with influencer_id; a performance row needs a metric that can be read."""
    key = [F.col(c) for c in ("file", "sheet", "row_number")]
    r = resolved.withColumns({"deliverable_id": stable_id("dlv", *key), "dq_codes": F.array_join(codes((F.col("campaign_id").isNull(), "CAMPAIGN_UNMAPPED"), (F.col("influencer_id").isNull(), "IDENTITY_UNRESOLVED_EXACT_ONLY")), ";")})
    delivered = r.drop(*PERSON_METRICS)
    performed = r.where(F.coalesce(*PERSON_METRICS).isNotNull()).select(stable_id("ipf", *key).alias("performance_id"), "deliverable_id", "campaign_id", "influencer_id", F.col("posted_date").alias("event_date"), *PERSON_METRICS, "dq_codes")
    return delivered, performed, r.where("dq_codes <> ''").select("file", "sheet", "row_number", F.explode(F.split("dq_codes", ";")).alias("dq_code"))


def campaign_performance(grid: DataFrame, rules: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of performance blocks: a row needs a metric; error literals are issues; 0 viewers fall through to views."""
    rows = attach_rule(blocks(grid).where("block_kind = 'performance'"), rules)
    first = safe_text(F.try_element_at("cells", F.lit(1))["s"])
    rows = rows.where(~normalized(first).isin(*SUMMARY_WORDS))
    metrics = {m: parse_metric(field_text(m)) for m in CAMPAIGN_METRICS}
    found = rows.select(
        "file", "sheet", "row_number", "campaign_id", F.lit(scope).alias("performance_scope"), excel_date(F.coalesce(field_text("posted_date"), first)).alias("event_date"), *[c.alias(m) for m, c in metrics.items()],
        F.filter(texts(F.col("cells")), lambda t: F.trim(t).isin(*ERROR_LITERALS)).alias("errors"),
    )
    reach = F.coalesce(F.nullif(F.col("viewers"), F.lit(0.0)), F.col("views"))
    kept = found.where(F.coalesce(*CAMPAIGN_METRICS).isNotNull()).withColumns({"reach": reach, "campaign_performance_id": stable_id("cpf", F.col("file"), F.col("sheet"), F.col("row_number"))}).drop("errors")
    return kept, found.where(F.size("errors") > 0).select("file", "sheet", "row_number", F.lit("SOURCE_METRIC_ERROR_LITERAL").alias("dq_code"))


def seller_snapshot(grid: DataFrame) -> DataFrame:
    """Rows of an affiliate snapshot, by fixed positions."""
    at = lambda name: F.try_element_at("cells", F.lit(SELLER_COLUMNS[name] + 1))["s"]
    rows = grid.withColumn("identity_raw", safe_text(at("identity"))).where((F.col("row_number") > 1) & (F.col("identity_raw") != ""))
    return rows.select("file", "sheet", "row_number", "identity_raw", *[parse_metric(at(m)).alias(m) for m in ("gmv", "impressions", "orders")])


def promoted_and_quarantined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with campaign and influencer, and the others with the reasons."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    found = codes((blank("campaign_id"), "CAMPAIGN_ID_MISSING"), (blank("influencer_id"), "INFLUENCER_ID_MISSING"))
    marked = rows.withColumn("quarantine_codes", F.array_join(found, ";"))
    return marked.where("quarantine_codes = ''").drop("quarantine_codes"), marked.where("quarantine_codes <> ''")


def collapse(rows: DataFrame, order: Column) -> DataFrame:
    """One deliverable for each URL of a (campaign, influencer), else for each source row: the first row's values, occurrences in order, WARN if several."""
    r = rows.withColumns({"ord": order, "k": F.when(F.coalesce("post_url", F.lit("")) != "", F.col("post_url")).otherwise(F.concat_ws("|", "file", "sheet", F.col("row_number").cast("string")))})
    rest = [c for c in rows.columns if c not in ("campaign_id", "influencer_id")]
    where = F.concat_ws(" | ", "file", "sheet", F.col("row_number").cast("string"))
    out = r.groupBy("campaign_id", "influencer_id", "k").agg(F.min_by(F.struct(*rest), "ord").alias("first"), F.count("*").alias("observation_count"), F.array_join(ordered_list(where, F.col("ord")), " || ").alias("source_occurrences"))
    return out.select("campaign_id", "influencer_id", "first.*", "observation_count", "source_occurrences", F.when(F.col("observation_count") > 1, "WARN").otherwise("PASS").alias("dq_status"))


@query(
    "deliverable_collapse",
    """WITH r AS (SELECT l_partkey AS c, l_suppkey AS i, CASE WHEN l_linenumber = 1 THEN '' ELSE 'http://x/' || (l_orderkey % 3) END AS u, l_orderkey * 10 + l_linenumber AS o, l_quantity FROM lineitem),
    k AS (SELECT *, CASE WHEN u = '' THEN 'f|s|' || o ELSE u END AS k FROM r)
    SELECT c AS campaign_id, i AS influencer_id, u AS post_url, CAST(count(*) AS BIGINT) AS observation_count, min(o) AS row_number, CASE WHEN count(*) > 1 THEN 'WARN' ELSE 'PASS' END AS dq_status, string_agg('f | s | ' || o, ' || ' ORDER BY o) AS source_occurrences FROM k GROUP BY c, i, u, k""",
)
def collapse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read_table(spark, sf_dir, "lineitem")
    rows = x.select(
        F.col("l_partkey").alias("campaign_id"), F.col("l_suppkey").alias("influencer_id"), F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit("http://x/"), (F.col("l_orderkey") % 3).cast("string"))).alias("post_url"),
        F.lit("f").alias("file"), F.lit("s").alias("sheet"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_number"),
    )
    return collapse(rows, F.col("row_number")).drop("file", "sheet")


@query(
    "promotion_split",
    "SELECT concat_ws(';', CASE WHEN l_partkey % 5 = 0 THEN 'CAMPAIGN_ID_MISSING' END, CASE WHEN l_suppkey % 7 = 0 THEN 'INFLUENCER_ID_MISSING' END) AS quarantine_codes, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1",
)
def promotion_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read_table(spark, sf_dir, "lineitem")
    rows = x.select(F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey")).alias("campaign_id"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("influencer_id"))
    good, bad = promoted_and_quarantined(rows)
    return good.withColumn("quarantine_codes", F.lit("")).unionByName(bad).groupBy("quarantine_codes").agg(F.count("*").alias("n"))


@query(
    "map_headers",
    """SELECT nation.n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'comments,identity,likes,views' WHEN 1 THEN 'orders,revenue,roas,traffic' ELSE 'posted,posted_date' END AS fields, CASE n_nationkey % 3 WHEN 0 THEN 'influencer' WHEN 1 THEN 'performance' END AS kind FROM nation""",
)
def header_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    row = lambda *x: F.array(*[F.lit(v) for v in x])
    header = F.when(k == 0, row("No", "Influencer", "VideoView", "Like", "Comment")).when(k == 1, row("Date", "Revenue", "Order", "Traffic", "ROAS")).otherwise(row("วันที่ลงโพสต์"))
    return read_table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.array_sort(F.map_keys(map_headers(header))), ",").alias("fields"), header_kind(header).alias("kind"))


def posted_state(rows: DataFrame) -> DataFrame:
    """rows with posted, three-valued, from their raw text."""
    return rows.withColumn("posted", known_truth(F.col("posted_raw")))
