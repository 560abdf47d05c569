"""Requirements and audiences: normalised targets, audience profiles, experience with tags, extraction from briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import query, read_table
from tidemill.functions.parse import excel_date, first_number, parse_fee, parse_metric, parse_number
from tidemill.functions.pii import looks_like_pii
from tidemill.functions.requirements import TAXONOMY, age_overlap, age_range, audience_age, audience_gender, budget_scope, platform, tag_coverage, tag_evidence, tags, target_gender
from tidemill.functions.text import codes, safe_text, split_list
from tidemill.plans.sheets import next_nonempty, texts

#: Labels of a brief's fields, matched in full.
BRIEF_LABELS = {
    "persona_raw": r"(?i)persona( influencer)?", "target_gender_raw": r"(?i)gender|เพศ", "target_age_raw": r"(?i)age|อายุ", "platform_raw": r"(?i)platform|แพลตฟอร์ม",
    "target_content_raw": r"(?i)(target )?content", "content_style_raw": r"(?i)content style|style", "pain_point_raw": r"(?i)pain ?points?",
}


def brief_fields(grid: DataFrame, stop: DataFrame) -> DataFrame:
    """(file, sheet, field, value) of label cells before stop(file, sheet, stop_before_row): the next text to the right, the first label of a field."""
    rows = grid.join(stop, ["file", "sheet"]).where(F.col("row_number") < F.col("stop_before_row"))
    values = texts(F.col("cells"))
    cells = rows.select("file", "sheet", "row_number", values.alias("values"), F.posexplode(values).alias("column", "text")).withColumn("text", safe_text(F.col("text")))
    field = F.coalesce(*[F.when(F.col("text").rlike(f"^(?:{p})$"), F.lit(n)) for n, p in BRIEF_LABELS.items()])
    found = cells.withColumns({"field": field, "value": next_nonempty(F.col("values"), F.col("column"))}).where("field is not null and value is not null")
    return found.groupBy("file", "sheet", "field").agg(F.min_by("value", F.struct("row_number", "column")).alias("value"))


def brief_budgets(grid: DataFrame, stop: DataFrame) -> DataFrame:
    """Budgets of a brief: cells that speak of a budget and hold a number themselves."""
    rows = grid.join(stop, ["file", "sheet"]).where(F.col("row_number") < F.col("stop_before_row"))
    cells = rows.select("file", "sheet", F.col("row_number").alias("source_row_number"), F.explode(texts(F.col("cells"))).alias("budget_source_raw"))
    amount = first_number(F.col("budget_source_raw"))
    found = cells.where(F.col("budget_source_raw").rlike("(?i)budget|งบประมาณ")).withColumns({"budget_amount": amount, "budget_scope": budget_scope(F.col("budget_source_raw")), "currency": F.lit("THB")})
    return found.where("budget_amount is not null")


def requirement_status(has_brief: Column, has_budget: Column, has_tier: Column, mapped: Column) -> Column:
    return (
        F.when(~mapped, "source_unmapped").when(has_brief, "explicit_source_fields").when(has_budget & has_tier, "budget_and_tier_only").when(has_budget | has_tier, "partial_source_fields").otherwise("source_requirement_missing")
    )


def normalize_requirements(rows: DataFrame) -> DataFrame:
    """Targets of raw requirements, with readiness, confidence and quality codes; nothing is inherited from other campaigns."""
    text = lambda *names: F.concat_ws("\n", *[F.coalesce(F.col(n), F.lit("")) for n in names])
    combined = text("persona_raw", "target_content_raw", "content_style_raw", "pain_point_raw", "tier_sections_raw")
    style = text("target_content_raw", "content_style_raw")
    out = rows.withColumns(
        {
            "g": target_gender(F.col("target_gender_raw")), "a": age_range(F.col("target_age_raw")), "p": platform(F.col("platform_raw")), "theme_tags": tags(combined, TAXONOMY["campaign_theme"]),
            "persona_tags": tags(F.col("persona_raw"), TAXONOMY["persona"]), "style_tags": tags(style, TAXONOMY["content_style"]), "theme_rule_evidence": F.array_join(tag_evidence(combined, TAXONOMY["campaign_theme"]), " || "),
        }
    )
    brief = F.coalesce(F.col("requirement_status") == "explicit_source_fields", F.lit(False))
    gender, age, theme = ~F.col("g.mode").isin("unknown", "unmapped"), F.col("a.age_min").isNotNull(), F.size("theme_tags") > 0
    given = lambda n: F.coalesce(F.col(n), F.lit("")) != ""
    quality = codes(
        (~brief, "SOURCE_REQUIREMENT_MISSING"), (given("target_gender_raw") & (F.col("g.mode") == "unmapped"), "TARGET_GENDER_UNMAPPED"), (given("target_age_raw") & ~age, "TARGET_AGE_UNMAPPED"), (brief & ~theme, "THEME_TAG_NOT_DERIVED")
    )
    return out.select(
        "campaign_id", F.col("p.platform").alias("platform"), F.col("p.method").alias("platform_mapping_method"), F.col("g.mode").alias("target_gender_mode"), F.col("g.female_share").alias("female_target_share"),
        F.col("g.male_share").alias("male_target_share"), F.col("a.age_min").alias("target_age_min"), F.col("a.age_max").alias("target_age_max"), F.col("a.method").alias("age_mapping_method"), "theme_tags", "persona_tags", "style_tags",
        "theme_rule_evidence", F.when(brief & (F.col("p.platform") != "") & (gender | age | theme), "ready_for_rule_based_fit").otherwise("insufficient_source_requirement").alias("fit_readiness"),
        F.when(brief & theme & gender & age, "high").when(brief, "medium").otherwise("low").alias("normalization_confidence"), quality.alias("dq_codes"),
    )


def audience_profiles(rows: DataFrame, order: Column) -> DataFrame:
    """One row an influencer: dominant gender and age band (of equal counts the one seen first), shares, counts by band, confidence."""
    raws = ["influencer_id", "audience_gender_raw", "audience_age_raw"]
    counted = rows.withColumn("ord", order).groupBy(*raws).agg(F.count("*").alias("times"), F.min("ord").alias("ord"))  # texts repeat: each is read once
    texts = counted.select(*raws[1:]).distinct()
    texts = texts.withColumns({"g": audience_gender(F.col("audience_gender_raw")), "a": audience_age(F.col("audience_age_raw"))})
    r = counted.alias("x").join(texts.alias("y"), F.expr("x.audience_gender_raw <=> y.audience_gender_raw and x.audience_age_raw <=> y.audience_age_raw")).select("x.influencer_id", "x.times", "x.ord", "y.g", "y.a")
    gender = F.when(F.col("g.gender").isin("female", "male", "mixed"), F.col("g.gender"))
    band = F.when(F.col("a.age_min").isNotNull(), F.concat_ws("-", F.col("a.age_min").cast("string"), F.col("a.age_max").cast("string")))
    read = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in (("gender", gender), ("age", band))]))
    values = r.select("influencer_id", "times", "ord", read).groupBy("influencer_id", "kind", "v").agg(F.sum("times").alias("c"), F.min("ord").alias("o"))

    def dominant(kind: str) -> list[Column]:
        own = lambda x: F.when((F.col("kind") == kind) & F.col("v").isNotNull(), x)
        n, parts = F.sum(own(F.col("c"))), F.array_sort(F.collect_list(own(F.struct("v", "c"))))
        told = F.array_join(F.transform(parts, lambda s: F.concat(s["v"], F.lit(":"), s["c"].cast("string"))), ";")
        return [
            F.max_by("v", own(F.struct("c", -F.col("o")))).alias(f"dominant_{kind}"), n.alias(f"{kind}_observation_count"), (F.max(own(F.col("c"))) / n).alias(f"dominant_{kind}_share"), F.when(n.isNotNull(), told).alias(f"{kind}_counts"),
        ]

    out = values.groupBy("influencer_id").agg(*dominant("gender"), *dominant("age"))
    n = lambda c: F.coalesce(c, F.lit(0))
    confidence = F.when((n("gender_observation_count") >= 2) & (n("age_observation_count") >= 2), "high").when(n("gender_observation_count") + n("age_observation_count") > 0, "medium").otherwise("low")
    return out.withColumns({"gender_observation_count": n("gender_observation_count"), "age_observation_count": n("age_observation_count"), "audience_confidence": confidence})


def tag_experience(pairs: DataFrame, tagged: DataFrame, column: str) -> DataFrame:
    """(influencer_id, tag_count, tag_counts): `tag:count` texts over the distinct campaigns of each influencer."""
    once = pairs.select("influencer_id", "campaign_id").distinct().join(tagged.select("campaign_id", F.explode(column).alias("tag")), "campaign_id")
    counted = once.groupBy("influencer_id", "tag").agg(F.count("*").alias("c"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("tag", "c"))), lambda s: F.concat(s["tag"], F.lit(":"), s["c"].cast("string")))
    return counted.groupBy("influencer_id").agg(F.count("*").alias("tag_count"), F.array_join(told, ";").alias("tag_counts"))


# --- queries ----------------------------------------------------------------------------------------------------


@query(
    "audience_profile",
    """WITH r AS (SELECT l_suppkey AS i, CASE l_returnflag WHEN 'R' THEN 'female' WHEN 'A' THEN 'male' END AS g, CASE l_linestatus WHEN 'F' THEN '18-24' ELSE '25-34' END AS b, min(l_orderkey * 10 + l_linenumber) AS o, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
    g AS (SELECT i, g, sum(n) AS c, min(o) AS o FROM r WHERE g IS NOT NULL GROUP BY 1, 2), b AS (SELECT i, b, sum(n) AS c, min(o) AS o FROM r GROUP BY 1, 2)
    SELECT g.i AS influencer_id, arg_max(g, c * 1000000000 - o) AS dominant_gender, CAST(sum(c) AS BIGINT) AS gender_observation_count, (SELECT arg_max(b, c * 1000000000 - o) FROM b WHERE b.i = g.i) AS dominant_age, (SELECT string_agg(b || ':' || CAST(c AS BIGINT), ';' ORDER BY b) FROM b WHERE b.i = g.i) AS age_counts FROM g GROUP BY g.i""",
)
def audience_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read_table(spark, sf_dir, "lineitem")
    rows = x.select(
        F.col("l_suppkey").alias("influencer_id"), F.when(F.col("l_returnflag") == "R", "หญิง").when(F.col("l_returnflag") == "A", "ผู้ชาย").otherwise("").alias("audience_gender_raw"),
        F.when(F.col("l_linestatus") == "F", "18 - 24 ปี").otherwise("25-34").alias("audience_age_raw"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    return audience_profiles(rows, F.col("ord")).select("influencer_id", "dominant_gender", "gender_observation_count", "dominant_age", "age_counts")


@query(
    "tag_experience",
    """WITH p AS (SELECT DISTINCT l_suppkey AS i, l_partkey AS c FROM lineitem), t AS (SELECT p_partkey AS c, unnest(list_distinct(string_split(p_type, ' '))) AS tag FROM part), n AS (SELECT i, tag, count(*) AS k FROM p JOIN t USING (c) GROUP BY 1, 2)
    SELECT i AS influencer_id, CAST(count(*) AS BIGINT) AS tag_count, string_agg(tag || ':' || k, ';' ORDER BY tag, k) AS tag_counts FROM n GROUP BY 1""",
)
def experience_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, p = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    tagged = p.select(F.col("p_partkey").alias("campaign_id"), split_list(F.col("p_type"), " ").alias("tags"))
    return tag_experience(x.select(F.col("l_suppkey").alias("influencer_id"), F.col("l_partkey").alias("campaign_id")), tagged, "tags")


@query(
    "tag_coverage",
    "SELECT p_partkey, CASE WHEN len(list_intersect(list_distinct(string_split(p_name, ' ')), ['a'])) < 0 THEN NULL ELSE round(len(list_intersect(list_distinct(string_split(p_name, ' ')), list_distinct(string_split(p_type || ' ' || p_brand, ' ')))) * 100.0 / len(list_distinct(string_split(p_name, ' '))), 4) END :: DOUBLE AS coverage FROM part",
)
def coverage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(tag_coverage(split_list(F.col("p_name"), " "), split_list(F.concat_ws(" ", "p_type", "p_brand"), " ")), 4).alias("coverage"))


@query(
    "age_overlap",
    "SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN round(100.0 * greatest(0, least(34, 18 + p_size) - greatest(20, 10 + p_size) + 1) / 9, 4) :: DOUBLE END AS overlap FROM part",
)
def overlap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.when(F.col("p_size") % 7 != 0, F.col("p_size") + 10)
    return read_table(spark, sf_dir, "part").select("p_partkey", age_overlap(F.lit(20), F.lit(34), low, low + 8).alias("overlap"))


@query(
    "requirement_normalize",
    """WITH r AS (SELECT p_partkey AS k, p_size % 4 AS g, p_size % 3 AS a, p_size % 5 AS t, p_partkey % 2 = 0 AS brief FROM part)
    SELECT k AS campaign_id, CASE g WHEN 0 THEN 'mixed_weighted' WHEN 1 THEN 'female_only' WHEN 2 THEN 'unknown' ELSE 'unmapped' END AS target_gender_mode, CASE g WHEN 0 THEN 0.7 :: DOUBLE WHEN 1 THEN 1.0 :: DOUBLE END AS female_target_share, CASE a WHEN 0 THEN 18 END AS target_age_min,
      CASE t WHEN 0 THEN 'skin_care' WHEN 1 THEN 'eyewear_fashion' ELSE '' END AS theme_tags, CASE WHEN brief AND (g < 2 OR a = 0 OR t < 2) THEN 'ready_for_rule_based_fit' ELSE 'insufficient_source_requirement' END AS fit_readiness,
      CASE WHEN brief AND t < 2 AND g < 2 AND a = 0 THEN 'high' WHEN brief THEN 'medium' ELSE 'low' END AS normalization_confidence,
      concat_ws(';', CASE WHEN NOT brief THEN 'SOURCE_REQUIREMENT_MISSING' END, CASE WHEN g = 3 THEN 'TARGET_GENDER_UNMAPPED' END, CASE WHEN a = 1 THEN 'TARGET_AGE_UNMAPPED' END, CASE WHEN brief AND t >= 2 THEN 'THEME_TAG_NOT_DERIVED' END) AS dq_codes FROM r""",
)
def requirement_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size"), F.col("p_partkey")
    rows = read_table(spark, sf_dir, "part").select(
        k.alias("campaign_id"), F.when(n % 4 == 0, "หญิง 70% / ชาย 30%").when(n % 4 == 1, "ผู้หญิง").when(n % 4 == 2, "").otherwise("any").alias("target_gender_raw"), F.when(n % 3 == 0, "18-24 ปี").when(n % 3 == 1, "90-99").otherwise("").alias("target_age_raw"),
        F.when(n % 5 == 0, "Skincare fans").when(n % 5 == 1, "Accessory").otherwise("people").alias("persona_raw"), F.lit("").alias("target_content_raw"), F.lit("").alias("content_style_raw"), F.lit("").alias("pain_point_raw"), F.lit("").alias("tier_sections_raw"),
        F.lit("Tik Tok").alias("platform_raw"), F.when(k % 2 == 0, "explicit_source_fields").otherwise("partial_source_fields").alias("requirement_status"),
    )
    r = normalize_requirements(rows)
    return r.select("campaign_id", "target_gender_mode", "female_target_share", "target_age_min", F.array_join("theme_tags", ";").alias("theme_tags"), "fit_readiness", "normalization_confidence", F.array_join("dq_codes", ";").alias("dq_codes"))


@query(
    "parse_number",
    """WITH x AS (SELECT o_orderkey AS k, CAST(o_orderkey % 900 + 1 AS VARCHAR) AS n FROM orders)
    SELECT k, CASE k % 6 WHEN 0 THEN CAST(n AS DOUBLE) * 1000 WHEN 1 THEN CAST('1' || lpad(n, 3, '0') AS DOUBLE) WHEN 2 THEN CAST(n AS DOUBLE) / 100 WHEN 3 THEN CAST(n || '.5' AS DOUBLE) WHEN 4 THEN NULL ELSE CAST(n AS DOUBLE) * 1000000 END AS snapshot_number,
      CASE k % 6 WHEN 0 THEN CAST(n AS DOUBLE) * 1000 WHEN 1 THEN CAST('1' || lpad(n, 3, '0') AS DOUBLE) WHEN 2 THEN CAST(n AS DOUBLE) WHEN 3 THEN CAST(n || '5' AS DOUBLE) END AS metric FROM x""",
)
def number_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = (k % 900 + 1).cast("string")
    raw = F.when(k % 6 == 0, F.concat(n, F.lit("K"))).when(k % 6 == 1, F.concat(F.lit("1,"), F.lpad(n, 3, "0"))).when(k % 6 == 2, F.concat(n, F.lit("%"))).when(k % 6 == 3, F.concat(n, F.lit(",5"))).when(k % 6 == 4, "#N/A").otherwise(F.concat(n, F.lit("m")))
    return read_table(spark, sf_dir, "orders").select(k.alias("k"), parse_number(raw, percent=True).alias("snapshot_number"), parse_metric(raw).alias("metric"))


@query(
    "parse_fee",
    """SELECT k, CASE k % 7 WHEN 0 THEN 'free' WHEN 1 THEN 'barter' WHEN 2 THEN 'hourly' WHEN 3 THEN 'pending' WHEN 4 THEN 'missing' WHEN 5 THEN 'fixed' ELSE 'unknown' END AS fee_model, CASE k % 7 WHEN 0 THEN 0.0 :: DOUBLE WHEN 1 THEN 0.0 :: DOUBLE WHEN 2 THEN 1500.0 :: DOUBLE WHEN 5 THEN CAST(k AS DOUBLE) END AS fee_amount,
    CASE WHEN k % 7 IN (0, 1, 5) THEN 'campaign' WHEN k % 7 = 2 THEN 'hour' ELSE '' END AS fee_unit FROM (SELECT o_orderkey AS k FROM orders)""",
)
def fee_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 7 == 0, "*Free*").when(k % 7 == 1, "Barter No Budget").when(k % 7 == 2, "1,500/hr").when(k % 7 == 3, "ยังไม่ตอบกลับ").when(k % 7 == 4, " - ").when(k % 7 == 5, k.cast("string")).otherwise("ask")
    return read_table(spark, sf_dir, "orders").select(k.alias("k"), parse_fee(raw).alias("f")).select("k", F.col("f.model").alias("fee_model"), F.col("f.amount").alias("fee_amount"), F.col("f.unit").alias("fee_unit"))


def scanned_texts(docs: DataFrame) -> DataFrame:
    """docs with `scanned`: the whole text, and behind it the made-up phone, parcel or address forms of four documents in six."""
    k = F.col("doc_id")
    form = F.when(k % 6 == 0, " 081-234-5678").when(k % 6 == 1, F.concat(F.lit(" tel: 12 34 56 78 90 "), F.coalesce("source", F.lit("")))).when(k % 6 == 2, " WB222936496TH").when(k % 6 == 3, " ถนน 5 แขวง x").otherwise("")
    return docs.withColumn("scanned", F.concat(F.coalesce("text", F.lit("")), form))


@query(
    "pii_scan",
    r"""WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN left(text, 200) || ' 081-234-5678' WHEN 1 THEN 'tel: 12 34 56 78 90 ' || source WHEN 2 THEN 'WB222936496TH' WHEN 3 THEN 'ถนน 5 แขวง x' ELSE text END AS t FROM documents)
    SELECT doc_id, regexp_matches(t, '(^|[^0-9])0([\s-]?[0-9]){8,9}($|[^0-9])') OR (contains(lower(t), 'tel:') AND length(regexp_replace(t, '[^0-9]', '', 'g')) >= 9) OR (contains(t, 'ถนน') AND contains(t, 'แขวง') AND regexp_matches(t, '[0-9]')) OR regexp_matches(t, '(?i)\b[A-Z]{2}\s*[0-9]{9}\s*TH\b') AS is_pii FROM t""",
)
def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned_texts(read_table(spark, sf_dir, "documents")).select("doc_id", looks_like_pii(F.col("scanned")).alias("is_pii"))


@query("excel_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN strftime(DATE '1899-12-30' + CAST(40000 + o_orderkey % 15000 AS INTEGER), '%Y-%m-%d') ELSE 'TBC' END AS posted_date FROM orders")
def excel_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, "#N/A").when(k % 3 == 1, (F.lit(40000) + k % 15000).cast("string")).otherwise(" TBC ")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", excel_date(raw).alias("posted_date"))
