"""Campaign history: registries, facts by campaign and influencer, requirements, budgets, summaries, marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import query, read_table
from tidemill.functions.identity import stable_id
from tidemill.functions.text import codes, normalized
from tidemill.operators.dedupe import first_of_each
from tidemill.plans.proxy import FACT_SQL, OBSERVATIONS_SQL, deliverables, masters, observations, performance, registry

#: Order in which a campaign's budgets are preferred.
BUDGET_PRECEDENCE = {"influencer_tiktok": 0, "candidate_pool_unspecified": 1, "campaign_total": 2}


def registries(mapping: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """(brands, campaigns) of a campaign map; of several rows of a brand the first gives its name."""
    m = mapping.withColumns(
        {
            "brand_id": stable_id("brd", normalized(F.col("canonical_brand_name"))),
            "campaign_id": stable_id("cmp", F.lower("source_filename"), F.lower("source_sheet_name")),
        }
    )
    brands = first_of_each(m, ["brand_id"], [order]).select("brand_id", "canonical_brand_name")
    campaigns = first_of_each(m, ["campaign_id"], [order]).select(
        "campaign_id", "brand_id", "source_filename", "source_sheet_name",
        F.coalesce("campaign_period_label", F.lit("unspecified")).alias("campaign_period_label"), F.coalesce("platform", F.lit("tiktok")).alias("platform"),
    )
    return brands, campaigns


def attach_campaign(rows: DataFrame, campaigns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with campaign_id, rows of unmapped sheets) by file and sheet."""
    keys = ["source_filename", "source_sheet_name"]
    joined = rows.join(campaigns.select(*keys, "campaign_id", "brand_id"), keys, "left")
    return joined.where("campaign_id is not null"), joined.where("campaign_id is null").select(*rows.columns)


def tri_state(flag: Column, label: str) -> Column:
    """conflict, label, not_label or unknown from a group's flags; nulls are no evidence."""
    yes, no = F.count_if(flag), F.count_if(~flag)
    return F.when((yes > 0) & (no > 0), "conflict").when(yes > 0, label).when(no > 0, f"not_{label}").otherwise("unknown")


def campaign_facts(obs: DataFrame) -> DataFrame:
    """One row a (campaign, influencer) of observations; conflicts are shown, not resolved."""
    spread = lambda c: [F.min(c).alias(f"{c}_snapshot_min"), F.max(c).alias(f"{c}_snapshot_max")]
    n_fees = F.count_distinct("fee")
    fact = obs.groupBy("campaign_id", "influencer_id").agg(
        F.count("*").alias("observation_count"),
        tri_state(F.col("selected"), "selected").alias("selected_status"),
        tri_state(F.col("confirmed"), "confirmed").alias("confirmed_status"),
        F.when(n_fees == 0, "missing").when(n_fees == 1, "consistent").otherwise("conflict").alias("fee_status"),
        F.min("fee").alias("fee_min"),
        F.max("fee").alias("fee_max"),
        *spread("follower"),
        *spread("engagement"),
        F.count_distinct("source_filename").alias("workbook_count"),
    )
    found = codes(
        (F.col("observation_count") > 1, "DQ_DUPLICATE_CAMPAIGN_INFLUENCER_SOURCE"),
        (F.col("selected_status") == "conflict", "DQ_SELECTED_STATUS_CONFLICT"),
        (F.col("confirmed_status") == "conflict", "DQ_CONFIRMED_STATUS_CONFLICT"),
        (F.col("fee_status") == "conflict", "DQ_FEE_CONFLICT"),
    )
    status = F.when(F.size(found) > 0, "WARN").otherwise("PASS")
    return fact.withColumns({"dq_codes": F.array_join(found, ";"), "campaign_history_dq_status": status})


def primary_budget(budgets: DataFrame) -> DataFrame:
    """The budget of each campaign by scope precedence, then the lowest source row."""
    precedence = F.coalesce(*[F.when(F.col("budget_scope") == s, F.lit(p)) for s, p in BUDGET_PRECEDENCE.items()], F.lit(9))
    picked = F.min_by(F.struct("budget_scope", "budget_amount", "source_row_number"), F.struct(precedence.alias("p"), F.col("source_row_number").alias("r")))
    return budgets.groupBy("campaign_id").agg(picked.alias("b")).select("campaign_id", F.col("b.budget_scope").alias("primary_budget_scope"), F.col("b.budget_amount").alias("primary_budget_amount"))


def campaign_summary(campaigns: DataFrame, facts: DataFrame, budgets: DataFrame | None = None) -> DataFrame:
    """One row a campaign, with zeros where there are no facts."""
    status = lambda column, value: F.count_if(F.col(column) == value)
    pre = facts.groupBy("campaign_id").agg(
        F.count("*").alias("candidate_count"),
        F.sum("observation_count").alias("observation_count"),
        status("selected_status", "selected").alias("selected_count"),
        status("selected_status", "not_selected").alias("not_selected_count"),
        status("selected_status", "conflict").alias("selected_conflict_count"),
        status("confirmed_status", "confirmed").alias("confirmed_count"),
        status("campaign_history_dq_status", "WARN").alias("warn_count"),
    )
    counts = [c for c in pre.columns if c != "campaign_id"]
    out = campaigns.join(pre, "campaign_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    return out if budgets is None else out.join(primary_budget(budgets), "campaign_id", "left")


def influencer_mart(masters: DataFrame, facts: DataFrame, deliverables: DataFrame, performance: DataFrame) -> DataFrame:
    """One row an influencer; every fact is aggregated before it is joined, so nothing fans out."""
    f = facts.groupBy("influencer_id").agg(
        F.count_distinct("campaign_id").alias("campaign_count"), F.count_if(F.col("selected_status") == "selected").alias("selected_campaign_count"),
        F.min("fee_min").alias("fee_min"), F.max("fee_max").alias("fee_max"), F.sum("observation_count").alias("observation_count"),
    )
    d = deliverables.groupBy("influencer_id").agg(F.count("*").alias("deliverable_count"), F.count_if("posted").alias("posted_deliverable_count"))
    p = performance.groupBy("influencer_id").agg(F.count("*").alias("performance_count"), F.sum("views").alias("views_total"), F.avg("views").alias("views_average"), F.sum("gmv").alias("gmv_total"))
    joined = masters.join(f, "influencer_id", "left").join(d, "influencer_id", "left").join(p, "influencer_id", "left")
    counts = ["campaign_count", "selected_campaign_count", "observation_count", "deliverable_count", "posted_deliverable_count", "performance_count"]
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})


def campaign_mart(campaigns: DataFrame, facts: DataFrame, deliverables: DataFrame, performance: DataFrame) -> DataFrame:
    """Quality counts of each campaign, with zeros for none."""
    f = facts.groupBy("campaign_id").agg(F.count("*").alias("candidate_count"), F.count_if(F.col("campaign_history_dq_status") == "WARN").alias("candidate_warn_count"))
    d = deliverables.groupBy("campaign_id").agg(F.count("*").alias("deliverable_count"), F.count_if(F.col("posted").isNull()).alias("deliverable_unknown_count"))
    p = performance.groupBy("campaign_id").agg(F.count("*").alias("performance_count"))
    joined = campaigns.join(f, "campaign_id", "left").join(d, "campaign_id", "left").join(p, "campaign_id", "left")
    counts = ["candidate_count", "candidate_warn_count", "deliverable_count", "deliverable_unknown_count", "performance_count"]
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})


@query(
    "fact_campaign_influencer",
    f"WITH {OBSERVATIONS_SQL}, {FACT_SQL} SELECT *, CASE WHEN dq_codes <> '' THEN 'WARN' ELSE 'PASS' END AS campaign_history_dq_status FROM fact_dq",
)
def fact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign_facts(observations(spark, sf_dir))


@query(
    "campaign_summary",
    f"""WITH {OBSERVATIONS_SQL}, {FACT_SQL}, bud AS (
      SELECT p_partkey AS campaign_id, CASE p_size % 3 WHEN 0 THEN 'influencer_tiktok' WHEN 1 THEN 'candidate_pool_unspecified' ELSE 'campaign_total' END AS primary_budget_scope, p_retailprice AS primary_budget_amount FROM part WHERE p_partkey % 2 = 0)
    SELECT p_partkey AS campaign_id, p_brand AS brand_id, CAST(count(f.campaign_id) AS BIGINT) AS candidate_count, CAST(coalesce(sum(observation_count), 0) AS BIGINT) AS observation_count,
      CAST(count(*) FILTER (WHERE selected_status = 'selected') AS BIGINT) AS selected_count, CAST(count(*) FILTER (WHERE selected_status = 'not_selected') AS BIGINT) AS not_selected_count,
      CAST(count(*) FILTER (WHERE selected_status = 'conflict') AS BIGINT) AS selected_conflict_count, CAST(count(*) FILTER (WHERE confirmed_status = 'confirmed') AS BIGINT) AS confirmed_count,
      CAST(count(*) FILTER (WHERE dq_codes <> '') AS BIGINT) AS warn_count, any_value(primary_budget_scope) AS primary_budget_scope, any_value(primary_budget_amount) AS primary_budget_amount
    FROM part LEFT JOIN fact_dq f ON p_partkey = f.campaign_id LEFT JOIN bud b ON p_partkey = b.campaign_id GROUP BY 1, 2""",
)
def summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    campaigns = registry(spark, sf_dir)
    scope = F.element_at(F.array(*[F.lit(s) for s in BUDGET_PRECEDENCE]), (F.col("p_size") % 3 + 1).cast("int"))
    first = read_table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("campaign_id"), scope.alias("budget_scope"), F.col("p_retailprice").alias("budget_amount"), F.lit(1).alias("source_row_number"))
    later = first.withColumn("source_row_number", F.lit(2)).withColumn("budget_amount", F.col("budget_amount") * 2)
    return campaign_summary(campaigns.select("campaign_id", "brand_id"), campaign_facts(observations(spark, sf_dir)), first.unionByName(later))


@query(
    "budget_primary_argmin",
    """WITH b AS (SELECT l_partkey AS campaign_id, CASE l_returnflag WHEN 'R' THEN 'influencer_tiktok' WHEN 'A' THEN 'candidate_pool_unspecified' ELSE 'campaign_total' END AS s,
        CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS p, l_orderkey * 10 + l_linenumber AS r, max(l_extendedprice) AS a FROM lineitem GROUP BY 1, 2, 3, 4)
    SELECT campaign_id, s AS primary_budget_scope, a AS primary_budget_amount FROM b QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY p, r) = 1""",
)
def budget_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read_table(spark, sf_dir, "lineitem")
    scope = F.when(F.col("l_returnflag") == "R", "influencer_tiktok").when(F.col("l_returnflag") == "A", "candidate_pool_unspecified").otherwise("campaign_total")
    row = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_row_number")
    budgets = x.groupBy(F.col("l_partkey").alias("campaign_id"), scope.alias("budget_scope"), row).agg(F.max("l_extendedprice").alias("budget_amount"))
    return primary_budget(budgets)


@query(
    "tri_state_bool",
    f"WITH {OBSERVATIONS_SQL}, {FACT_SQL} SELECT selected_status, confirmed_status, fee_status, CAST(count(*) AS BIGINT) AS n FROM fact GROUP BY 1, 2, 3",
)
def tri_state_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign_facts(observations(spark, sf_dir)).groupBy("selected_status", "confirmed_status", "fee_status").agg(F.count("*").alias("n"))


@query(
    "mart_influencer",
    f"""WITH {OBSERVATIONS_SQL}, {FACT_SQL},
    f AS (SELECT influencer_id, count(DISTINCT campaign_id) AS cc, count(*) FILTER (WHERE selected_status = 'selected') AS sc, min(fee_min) AS fmin, max(fee_max) AS fmax, sum(observation_count) AS oc FROM fact GROUP BY 1),
    d AS (SELECT l_suppkey AS influencer_id, count(*) AS dc, count(*) FILTER (WHERE o_orderstatus = 'F') AS pc FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    p AS (SELECT l_suppkey AS influencer_id, count(*) AS n, sum(l_quantity * 100) AS v, avg(l_quantity * 100) AS va, sum(l_extendedprice) AS g FROM lineitem GROUP BY 1)
    SELECT s_suppkey AS influencer_id, 'tiktok' AS platform, lower(s_name) AS canonical_handle, CAST(coalesce(cc, 0) AS BIGINT) AS campaign_count, CAST(coalesce(sc, 0) AS BIGINT) AS selected_campaign_count,
      fmin AS fee_min, fmax AS fee_max, CAST(coalesce(oc, 0) AS BIGINT) AS observation_count, CAST(coalesce(dc, 0) AS BIGINT) AS deliverable_count, CAST(coalesce(pc, 0) AS BIGINT) AS posted_deliverable_count,
      CAST(coalesce(n, 0) AS BIGINT) AS performance_count, round(v, 2) AS views_total, round(va, 4) AS views_average, round(g, 1) AS gmv_total
    FROM supplier LEFT JOIN f ON s_suppkey = f.influencer_id LEFT JOIN d ON s_suppkey = d.influencer_id LEFT JOIN p ON s_suppkey = p.influencer_id""",
)
def influencer_mart_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = influencer_mart(masters(spark, sf_dir).drop("identity_confidence"), campaign_facts(observations(spark, sf_dir)), deliverables(spark, sf_dir), performance(spark, sf_dir))
    return mart.withColumns({"views_total": F.round("views_total", 2), "views_average": F.round("views_average", 4), "gmv_total": F.round("gmv_total", 1)})


@query(
    "mart_campaign",
    f"""WITH {OBSERVATIONS_SQL}, {FACT_SQL},
    f AS (SELECT campaign_id, count(*) AS c, count(*) FILTER (WHERE dq_codes <> '') AS w FROM fact_dq GROUP BY 1),
    d AS (SELECT l_partkey AS campaign_id, count(*) AS c, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    p AS (SELECT l_partkey AS campaign_id, count(*) AS c FROM lineitem GROUP BY 1)
    SELECT p_partkey AS campaign_id, p_brand AS brand_id, CAST(coalesce(f.c, 0) AS BIGINT) AS candidate_count, CAST(coalesce(f.w, 0) AS BIGINT) AS candidate_warn_count, CAST(coalesce(d.c, 0) AS BIGINT) AS deliverable_count,
      CAST(coalesce(d.w, 0) AS BIGINT) AS deliverable_unknown_count, CAST(coalesce(p.c, 0) AS BIGINT) AS performance_count
    FROM part LEFT JOIN f ON p_partkey = f.campaign_id LEFT JOIN d ON p_partkey = d.campaign_id LEFT JOIN p ON p_partkey = p.campaign_id""",
)
def campaign_mart_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign_mart(registry(spark, sf_dir).select("campaign_id", "brand_id"), campaign_facts(observations(spark, sf_dir)), deliverables(spark, sf_dir), performance(spark, sf_dir))
