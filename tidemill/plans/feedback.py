"""Human review and its results: queue, validation, readiness, and observational evaluation that claims no cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.catalog import query, read_table
from tidemill.functions.parse import parse_float, source_truth
from tidemill.functions.text import safe_text
from tidemill.operators.dedupe import last_of_each
from tidemill.operators.ranking import review_priority, with_row_number

#: Decisions, and states of a campaign's execution.
HUMAN_DECISIONS = ["selected", "rejected", "hold"]
EXECUTION_STATES = ["completed", "cancelled", "in_progress"]
RESULT_FIELDS = ["execution_status", "result_observed_at", "business_success", "actual_fee", "content_posted", "views", "likes", "comments", "saves", "shares", "gmv", "sales_amount", "orders", "result_notes"]


def review_queue(shortlist: DataFrame, primary_limit: int = 10) -> DataFrame:
    """A pending review for each shortlisted row, by rank; a row without id or positive rank, or an id twice, fails."""
    fail = lambda text: F.raise_error(F.lit(text))
    times = F.count("*").over(Window.partitionBy("influencer_id"))
    iid = F.when(safe_text(F.col("influencer_id")) == "", fail("a shortlist row has no influencer_id").cast("string")).when(times > 1, fail("an influencer is shortlisted twice").cast("string")).otherwise(F.col("influencer_id").cast("string"))
    rank = F.when(F.coalesce(F.col("rank"), F.lit(0)) <= 0, fail("a shortlist rank isn't positive").cast("int")).otherwise(F.col("rank"))
    blank = {c: F.lit("") for c in ("human_decision", "human_decision_reason", "reviewer", "reviewed_at")}
    return shortlist.withColumns({"influencer_id": iid, "rank": rank, "review_priority": review_priority(F.col("rank"), primary_limit), "machine_recommendation": F.lit("shortlisted_for_human_review"), "decision_status": F.lit("pending")} | blank).orderBy("rank", "influencer_id")


def _numbered(errors: list[Column], line: Column) -> Column:
    return F.transform(F.array_compact(F.array(*errors)), lambda e: F.concat(F.lit("row "), line.cast("string"), F.lit(": "), e))


def review_errors(rows: DataFrame, order: Column, require_complete: bool = False) -> DataFrame:
    """(line, error) of review rows; lines count as in a CSV whose header is line 1. Ids and ranks repeat from their second row on."""
    nth = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("ord"))
    r = rows.withColumn("ord", order).withColumns({"nth_id": nth("influencer_id"), "nth_rank": nth("rank")})
    has = lambda c: safe_text(F.col(c)) != ""
    decision, rank = F.lower(safe_text(F.col("human_decision"))), F.col("rank").cast("int")
    errors = [
        F.when(~has("influencer_id"), "influencer_id is required").when(F.col("nth_id") > 1, F.concat(F.lit("duplicate influencer_id "), F.col("influencer_id").cast("string"))),
        F.when(F.coalesce(rank, F.lit(0)) <= 0, "positive rank is required").when(F.col("nth_rank") > 1, F.concat(F.lit("duplicate rank "), rank.cast("string"))),
        F.when((decision != "") & ~decision.isin(*HUMAN_DECISIONS), F.concat(F.lit("invalid human_decision "), decision)),
        *[F.when((decision != "") & ~has(c), F.lit(f"{c} is required when a decision is entered")) for c in ("human_decision_reason", "reviewer", "reviewed_at")],
        F.when((decision == "") & F.lit(require_complete), "human_decision is required"),
    ]
    return r.select((F.col("ord") + 2).alias("line"), F.explode(_numbered(errors, F.col("ord") + 2)).alias("error"))


def result_template(reviews: DataFrame) -> DataFrame:
    """A row a review for the campaign's result, with blank fields and what it waits for."""
    decision = F.lower(safe_text(F.col("human_decision")))
    status = F.when(decision == "selected", "waiting_for_campaign_result").when(decision == "", "waiting_for_human_decision").otherwise("not_applicable_until_selected")
    return reviews.select("influencer_id", "rank", "total_score", "human_decision", status.alias("feedback_status"), *[F.lit("").alias(c) for c in RESULT_FIELDS])


def result_errors(rows: DataFrame, order: Column) -> DataFrame:
    """(line, error) of result rows: enumerations, numbers, and what a completed campaign has to say."""
    r = rows.withColumn("ord", order).withColumn("nth_id", F.row_number().over(Window.partitionBy("influencer_id").orderBy("ord")))
    has = lambda c: safe_text(F.col(c)) != ""
    state = F.lower(safe_text(F.col("execution_status")))
    done = state == "completed"
    errors = [
        F.when(~has("influencer_id"), "influencer_id is required").when(F.col("nth_id") > 1, F.concat(F.lit("duplicate influencer_id "), F.col("influencer_id").cast("string"))),
        F.when((state != "") & ~state.isin(*EXECUTION_STATES), F.concat(F.lit("invalid execution_status "), state)),
        F.when(has("business_success") & source_truth(F.col("business_success")).isNull(), "business_success must be true or false"),
        F.when(done & ~has("business_success"), "business_success is required when completed"),
        F.when(done & ~has("result_observed_at"), "result_observed_at is required when completed"),
        *[F.when(has(c) & (parse_float(F.col(c)).isNull() | (parse_float(F.col(c)) < 0)), F.lit(f"{c} must be a number from 0")) for c in ("actual_fee", "views", "orders")],
    ]
    return r.select((F.col("ord") + 2).alias("line"), F.explode(_numbered(errors, F.col("ord") + 2)).alias("error"))


def readiness(reviews: DataFrame, results: DataFrame, success_definition: str | None) -> DataFrame:
    """One row: counts, and ready only if all is decided, something is selected, its results are complete and success is defined."""
    decision = F.lower(safe_text(F.col("human_decision")))
    done = results.where((F.lower(safe_text(F.col("execution_status"))) == "completed") & source_truth(F.col("business_success")).isNotNull()).select("influencer_id").distinct().withColumn("done", F.lit(True))
    joined = reviews.join(done, "influencer_id", "left")
    out = joined.agg(F.count("*").alias("review_count"), F.count_if(decision != "").alias("decided_count"), F.count_if(decision == "selected").alias("selected_count"), F.count_if((decision == "selected") & F.col("done").isNotNull()).alias("complete_result_count"))
    ready = (F.col("decided_count") == F.col("review_count")) & (F.col("selected_count") > 0) & (F.col("complete_result_count") == F.col("selected_count")) & F.lit(bool(success_definition))
    return out.withColumn("ready", ready)


def evaluate(reviews: DataFrame, results: DataFrame, success_definition: str, top_k: int, result_order: Column) -> DataFrame:
    """Rates of a finished loop: acceptance, mean rank and score, top-k and success rates of the selected. Raises where it isn't ready."""
    if not readiness(reviews, results, success_definition).first()["ready"]:
        raise ValueError("reviews or results aren't complete")
    last = last_of_each(results.withColumn("__o", result_order), ["influencer_id"], [F.col("__o")])
    joined = reviews.join(last.select("influencer_id", source_truth(F.col("business_success")).alias("success")), "influencer_id", "left")
    return rates(joined.withColumn("selected", F.lower(safe_text(F.col("human_decision"))) == "selected"), top_k)


def rates(rows: DataFrame, top_k: int) -> DataFrame:
    """Rates over rows(selected, rank, total_score, success)."""
    s = F.col("selected")
    n = F.count_if(s)
    return rows.agg(
        F.count("*").alias("review_count"), n.alias("selected_count"), F.try_divide(n, F.count("*")).alias("acceptance_rate"), F.avg(F.when(s, F.col("rank"))).alias("mean_selected_rank"), F.avg(F.when(s, F.col("total_score"))).alias("mean_selected_score"),
        F.try_divide(F.count_if(s & (F.col("rank") <= top_k)), n).alias("selected_within_top_k_rate"), F.try_divide(F.count_if(s & F.col("success")), n).alias("success_rate"), F.lit(False).alias("counterfactual_claim_allowed"),
    )


@query(
    "feedback_eval",
    """WITH r AS (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS k, c_acctbal AS s, c_custkey % 3 = 0 AS sel, c_custkey % 2 = 0 AS ok FROM customer)
    SELECT count(*) AS review_count, count(*) FILTER (WHERE sel) AS selected_count, round(count(*) FILTER (WHERE sel) / count(*), 6) AS acceptance_rate, round(avg(k) FILTER (WHERE sel), 4) AS mean_selected_rank, round(avg(s) FILTER (WHERE sel), 4) AS mean_selected_score,
      round(count(*) FILTER (WHERE sel AND k <= 30) / count(*) FILTER (WHERE sel), 6) AS selected_within_top_k_rate, round(count(*) FILTER (WHERE sel AND ok) / count(*) FILTER (WHERE sel), 6) AS success_rate, false AS counterfactual_claim_allowed FROM r""",
)
def feedback_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("influencer_id"), F.col("c_acctbal").alias("total_score"))
    ranked = with_row_number(c, [F.desc("total_score"), F.asc("influencer_id")], "rank")
    reviews = ranked.withColumn("human_decision", F.when(F.col("influencer_id") % 3 == 0, "selected").otherwise("rejected"))
    results = reviews.select("influencer_id", F.lit("completed").alias("execution_status"), F.when(F.col("influencer_id") % 2 == 0, "yes").otherwise("no").alias("business_success"))
    out = evaluate(reviews, results, "agreed definition", 30, F.lit(0))
    r = lambda name, n: F.round(name, n).alias(name)
    return out.select("review_count", "selected_count", r("acceptance_rate", 6), r("mean_selected_rank", 4), r("mean_selected_score", 4), r("selected_within_top_k_rate", 6), r("success_rate", 6), "counterfactual_claim_allowed")


@query(
    "review_validation",
    """WITH r AS (SELECT n_nationkey AS o, CASE WHEN n_nationkey % 9 = 0 THEN '' ELSE 'inf' || (n_nationkey % 20) END AS i, CASE WHEN n_nationkey % 4 = 0 THEN 'maybe' WHEN n_nationkey % 4 = 1 THEN '' ELSE 'selected' END AS d FROM nation)
    SELECT o + 2 AS line, 'row ' || (o + 2) || ': ' || e AS error FROM (SELECT o, 'influencer_id is required' AS e FROM r WHERE i = '' UNION ALL SELECT o, 'duplicate influencer_id ' || i FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY o) AS n FROM r) WHERE n > 1 AND i <> ''
      UNION ALL SELECT o, 'invalid human_decision maybe' FROM r WHERE d = 'maybe' UNION ALL SELECT o, 'reviewer is required when a decision is entered' FROM r WHERE d <> '')""",
)
def validation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = read_table(spark, sf_dir, "nation").select(
        k.alias("o"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("inf"), (k % 20).cast("string"))).alias("influencer_id"), (k + 1).alias("rank"), F.when(k % 4 == 0, "maybe").when(k % 4 == 1, "").otherwise("selected").alias("human_decision"),
        F.lit("why").alias("human_decision_reason"), F.lit("").alias("reviewer"), F.lit("2026-01-01").alias("reviewed_at"),
    )
    return review_errors(rows, F.col("o"))
