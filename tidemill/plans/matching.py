"""Explainable ranking: one global scenario (v1), and a replay by target campaign that leaves the target out (v2)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import ORACLES, query, read_table
from tidemill.config import WEIGHTS_V1, WEIGHTS_V2, MatchingConfig, MatchingV2Config
from tidemill.functions.requirements import age_fit, bounded_score, gender_fit, tag_coverage
from tidemill.functions.text import codes
from tidemill.operators.ranking import percentile_rank, ranked, review_priority, with_percentile_rank
from tidemill.plans.features import FEATURES_SQL, deliverable_features, fact_features, features_of, performance_features
from tidemill.plans.history import campaign_facts
from tidemill.plans.proxy import deliverables, masters, observations, performance, registry

V1 = MatchingConfig(
    weights={"historical_experience": 0.2, "cross_brand_experience": 0.15, "selection_history": 0.2, "view_performance": 0.15, "budget_headroom": 0.1, "operational_reliability": 0.1, "data_confidence": 0.1},
    max_fee=52000.0, campaign_count_cap=600, brand_count_cap=25,
)
V2 = MatchingV2Config(
    weights={
        "audience_gender_fit": 0.1, "audience_age_fit": 0.08, "theme_experience_fit": 0.12, "persona_experience_fit": 0.08, "content_style_experience_fit": 0.05, "historical_experience": 0.1,
        "cross_brand_experience": 0.07, "selection_history": 0.1, "view_performance": 0.1, "budget_headroom": 0.05, "operational_reliability": 0.05, "data_confidence": 0.1,
    },
    campaign_count_cap=600, brand_count_cap=25,
)


def points(*tests: tuple[Column, float]) -> Column:
    return reduce(add, [F.when(test, value).otherwise(0.0) for test, value in tests])


def percent(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def eligibility(cfg: MatchingConfig) -> Column:
    """Reasons against a candidate, in order."""
    fee = F.col("fee_observed_median")
    return codes(
        (F.lower("platform") != cfg.platform, "platform_mismatch"),
        (F.col("campaign_count") < cfg.minimum_campaign_count, "insufficient_campaign_history"),
        (fee.isNull() & F.lit(cfg.require_fee_history), "fee_history_required"),
        (fee > cfg.max_fee, "fee_over_budget"),
        (F.lit(cfg.reject_campaign_history_dq_warn) & (F.col("campaign_history_dq_warn_count") > 0), "campaign_history_dq_warn"),
    )


def confidence_v1() -> Column:
    return points(
        (F.col("identity_confidence") == "deterministic_exact", 10.0), (F.col("identity_confidence") == "reviewed_evidence", 8.0), (F.col("selected_known_campaign_count") > 0, 20.0),
        (F.col("has_fee_history"), 20.0), (F.col("has_performance_history"), 25.0), (F.col("has_post_history"), 15.0), (F.col("campaign_history_dq_warn_count") == 0, 10.0),
    )


def components_v1(cfg: MatchingConfig) -> dict[str, Column]:
    neutral = F.lit(float(cfg.neutral_missing_score))
    return {
        "historical_experience": bounded_score(F.col("campaign_count"), cfg.campaign_count_cap),
        "cross_brand_experience": bounded_score(F.col("brand_count"), cfg.brand_count_cap),
        "selection_history": F.coalesce(F.col("selected_rate") * 100, neutral),
        "view_performance": F.coalesce("view_percentile", neutral),
        "budget_headroom": F.coalesce(percent((1 - F.col("fee_observed_median") / cfg.max_fee) * 100), neutral),
        "operational_reliability": F.coalesce(F.col("posted_rate") * 100, neutral),
        "data_confidence": confidence_v1(),
    }


def sentences(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), " | ")


def reasons_v1(cfg: MatchingConfig) -> Column:
    """Human-readable reasons; figures are rounded half to even."""
    number = lambda c, n: F.format_number(F.bround(c, n), n)
    return sentences(
        F.concat(F.lit("Seen in "), F.col("campaign_count").cast("string"), F.lit(" campaigns of "), F.col("brand_count").cast("string"), F.lit(" brands.")),
        F.when(F.col("selected_rate").isNotNull(), F.concat(F.lit("Selected in "), number(F.col("selected_rate") * 100, 1), F.lit("% of known outcomes."))),
        F.when(F.col("views_record_count") > 0, F.concat(F.lit("View score "), number(F.col("view_performance_score"), 1), F.lit(" of 100 among the eligible."))),
        F.when(F.col("fee_observed_median").isNotNull(), F.concat(F.lit("Median fee "), number(F.col("fee_observed_median"), 0), F.lit(f" is within the cap of {cfg.max_fee:,.0f}."))),
        F.when(F.col("has_post_history"), F.lit("Post status is known for deliverables.")),
        F.concat(F.lit("Data confidence "), number(F.col("data_confidence_score"), 1), F.lit(" of 100.")),
    )


def cautions_v1() -> Column:
    return sentences(
        F.when(~F.col("has_performance_history"), F.lit("No performance history: neutral view score.")),
        F.when(~F.col("has_post_history"), F.lit("No post-status history: neutral operational score.")),
        F.when(F.abs("fee_observed_median") < 1e-12, F.lit("Median fee is 0, which may be free, barter or a source's convention.")),
        F.when(F.col("campaign_history_dq_warn_count") > 0, F.lit("Campaign history has data-quality warnings.")),
        F.when(F.col("identity_confidence") == "reviewed_evidence", F.lit("Identity rests on reviewed evidence.")),
    )


def rank_candidates(features: DataFrame, cfg: MatchingConfig) -> DataFrame:
    """features with scores, eligibility, explanation and rank; view percentiles are taken among the eligible."""
    judged = features.withColumn("eligibility_reasons", eligibility(cfg)).withColumn("is_eligible", F.size("eligibility_reasons") == 0)
    with_views = judged.withColumn("log_views", F.when(F.col("is_eligible") & (F.col("views_median") >= 0), F.log1p("views_median")))
    placed = with_percentile_rank(with_views, "log_views", "view_percentile")
    when = lambda c: F.when(F.col("is_eligible"), c)
    scored = placed.withColumns({f"{k}_score": when(c) for k, c in components_v1(cfg).items()})
    total = reduce(add, [F.col(f"{k}_score") * F.lit(float(cfg.weights[k])) for k in WEIGHTS_V1])
    told = scored.withColumns({"total_score": total, "positive_reasons": when(reasons_v1(cfg)), "cautions": when(cautions_v1())})
    order = [F.desc("total_score"), F.desc("data_confidence_score"), F.desc("view_performance_score"), F.asc_nulls_last("fee_observed_median"), F.asc("canonical_handle"), F.asc("influencer_id")]
    out = ranked(told, F.col("is_eligible"), order)
    return out.withColumns({"eligibility_status": F.when(F.col("is_eligible"), "eligible").otherwise("ineligible"), "eligibility_reasons": F.array_join("eligibility_reasons", " | "), "scenario_id": F.lit(cfg.scenario_id)}).drop("log_views", "is_eligible")


def shortlist(ranked_rows: DataFrame, cfg: MatchingConfig | MatchingV2Config) -> DataFrame:
    """The first of the eligible, as many as the configuration says for each target."""
    return ranked_rows.where((F.col("eligibility_status") == "eligible") & (F.col("rank") <= cfg.shortlist_size))


#: Targets of one replay, whose list is broadcast.
MOST_TARGETS = 10_000

# --- v2 ---------------------------------------------------------------------------------------------------------


def without_target(rows: DataFrame, targets: DataFrame, features: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """features of every (target, influencer) without the target campaign's own rows.

    Only influencers with rows of the target are computed anew for it; all others have the features of
    their whole history. So rows aren't multiplied by the targets. The targets are a bounded list.
    """
    return _without_target(rows, bounded(targets), features)


def bounded(targets: DataFrame) -> DataFrame:
    """targets, if they are few enough to be broadcast."""
    if targets.count() > MOST_TARGETS:
        raise ValueError(f"a replay takes at most {MOST_TARGETS:,} targets at once; pass them in parts")
    return targets


def _without_target(rows: DataFrame, targets: DataFrame, features: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    keys, t = ["target_campaign_id", "influencer_id"], F.broadcast(targets.select("target_campaign_id"))
    touched = rows.join(t, F.col("campaign_id") == F.col("target_campaign_id")).select(*keys).distinct()
    whole = features(rows, ["influencer_id"]).crossJoin(t).join(touched, keys, "left_anti")
    again = features(rows.join(touched, "influencer_id").where(F.col("campaign_id") != F.col("target_campaign_id")), keys)
    return whole.unionByName(again)


def leakage_audit(targets: DataFrame, **rows: DataFrame) -> DataFrame:
    """Rows of each target that are left out, by kind."""
    out = targets.select("target_campaign_id")
    for name, df in rows.items():
        counted = df.join(F.broadcast(targets.select("target_campaign_id")), F.col("campaign_id") == F.col("target_campaign_id")).groupBy("target_campaign_id").agg(F.count("*").alias(f"excluded_{name}"))
        out = out.join(counted, "target_campaign_id", "left").withColumn(f"excluded_{name}", F.coalesce(f"excluded_{name}", F.lit(0)).cast("long"))
    return out.withColumn("leakage_guard_status", F.lit("PASS"))


def tag_history(pairs: DataFrame, tag_columns: list[str], keys: list[str]) -> DataFrame:
    """Distinct tags of the campaigns of each of `keys`; a (key, campaign) pair counts once."""
    once = pairs.dropDuplicates([*keys, "campaign_id"])
    return once.groupBy(*keys).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(f"{c}_history") for c in tag_columns])


def only_there(pairs: DataFrame, tags: str) -> DataFrame:
    """(target_campaign_id, influencer_id, __only): the tags that an influencer has by no other campaign."""
    each = pairs.select("influencer_id", "campaign_id", F.explode(tags).alias("tag")).groupBy("influencer_id", "tag").agg(F.min("campaign_id").alias("target_campaign_id"), F.max("campaign_id").alias("last"))
    return each.where(F.col("target_campaign_id") == F.col("last")).groupBy("target_campaign_id", "influencer_id").agg(F.collect_list("tag").alias("__only"))


def target_context(people: DataFrame, campaigns: DataFrame, facts: DataFrame, delivered: DataFrame, performed: DataFrame, targets: DataFrame, audience: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """Features of every (target, influencer) without the target's own rows.

    Features of the whole history are joined once an influencer, with the targets that it has rows of,
    and only then meet the targets, without a shuffle; the pairs with rows of the target are added.
    """
    keys, targets = ["target_campaign_id", "influencer_id"], bounded(targets)
    parts = [
        (facts, lambda rows, by: fact_features(rows, campaigns, by)),
        (delivered, deliverable_features),
        (performed, performance_features),
    ]
    if audience is not None:
        parts.append((audience, dominant_audience))
    t = F.broadcast(targets.select("target_campaign_id"))
    touched = [rows.join(t, F.col("campaign_id") == F.col("target_campaign_id")).select(*keys).distinct() for rows, _ in parts]
    any_touched = reduce(DataFrame.unionByName, touched).distinct()
    whole, names = people, []
    for rows, features in parts:
        own = features(rows, ["influencer_id"])
        names.append([c for c in own.columns if c != "influencer_id"])
        whole = whole.join(own, "influencer_id", "left")
    tag_columns = [c for c in tags.columns if c.endswith("_tags")] if tags is not None else []
    if tags is not None:
        tagged = facts.select("influencer_id", "campaign_id").distinct().join(tags, "campaign_id")
        whole = whole.join(tag_history(tagged, tag_columns, ["influencer_id"]), "influencer_id", "left")
    n = int(people.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = any_touched.groupBy("influencer_id").agg(F.collect_list("target_campaign_id").alias("__touched"))
    dealt = whole.join(seen, "influencer_id", "left").repartition(n, "influencer_id")
    rest = dealt.crossJoin(t).where(F.col("__touched").isNull() | ~F.array_contains("__touched", F.col("target_campaign_id"))).drop("__touched")
    again = any_touched.join(whole, "influencer_id")
    for (rows, features), pairs_of, own in zip(parts, touched, names, strict=True):
        left = features(rows.join(pairs_of, "influencer_id").where(F.col("campaign_id") != F.col("target_campaign_id")), keys)
        new = pairs_of.join(left, keys, "left").select(*keys, F.struct(*own).alias("__new"))
        again = again.join(new, keys, "left").withColumns({c: F.when(F.col("__new").isNull(), F.col(c)).otherwise(F.col("__new")[c]) for c in own}).drop("__new")
    for c in tag_columns:
        again = again.join(only_there(tagged, c), keys, "left").withColumn(f"{c}_history", F.array_except(f"{c}_history", F.coalesce("__only", F.array().cast("array<string>")))).drop("__only")
    counts = ["campaign_count", "brand_count", "selected_known_campaign_count", "campaign_history_dq_warn_count", "fee_known_campaign_count", "posted_known_deliverable_count", "performance_record_count", "views_record_count"]
    return rest.unionByName(again).withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})


def dominant_audience(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent gender and age band of each key; of equally frequent ones the first seen by `ord`."""

    def dominant(value: str, name: str) -> DataFrame:
        counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"), F.min("ord").alias("o"))
        return counted.groupBy(*keys).agg(F.max_by(value, F.struct("c", -F.col("o"))).alias(f"{name}_dominant"), F.sum("c").alias(f"{name}_count"), (F.max("c") / F.sum("c")).alias(f"{name}_share"))

    return dominant("gender", "gender").join(dominant("age_band", "age"), keys, "full_outer")


def confidence_v2() -> Column:
    tags = [F.coalesce(F.size(f"{t}_tags_history"), F.lit(0)) for t in ("theme", "persona", "style")]
    return points(
        (F.col("identity_confidence") == "deterministic_exact", 10.0), (F.col("identity_confidence") == "reviewed_evidence", 8.0), (F.col("selected_known_campaign_count") > 0, 15.0),
        (F.col("fee_known_campaign_count") > 0, 10.0), (F.col("performance_record_count") > 0, 20.0), (F.col("posted_known_deliverable_count") > 0, 15.0), (F.col("gender_count") > 0, 10.0),
        (F.col("age_count") > 0, 10.0), (F.greatest(*tags) > 0, 5.0), (F.col("campaign_history_dq_warn_count") == 0, 5.0),
    )


def components_v2(cfg: MatchingV2Config) -> dict[str, Column]:
    """Component scores; null where the target doesn't ask for the dimension."""
    neutral = float(cfg.neutral_missing_score)
    fee, cap = F.col("fee_observed_median"), F.col("budget_cap")
    band = F.split("age_dominant", "-")
    low, high = (F.try_element_at(band, F.lit(i)).try_cast("int") for i in (1, 2))
    return {
        "audience_gender_fit": gender_fit(F.col("target_gender_mode"), F.col("female_target_share"), F.col("male_target_share"), F.col("gender_dominant"), F.col("gender_count"), neutral),
        "audience_age_fit": age_fit(F.col("target_age_min"), F.col("target_age_max"), low, high, neutral),
        "theme_experience_fit": tag_coverage(F.col("theme_tags"), F.col("theme_tags_history")),
        "persona_experience_fit": tag_coverage(F.col("persona_tags"), F.col("persona_tags_history")),
        "content_style_experience_fit": tag_coverage(F.col("style_tags"), F.col("style_tags_history")),
        "historical_experience": bounded_score(F.col("campaign_count"), cfg.campaign_count_cap),
        "cross_brand_experience": bounded_score(F.col("brand_count"), cfg.brand_count_cap),
        "selection_history": F.coalesce(F.col("selected_rate") * 100, F.lit(neutral)),
        "view_performance": F.coalesce("view_percentile", F.lit(neutral)),
        "budget_headroom": F.when(cap.isNotNull(), F.coalesce(percent((1 - fee / cap) * 100), F.lit(neutral))),
        "operational_reliability": F.coalesce(F.col("posted_rate") * 100, F.lit(neutral)),
        "data_confidence": confidence_v2(),
    }


def reasons_v2() -> tuple[Column, Column]:
    """(reasons, cautions) of a replayed score."""
    number = lambda c: F.format_number(F.bround(c, 1), 1)
    covers = lambda c, label: F.when(F.col(f"{c}_score") > 0, F.concat(F.lit(f"Past {label} exposure covers "), number(F.col(f"{c}_score")), F.lit("% of target tags.")))
    misses = lambda c, label: F.when(F.col(f"{c}_score") == 0, F.lit(f"No other {label} exposure matches the target tags."))
    kinds = [("theme_experience_fit", "theme"), ("persona_experience_fit", "persona"), ("content_style_experience_fit", "content-style")]
    fits = [F.when(F.col(f"audience_{k}_fit_score").isNotNull(), F.concat(F.lit(f"Audience {k} fit "), number(F.col(f"audience_{k}_fit_score")), F.lit(" of 100."))) for k in ("gender", "age")]
    positive = sentences(F.lit("The target's own evidence was left out before aggregation."), *fits, *[covers(*k) for k in kinds])
    caution = sentences(
        *[misses(*k) for k in kinds],
        F.when(F.col("budget_cap").isNull(), F.lit("No cap for a single influencer is set for the target.")).when(F.col("fee_observed_median").isNull(), F.lit("No other exact fee: neutral budget score.")),
        F.when(F.coalesce("gender_count", F.lit(0)) == 0, F.lit("No other audience-gender evidence: neutral score.")),
        F.when(F.coalesce("age_count", F.lit(0)) == 0, F.lit("No other audience-age evidence: neutral score.")),
        F.when(F.col("campaign_history_dq_warn_count") > 0, F.lit("Other campaign history has data-quality warnings.")),
    )
    return positive, caution


def score_targets(context: DataFrame, targets: DataFrame, cfg: MatchingV2Config) -> DataFrame:
    """Scores and ranks of every (target, influencer); weights of dimensions that a target doesn't ask for drop out."""
    cap = F.when(F.col("primary_budget_scope").isin(*cfg.individual_budget_scopes), F.col("primary_budget_amount"))
    t = targets.withColumn("budget_cap", cap).withColumnRenamed("platform", "target_platform")
    joined = context.join(F.broadcast(t), "target_campaign_id")
    against = codes((F.lower("platform") != F.lower("target_platform"), "platform_mismatch"), (F.col("fee_observed_median") > F.col("budget_cap"), "fee_over_explicit_individual_budget"))
    ok, view = F.size("eligibility_reasons") == 0, "view_performance"
    weight = lambda k: F.lit(float(cfg.weights[k]))
    part = lambda k: F.coalesce(F.col(f"{k}_score") * weight(k), F.lit(0.0))
    scored = joined.withColumns({f"{k}_score": c for k, c in components_v2(cfg).items() if k != view} | {"eligibility_reasons": against})
    positive, caution = reasons_v2()
    # what doesn't depend on the other candidates is known before the rows meet by target, so that no histories travel
    at = WEIGHTS_V2.index(view)
    active = reduce(add, [weight(k) if k == view else F.when(F.col(f"{k}_score").isNotNull(), weight(k)).otherwise(0.0) for k in WEIGHTS_V2])
    known = scored.withColumns(
        {"active_weight_sum": active, "__before": reduce(add, [part(k) for k in WEIGHTS_V2[:at]], F.lit(0.0)), "eligibility_status": F.when(ok, "eligible").otherwise("ineligible"), "positive_reasons": positive, "cautions": caution}
    )
    met = known.repartition(int(context.sparkSession.conf.get("spark.sql.shuffle.partitions")), "target_campaign_id")
    placed = met.withColumn("view_percentile", percentile_rank(F.col("views_median"), ["target_campaign_id"]))
    placed = placed.withColumn(f"{view}_score", components_v2(cfg)[view])
    total = reduce(add, [part(k) for k in WEIGHTS_V2[at:]], F.col("__before"))
    told = placed.withColumn("total_score", F.when(F.col("eligibility_status") == "eligible", total / F.col("active_weight_sum"))).drop("__before")
    out = ranked(told, F.col("eligibility_status") == "eligible", [F.desc("total_score"), F.asc("canonical_handle"), F.asc("influencer_id")], ["target_campaign_id"])
    return out.withColumns({"eligibility_reasons": F.array_join("eligibility_reasons", ";"), "scenario_id": F.concat(F.lit("replay_"), F.col("target_campaign_id").cast("string"), F.lit("_matching_v2"))})


def run_metadata(scored: DataFrame) -> DataFrame:
    """One row a target: candidates, eligible, best score, weight in use."""
    return scored.groupBy("scenario_id", "target_campaign_id").agg(F.count("*").alias("candidate_count"), F.count_if(F.col("eligibility_status") == "eligible").alias("eligible_count"), F.max("total_score").alias("best_score"), F.max("active_weight_sum").alias("active_weight_sum"))


# --- queries ----------------------------------------------------------------------------------------------------

V1_SQL = (
    FEATURES_SQL
    + """, e AS (SELECT *, CASE WHEN campaign_count >= 1 AND fee_median IS NOT NULL AND fee_median <= 52000 THEN true ELSE false END AS ok FROM features),
  w AS (SELECT *, count(*) OVER (PARTITION BY ok AND views_median IS NOT NULL) AS n, rank() OVER (PARTITION BY ok AND views_median IS NOT NULL ORDER BY views_median) AS r, count(*) OVER (PARTITION BY ok, views_median) AS c FROM e),
  s AS (SELECT *, CASE WHEN ok THEN least(100, campaign_count * 100 / 600) END AS s1, CASE WHEN ok THEN least(100, brand_count * 100 / 25) END AS s2, CASE WHEN ok THEN coalesce(selected_rate * 100, 50) END AS s3,
    CASE WHEN ok THEN CASE WHEN views_median IS NULL THEN 50 WHEN n = 1 THEN 100 ELSE (r + (c - 1) / 2 - 1) * 100 / (n - 1) END END AS s4, CASE WHEN ok THEN greatest(0, (1 - fee_median / 52000) * 100) END AS s5, CASE WHEN ok THEN coalesce(posted_rate * 100, 50) END AS s6,
    CASE WHEN ok THEN CASE identity_confidence WHEN 'deterministic_exact' THEN 10 ELSE 8 END + CASE WHEN selk > 0 THEN 20 ELSE 0 END + CASE WHEN fees > 0 THEN 20 ELSE 0 END + CASE WHEN perf > 0 THEN 25 ELSE 0 END + CASE WHEN postk > 0 THEN 15 ELSE 0 END + CASE WHEN warn = 0 THEN 10 ELSE 0 END END AS s7 FROM w),
  t AS (SELECT *, s1 * 0.2 + s2 * 0.15 + s3 * 0.2 + s4 * 0.15 + s5 * 0.1 + s6 * 0.1 + s7 * 0.1 AS total FROM s),
  x AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY total DESC, s7 DESC, s4 DESC, fee_median ASC NULLS LAST, canonical_handle, influencer_id) AS k FROM t)"""
)


@query("match_v1_rank", V1_SQL + " SELECT influencer_id, CASE WHEN ok THEN 'eligible' ELSE 'ineligible' END AS eligibility_status, round(s4, 4) AS view_performance_score, round(total, 4) AS total_score, CASE WHEN ok THEN CAST(k AS INTEGER) END AS rank FROM x")
def v1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rank_candidates(features_of(spark, sf_dir), V1)
    return out.select("influencer_id", "eligibility_status", F.round("view_performance_score", 4).alias("view_performance_score"), F.round("total_score", 4).alias("total_score"), "rank")


@query("shortlist_topk", V1_SQL + " SELECT influencer_id, CAST(k AS INTEGER) AS rank, CASE WHEN k <= 10 THEN 'primary_review' ELSE 'backup_review' END AS review_priority FROM x WHERE ok AND k <= 30")
def shortlist_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortlist(rank_candidates(features_of(spark, sf_dir), V1), V1).select("influencer_id", "rank", review_priority(F.col("rank"), 10).alias("review_priority"))


@query(
    "percentile_rank_avg",
    """WITH x AS (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) AS r, count(*) OVER (PARTITION BY p_size) AS c, count(*) OVER () AS n FROM part)
    SELECT p_partkey, round(CASE WHEN n = 1 THEN 100 ELSE (r + (c - 1) / 2 - 1) * 100 / (n - 1) END, 6) AS size_percentile FROM x""",
)
def percentile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_percentile_rank(read_table(spark, sf_dir, "part"), "p_size", "size_percentile").select("p_partkey", F.round("size_percentile", 6).alias("size_percentile"))


def replay_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of one size as target campaigns, a list that a replay is bounded by."""
    words = F.split("campaign_name", " ")
    return registry(spark, sf_dir).where("p_size = 7").select(
        F.col("campaign_id").alias("target_campaign_id"), F.lit("tiktok").alias("platform"), F.lit("all").alias("target_gender_mode"), F.lit(0.5).alias("female_target_share"), F.lit(0.5).alias("male_target_share"),
        F.lit(18).alias("target_age_min"), F.lit(34).alias("target_age_max"), F.array_distinct(words).alias("theme_tags"), F.array(F.col("campaign_type")).alias("persona_tags"), F.array().cast("array<string>").alias("style_tags"),
        F.lit("influencer_tiktok").alias("primary_budget_scope"), F.lit(45000.0).alias("primary_budget_amount"),
    )


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    campaigns, obs = registry(spark, sf_dir), observations(spark, sf_dir)
    tags = campaigns.select("campaign_id", F.array_distinct(F.split("campaign_name", " ")).alias("theme_tags"), F.array("campaign_type").alias("persona_tags"), F.array().cast("array<string>").alias("style_tags"))
    audience = obs.select(
        "campaign_id", "influencer_id", F.when(F.col("selected"), "female").when(~F.col("selected"), "male").alias("gender"),
        F.when(F.col("confirmed"), "18-24").otherwise("25-34").alias("age_band"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    targets = replay_targets(spark, sf_dir)
    context = target_context(masters(spark, sf_dir), campaigns, campaign_facts(obs), deliverables(spark, sf_dir), performance(spark, sf_dir), targets, audience, tags)
    return score_targets(context, targets, V2)


@query(
    "match_v2_replay",
    """WITH tg AS (SELECT p_partkey AS t, p_name, p_type FROM part WHERE p_size = 7),
    st AS (SELECT l_partkey AS campaign_id, l_suppkey AS i, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_returnflag = 'A') AS b, count(*) FILTER (WHERE l_linestatus = 'F') AS c1, count(*) FILTER (WHERE l_linestatus = 'O') AS c0,
      count(DISTINCT l_extendedprice) AS nf, min(l_extendedprice) AS fee FROM lineitem GROUP BY 1, 2),
    ex AS (SELECT t, i, count(*) AS cc, count(DISTINCT p_brand) AS bc, count(*) FILTER (WHERE a > 0 AND b = 0) AS sel, count(*) FILTER (WHERE (a > 0) <> (b > 0)) AS selk, count(*) FILTER (WHERE n > 1) AS warn, count(*) FILTER (WHERE nf = 1) AS fees,
      median(CASE WHEN nf = 1 THEN fee END) AS fee, list_distinct(flatten(list(string_split(st_name, ' ')))) AS themes, list(DISTINCT st_type) AS types FROM (SELECT st.*, p_brand, p_name AS st_name, p_type AS st_type FROM st JOIN part ON p_partkey = campaign_id) st JOIN tg ON t <> campaign_id GROUP BY 1, 2),
    dv AS (SELECT t, l_suppkey AS i, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN tg ON t <> l_partkey GROUP BY 1, 2),
    pf AS (SELECT t, l_suppkey AS i, count(*) AS n, median(l_quantity * 100) AS vm FROM lineitem JOIN tg ON t <> l_partkey GROUP BY 1, 2),
    au AS (SELECT t, l_suppkey AS i, count(*) FILTER (WHERE l_linestatus = 'F') AS young, count(*) AS n, count(*) FILTER (WHERE l_returnflag IN ('R', 'A')) AS g FROM lineitem JOIN tg ON t <> l_partkey GROUP BY 1, 2),
    j AS (SELECT tg.t, s_suppkey AS i, lower(s_name) AS h, CASE WHEN s_suppkey % 5 = 0 THEN 8 ELSE 10 END AS ic, tg.p_name, tg.p_type, cc, bc, sel, selk, warn, fees, fee, themes, types, k, p, pf.n AS pn, vm, au.n AS an, g FROM supplier CROSS JOIN tg LEFT JOIN ex ON ex.t = tg.t AND ex.i = s_suppkey
      LEFT JOIN dv ON dv.t = tg.t AND dv.i = s_suppkey LEFT JOIN pf ON pf.t = tg.t AND pf.i = s_suppkey LEFT JOIN au ON au.t = tg.t AND au.i = s_suppkey),
    v AS (SELECT *, rank() OVER (PARTITION BY t, vm IS NULL ORDER BY vm) AS r, count(*) OVER (PARTITION BY t, vm) AS c, count(vm) OVER (PARTITION BY t) AS n FROM j),
    sc AS (SELECT t, i, h, fee, CASE WHEN g > 0 THEN 100 ELSE 50 END AS gf, CASE WHEN an > 0 THEN 100 ELSE 50 END AS af,
      CASE WHEN themes IS NULL THEN 0 ELSE len(list_intersect(list_distinct(string_split(p_name, ' ')), themes)) * 100 / len(list_distinct(string_split(p_name, ' '))) END AS tf, CASE WHEN types IS NOT NULL AND list_contains(types, p_type) THEN 100 ELSE 0 END AS pe,
      least(100, coalesce(cc, 0) * 100 / 600) AS he, least(100, coalesce(bc, 0) * 100 / 25) AS cb, CASE WHEN selk > 0 THEN sel * 100 / selk ELSE 50 END AS sh, CASE WHEN vm IS NULL THEN 50 WHEN n = 1 THEN 100 ELSE (r + (c - 1) / 2 - 1) * 100 / (n - 1) END AS vp,
      CASE WHEN fee IS NULL THEN 50 ELSE greatest(0, least(100, (1 - fee / 45000) * 100)) END AS bh, CASE WHEN k > 0 THEN p * 100 / k ELSE 50 END AS oc,
      ic + CASE WHEN selk > 0 THEN 15 ELSE 0 END + CASE WHEN fees > 0 THEN 10 ELSE 0 END + CASE WHEN pn > 0 THEN 20 ELSE 0 END + CASE WHEN k > 0 THEN 15 ELSE 0 END + CASE WHEN g > 0 THEN 10 ELSE 0 END + CASE WHEN an > 0 THEN 10 ELSE 0 END + CASE WHEN themes IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN coalesce(warn, 0) = 0 THEN 5 ELSE 0 END AS dc FROM v),
    tt AS (SELECT *, CASE WHEN fee IS NULL OR fee <= 45000 THEN (gf * 0.1 + af * 0.08 + tf * 0.12 + pe * 0.08 + he * 0.1 + cb * 0.07 + sh * 0.1 + vp * 0.1 + bh * 0.05 + oc * 0.05 + dc * 0.1) / 0.95 END AS total FROM sc)
    SELECT t AS target_campaign_id, i AS influencer_id, round(total, 3) AS total_score, CASE WHEN total IS NULL THEN 'ineligible' ELSE 'eligible' END AS eligibility_status, 0.95 :: DOUBLE AS active_weight_sum FROM tt""",
)
def v2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_of(replay(spark, sf_dir))


def scores_of(scored: DataFrame) -> DataFrame:
    return scored.select("target_campaign_id", "influencer_id", F.round("total_score", 3).alias("total_score"), "eligibility_status", F.round("active_weight_sum", 6).alias("active_weight_sum"))


@query(
    "match_v2_rank",
    ORACLES["match_v2_replay"].rpartition("SELECT t AS target_campaign_id")[0]
    + "SELECT t AS target_campaign_id, i AS influencer_id, CASE WHEN total IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY t, total IS NULL ORDER BY total DESC, h, i) AS INTEGER) END AS rank, 'replay_' || t || '_matching_v2' AS scenario_id FROM tt",
)
def v2_rank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(spark, sf_dir).select("target_campaign_id", "influencer_id", "rank", "scenario_id")


@query(
    "leakage_audit",
    """SELECT p_partkey AS target_campaign_id, CAST(count(l_suppkey) AS BIGINT) AS excluded_observations, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS excluded_facts, 'PASS' AS leakage_guard_status
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_size = 7 GROUP BY 1""",
)
def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return leakage_audit(replay_targets(spark, sf_dir), observations=obs, facts=campaign_facts(obs))
