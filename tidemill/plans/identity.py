"""Identity: clusters of equal handles, a review queue, corroboration, decisions, and the golden master with its aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import query, read_table
from tidemill.functions.identity import DECISIONS, decision_errors, extract_handle, review_evidence, review_key, short_id, stable_id, strong_identity_cell
from tidemill.functions.text import normalized, split_list, stripped
from tidemill.operators.dedupe import first_of_each, ordered_list, sorted_distinct_text


def clusters(accepted: DataFrame) -> DataFrame:
    """One row a handle, ignoring case; a blank handle is an error."""
    handle = F.lower(stripped(F.col("canonical_handle_candidate")))
    checked = F.when(F.coalesce(handle, F.lit("")) != "", handle).otherwise(F.raise_error(F.lit("an accepted row has no handle")).cast("string"))
    rows = accepted.withColumn("canonical_handle", checked)
    return rows.groupBy("canonical_handle").agg(
        F.count("*").alias("observation_count"),
        F.count_distinct("source_filename").alias("workbook_count"),
        F.count_distinct("source_filename", "source_sheet_name").alias("sheet_count"),
        sorted_distinct_text(F.col("source_filename"), " | ").alias("workbooks"),
        sorted_distinct_text(F.col("identity_primary_raw"), " | ").alias("raw_names"),
    ).withColumn("cluster_id", stable_id("icl", F.col("canonical_handle")))


def cluster_counters(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("clusters"), F.sum("observation_count").alias("observations"), F.count_if(F.col("workbook_count") > 1).alias("multi_workbook_clusters"))


def review_queue(quarantine: DataFrame, order: Column) -> DataFrame:
    """One review a key: the first row's values, occurrences in input order with repeats, and the evidence that the row itself gives."""
    kind = F.when(F.contains("dq_codes", F.lit("DQ_IDENTITY_CONFLICT")), "identity_conflict").otherwise("identity_unparsable")
    q = quarantine.withColumns({"review_type": kind, "ord": order})
    q = q.withColumn("review_key", review_key(F.col("review_type"), F.col("normalized_handle_candidates"), F.col("identity_primary_raw")))
    where = F.concat_ws(" | ", "source_filename", "source_sheet_name", F.concat(F.lit("row "), F.col("source_row_number").cast("string")))
    first = lambda c: F.min_by(c, "ord").alias(c)
    out = q.groupBy("review_key").agg(
        first("review_type"), first("identity_primary_raw"), first("identity_secondary_raw"), first("normalized_handle_candidates"),
        F.count("*").alias("occurrence_count"), F.array_join(ordered_list(where, F.col("ord")), " || ").alias("source_occurrences"),
    )
    evidence = review_evidence(F.col("review_type"), F.col("identity_primary_raw"), F.col("identity_secondary_raw"))
    return out.withColumns({"review_id": short_id("review", F.col("review_key")), "e": evidence}).select("*", "e.*").drop("e")


def corroborate(reviews: DataFrame, accepted: DataFrame) -> DataFrame:
    """reviews with corroboration_status, corroborated_handle, evidence_consistency, recommendation: which candidates accepted rows have."""
    hits = accepted.groupBy(F.lower("canonical_handle_candidate").alias("candidate")).agg(F.count("*").alias("hits"), F.count_distinct("source_filename").alias("workbooks"))
    exploded = reviews.select("review_id", F.posexplode(F.transform(split_list(F.col("normalized_handle_candidates")), F.lower)).alias("pos", "candidate"))
    counted = exploded.join(hits, "candidate", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "workbooks": F.coalesce("workbooks", F.lit(0))})
    told = F.concat(F.col("candidate"), F.lit(":accepted_hits="), F.col("hits").cast("string"), F.lit(",workbooks="), F.col("workbooks").cast("string"))
    grouped = counted.groupBy("review_id").agg(
        F.count_if(F.col("hits") > 0).alias("n_supported"),
        F.min_by("candidate", F.when(F.col("hits") > 0, F.col("pos"))).alias("supported"),
        F.array_join(ordered_list(told, F.col("pos")), " ; ").alias("corroboration_summary"),
    )
    out = reviews.join(grouped, "review_id", "left")
    one = F.col("n_supported") == 1
    primary, secondary = extract_handle(F.col("identity_primary_raw")), extract_handle(F.col("identity_secondary_raw"))
    handle = F.when(one, F.col("supported")).otherwise("")
    status = (
        F.when(F.col("n_supported").isNull(), "no_candidate_handle").when(F.col("n_supported") == 0, "no_independent_exact_corroboration").when(one, "single_candidate_corroborated").otherwise("multiple_candidates_corroborated")
    )
    consistency = (
        F.when(F.col("n_supported").isNull(), "not_applicable")
        .when(F.col("n_supported") == 0, "no_independent_support")
        .when(~one, "conflicting_independent_support")
        .when(F.col("supported") == secondary, "supports_secondary_profile_handle")
        .when((F.col("supported") == primary) & secondary.isNotNull() & (primary != secondary), "supports_primary_but_conflicts_with_secondary_profile_handle")
        .when(F.col("supported") == primary, "supports_primary_handle")
        .otherwise("supports_observed_candidate")
    )
    confirm = F.when(one & (consistency != "supports_primary_but_conflicts_with_secondary_profile_handle"), "human_can_confirm_supported_handle").otherwise("manual_review_required")
    return out.withColumns({"corroboration_status": status, "corroborated_handle": handle, "evidence_consistency": consistency, "machine_recommendation": confirm, "auto_resolution_allowed": F.lit("no")}).drop("n_supported", "supported")


def workbook_evidence(handles: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells(file, sheet, row, column, text) that strongly show one of handles(handle)."""
    strong = cells.withColumns({"evidence": strong_identity_cell(F.col("text")), "handle": extract_handle(F.col("text"))}).where("evidence is not null")
    return strong.join(handles.select("handle").distinct(), "handle", "left_semi")


def validated_decisions(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(review_id, error_code) of wrong decisions, and counts by decision."""
    errors = decision_errors(*[F.col(c) for c in ("decision", "resolved_handle", "decision_evidence", "normalized_handle_candidates", "reviewer", "reviewed_at")])
    wrong = reviews.select("review_id", F.explode(errors).alias("error_code"))
    return wrong, reviews.groupBy(F.coalesce("decision", F.lit("")).alias("decision")).agg(F.count("*").alias("n"))


def split_quarantine(quarantine: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that a decision resolves, rows that stay). A missing decision, or one to keep identities apart, fails the run."""
    d = decisions.select("review_id", "decision", "resolved_handle")
    joined = quarantine.join(d, "review_id", "left")
    fail = lambda text: F.raise_error(F.lit(text)).cast("string")
    decision = F.when(F.col("decision").isNull(), fail("a quarantined row has no decision")).when(F.col("decision") == DECISIONS[2], fail("identities that are kept apart can't be promoted")).otherwise(F.col("decision"))
    checked = joined.withColumn("decision", decision)
    resolved = checked.where(F.col("decision").isin(*DECISIONS[:2])).withColumn("canonical_handle_candidate", F.lower(stripped(F.col("resolved_handle"))))
    return resolved, checked.where(F.col("decision") == DECISIONS[3]).select(*quarantine.columns)


def golden_master(accepted: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row a handle of accepted and resolved rows; its id comes from the cluster, else from the smallest review."""
    a = accepted.select(F.lower("canonical_handle_candidate").alias("canonical_handle"), "source_filename", F.lit(None).cast("string").alias("review_id"))
    r = resolved.select(F.lower("canonical_handle_candidate").alias("canonical_handle"), "source_filename", "review_id")
    grouped = a.unionByName(r).groupBy("canonical_handle").agg(
        F.count("*").alias("observation_count"), F.count("review_id").alias("reviewed_count"), F.min("review_id").alias("first_review"), F.count_distinct("source_filename").alias("workbook_count")
    )
    exact = F.col("observation_count") > F.col("reviewed_count")
    seed = F.when(exact, stable_id("icl", F.col("canonical_handle"))).otherwise(F.col("first_review"))
    return grouped.select(
        stable_id("inf", F.lit("golden-master-v1"), seed).alias("influencer_id"), "canonical_handle", F.lit("tiktok").alias("platform"), "observation_count", "reviewed_count", "workbook_count",
        F.when(F.col("reviewed_count") == 0, "deterministic_exact").otherwise("reviewed_evidence").alias("identity_confidence"),
        F.when(exact, "deterministic_exact_handle_cluster").otherwise("reviewed_direct_identity_evidence").alias("resolution_method"),
    )


def aliases(rows: DataFrame, master: DataFrame, order: Column) -> DataFrame:
    """Every raw name and handle of rows with its influencer; of equal ones at a place the first stays."""
    owned = rows.withColumns({"canonical_handle": F.lower("canonical_handle_candidate"), "ord": order}).join(master.select("canonical_handle", "influencer_id"), "canonical_handle")
    of = lambda kind, c: F.struct(F.lit(kind).alias("alias_type"), F.col(c).alias("alias_value"))
    each = owned.select("influencer_id", "source_row_hash", "source_filename", "ord", F.explode(F.array(of("raw_primary", "identity_primary_raw"), of("raw_secondary", "identity_secondary_raw"), of("normalized_handle", "canonical_handle"))).alias("a"))
    flat = each.select("influencer_id", "source_row_hash", "source_filename", "ord", "a.*").where(F.coalesce(stripped(F.col("alias_value")), F.lit("")) != "")
    return first_of_each(flat.withColumn("k", F.lower("alias_value")), ["influencer_id", "alias_type", "k", "source_filename"], [F.col("ord")]).drop("k", "ord")


def master_violations(master: DataFrame, expected_rows: int) -> list[str]:
    """What is wrong with a master: repeated handles or ids, or observations that got lost."""
    row = master.agg(F.count("*").alias("n"), F.count_distinct("canonical_handle").alias("h"), F.count_distinct("influencer_id").alias("i"), F.coalesce(F.sum("observation_count"), F.lit(0)).alias("o")).first()
    return [m for bad, m in ((row["h"] < row["n"], "handles repeat"), (row["i"] < row["n"], "ids repeat"), (row["o"] != expected_rows, "observations don't add up")) if bad]


def resolver(master: DataFrame, alias_rows: DataFrame) -> DataFrame:
    """(key, influencer_id, tier) of what names exactly one influencer; tier 1 handles, 2 alias texts and their handles."""
    handles = master.select(normalized(F.col("canonical_handle")).alias("key"), "influencer_id", F.lit(1).alias("tier"))
    text = alias_rows.select(normalized(F.col("alias_value")).alias("key"), "influencer_id")
    inside = alias_rows.select(normalized(extract_handle(F.col("alias_value"))).alias("key"), "influencer_id")
    named = text.unionByName(inside).where("key <> ''").groupBy("key").agg(F.collect_set("influencer_id").alias("ids")).where("size(ids) = 1")
    return handles.unionByName(named.select("key", F.col("ids")[0].alias("influencer_id"), F.lit(2).alias("tier")))


def resolve(rows: DataFrame, raw: str, lookup: DataFrame) -> DataFrame:
    """rows with influencer_id and method: exact handle, then exact known alias, then an alias's handle; never fuzzy."""
    text, handle = normalized(F.col(raw)), normalized(extract_handle(F.col(raw)))
    r = rows.withColumns({"__text": text, "__handle": handle})
    tier = lambda n, key, name: lookup.where(f"tier = {n}").select(F.col("key").alias(key), F.col("influencer_id").alias(name))
    r = r.join(tier(1, "__handle", "__a"), "__handle", "left").join(tier(2, "__text", "__b"), "__text", "left").join(tier(2, "__handle", "__c"), "__handle", "left")
    method = (
        F.when(F.col("__text") == "", "missing_identity").when(F.col("__a").isNotNull() & (F.col("__handle") != ""), "exact_canonical_handle").when(F.col("__b").isNotNull(), "exact_known_alias")
        .when(F.col("__c").isNotNull() & (F.col("__handle") != ""), "exact_alias_handle").otherwise("unresolved_exact_only")
    )
    chosen = F.when(method == "exact_canonical_handle", F.col("__a")).when(method == "exact_known_alias", F.col("__b")).when(method == "exact_alias_handle", F.col("__c"))
    return r.withColumns({"method": method, "influencer_id": chosen}).drop("__text", "__handle", "__a", "__b", "__c")


def resolved_observations(rows: DataFrame, alias_rows: DataFrame) -> DataFrame:
    """rows with the influencer of their hash. A hash of two influencers, a repeated row, or a hash without one fails the run."""
    owners = alias_rows.groupBy("source_row_hash").agg(F.count_distinct("influencer_id").alias("n"), F.min("influencer_id").alias("influencer_id"))
    repeated = rows.groupBy("source_row_hash").agg(F.count("*").alias("times"))
    fail = lambda text: F.raise_error(F.lit(text)).cast("string")
    joined = rows.join(repeated, "source_row_hash").join(owners, "source_row_hash", "left")
    owner = F.when(F.col("times") > 1, fail("a source row is there twice")).when(F.col("n").isNull(), fail("a source row has no influencer")).when(F.col("n") > 1, fail("a source row has two influencers")).otherwise(F.col("influencer_id"))
    return joined.withColumn("influencer_id", owner).drop("times", "n")


# --- queries ----------------------------------------------------------------------------------------------------


def example_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidate rows: their handle is a group of names, their nation a workbook."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("ord"), F.concat(F.lit("book_"), F.col("c_nationkey").cast("string")).alias("source_filename"), F.lower("c_mktsegment").alias("source_sheet_name"), k.alias("source_row_number"),
        F.concat(F.lit("Name "), (k % 300).cast("string"), F.lit(" (@user."), (k % 300).cast("string"), F.lit(")")).alias("identity_primary_raw"), F.concat(F.lit("@Alt_"), (k % 40).cast("string")).alias("identity_secondary_raw"),
        F.concat(F.lit("user."), (k % 300).cast("string"), F.lit(";alt_"), (k % 40).cast("string")).alias("normalized_handle_candidates"), F.concat(F.lit("User."), (k % 250).cast("string")).alias("canonical_handle_candidate"),
        F.when(k % 2 == 0, "DQ_IDENTITY_CONFLICT").otherwise("DQ_IDENTITY_UNPARSABLE").alias("dq_codes"), F.sha2(k.cast("string"), 256).alias("source_row_hash"),
    )


@query(
    "identity_cluster",
    """SELECT 'user.' || (c_custkey % 250) AS canonical_handle, CAST(count(*) AS BIGINT) AS observation_count, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS workbook_count, CAST(count(DISTINCT c_nationkey || '|' || c_mktsegment) AS BIGINT) AS sheet_count,
    string_agg(DISTINCT 'book_' || c_nationkey, ' | ' ORDER BY 'book_' || c_nationkey) AS workbooks, 'icl_' || substr(sha256('user.' || (c_custkey % 250)), 1, 16) AS cluster_id FROM customer WHERE c_custkey % 3 > 0 GROUP BY c_custkey % 250""",
)
def cluster_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(example_rows(spark, sf_dir).where("ord % 3 > 0")).drop("raw_names")


@query(
    "review_queue",
    """WITH q AS (SELECT c_custkey AS o, CASE WHEN c_custkey % 2 = 0 THEN 'conflict|alt_' || (c_custkey % 40) || ';user.' || (c_custkey % 300) ELSE 'unparsable|name ' || (c_custkey % 300) || ' (@user.' || (c_custkey % 300) || ')' END AS k,
      'book_' || c_nationkey || ' | ' || lower(c_mktsegment) || ' | row ' || c_custkey AS w FROM customer WHERE c_custkey % 3 = 0)
    SELECT 'review_' || substr(sha256(k), 1, 12) AS review_id, CASE WHEN k LIKE 'conflict%' THEN 'identity_conflict' ELSE 'identity_unparsable' END AS review_type, CAST(count(*) AS BIGINT) AS occurrence_count, string_agg(w, ' || ' ORDER BY o) AS source_occurrences,
      CASE WHEN k LIKE 'conflict%' THEN 'conflicting_handles' ELSE 'embedded_handle' END AS evidence_type FROM q GROUP BY k""",
)
def queue_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_queue(example_rows(spark, sf_dir).where("ord % 3 = 0"), F.col("ord")).select("review_id", "review_type", "occurrence_count", "source_occurrences", "evidence_type")


@query(
    "corroborate",
    """WITH q AS (SELECT DISTINCT c_custkey % 300 AS u, c_custkey % 40 AS a FROM customer WHERE c_custkey % 6 = 0), h AS (SELECT c_custkey % 250 AS u, count(*) AS n FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1)
    SELECT 'review_' || substr(sha256('conflict|alt_' || a || ';user.' || q.u), 1, 12) AS review_id, CASE WHEN n > 0 THEN 'single_candidate_corroborated' ELSE 'no_independent_exact_corroboration' END AS corroboration_status, CASE WHEN n > 0 THEN 'user.' || q.u ELSE '' END AS corroborated_handle,
      CASE WHEN n > 0 THEN 'supports_primary_but_conflicts_with_secondary_profile_handle' ELSE 'no_independent_support' END AS evidence_consistency, 'manual_review_required' AS machine_recommendation FROM q LEFT JOIN h ON h.u = q.u""",
)
def corroborate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = example_rows(spark, sf_dir)
    found = corroborate(review_queue(rows.where("ord % 6 = 0"), F.col("ord")), rows.where("ord % 3 > 0"))
    return found.select("review_id", "corroboration_status", "corroborated_handle", "evidence_consistency", "machine_recommendation")


@query(
    "golden_master",
    """WITH r AS (SELECT 'user.' || (c_custkey % 250) AS h, NULL AS rid, c_nationkey AS b FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 250 < 200
      UNION ALL SELECT 'user.' || (c_custkey % 250), 'review_' || substr(sha256(CASE WHEN c_custkey % 2 = 0 THEN 'conflict|alt_' || (c_custkey % 40) || ';user.' || (c_custkey % 300) ELSE 'unparsable|name ' || (c_custkey % 300) || ' (@user.' || (c_custkey % 300) || ')' END), 1, 12), c_nationkey FROM customer WHERE c_custkey % 3 = 0),
    g AS (SELECT h, count(*) AS n, count(rid) AS k, min(rid) AS f, count(DISTINCT b) AS w FROM r GROUP BY h)
    SELECT 'inf_' || substr(sha256('golden-master-v1|' || CASE WHEN n > k THEN 'icl_' || substr(sha256(h), 1, 16) ELSE f END), 1, 16) AS influencer_id, h AS canonical_handle, CAST(n AS BIGINT) AS observation_count, CAST(k AS BIGINT) AS reviewed_count, CAST(w AS BIGINT) AS workbook_count,
      CASE WHEN k = 0 THEN 'deterministic_exact' ELSE 'reviewed_evidence' END AS identity_confidence, CASE WHEN n > k THEN 'deterministic_exact_handle_cluster' ELSE 'reviewed_direct_identity_evidence' END AS resolution_method FROM g""",
)
def master_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, resolved = example_promotion(spark, sf_dir)
    return golden_master(accepted, resolved).drop("platform")


def example_promotion(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = example_rows(spark, sf_dir)
    kind = F.when(F.col("ord") % 2 == 0, "identity_conflict").otherwise("identity_unparsable")
    quarantine = rows.where("ord % 3 = 0").withColumn("review_id", short_id("review", review_key(kind, F.col("normalized_handle_candidates"), F.col("identity_primary_raw"))))
    decisions = quarantine.groupBy("review_id").agg(F.min(F.lower("canonical_handle_candidate")).alias("resolved_handle")).withColumn("decision", F.lit(DECISIONS[0]))
    resolved, _ = split_quarantine(quarantine, decisions)
    own = quarantine.select("source_row_hash", F.lower("canonical_handle_candidate").alias("own"))
    return rows.where("ord % 3 > 0 and ord % 250 < 200"), resolved.join(own, "source_row_hash").withColumn("canonical_handle_candidate", F.col("own")).drop("own")


@query(
    "alias_dedupe",
    """SELECT alias_type, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT DISTINCT 'raw_primary' AS alias_type, c_custkey % 250 AS h, 'name ' || (c_custkey % 300) AS v, c_nationkey AS b FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT DISTINCT 'raw_secondary', c_custkey % 250, 'alt_' || (c_custkey % 40), c_nationkey FROM customer WHERE c_custkey % 3 > 0
      UNION ALL SELECT DISTINCT 'normalized_handle', c_custkey % 250, '', c_nationkey FROM customer WHERE c_custkey % 3 > 0) GROUP BY 1""",
)
def alias_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = example_rows(spark, sf_dir).where("ord % 3 > 0")
    return aliases(rows, golden_master(rows, rows.limit(0).withColumn("review_id", F.lit(""))), F.col("ord")).groupBy("alias_type").agg(F.count("*").alias("n"))


@query(
    "identity_resolve",
    """SELECT CASE WHEN c_custkey % 300 < 250 THEN 'exact_canonical_handle' ELSE 'unresolved_exact_only' END AS method, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1""",
)
def resolve_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = example_rows(spark, sf_dir)
    master = golden_master(rows, rows.limit(0).withColumn("review_id", F.lit("")))
    lookup = resolver(master, master.select(F.lit("nobody else").alias("alias_value"), "influencer_id"))
    return resolve(rows, "identity_primary_raw", lookup).groupBy("method").agg(F.count("*").alias("n"))


@query("stable_id", "SELECT p_brand, p_type, 'cmp_' || substr(sha256(lower(p_brand) || '|' || coalesce(p_type, '')), 1, 16) AS campaign_id, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1, 2, 3")
def stable_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.groupBy("p_brand", "p_type", stable_id("cmp", F.lower("p_brand"), F.col("p_type")).alias("campaign_id")).agg(F.count("*").alias("n"))


@query(
    "handle_extract",
    r"""SELECT page_id, lower(coalesce(nullif(regexp_extract(url, '(?i)tiktok\.com/@([A-Za-z0-9._]+)', 1), ''), nullif(regexp_extract(url, '\(@([A-Za-z0-9._]+)\)', 1), ''), nullif(regexp_extract(url, '@([A-Za-z0-9._]+)', 1), ''), nullif(regexp_extract(url, '^([A-Za-z0-9._]+)\s*\(', 1), ''),
      CASE WHEN regexp_full_match(url, '[A-Za-z0-9._]+') THEN url END)) AS handle FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.tiktok.com/@' || replace(replace(url, '/', '.'), ':', '_') WHEN 1 THEN 'Name (@p.' || page_id || ') | x' WHEN 2 THEN 'see @P_' || page_id WHEN 3 THEN 'page' || page_id || ' (old)' ELSE url END AS url FROM pages)""",
)
def handle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    text = lambda a, b: F.concat(F.lit(a), k.cast("string"), F.lit(b))
    url = (
        F.when(k % 5 == 0, F.concat(F.lit("https://www.tiktok.com/@"), F.replace(F.replace("url", F.lit("/"), F.lit(".")), F.lit(":"), F.lit("_")))).when(k % 5 == 1, text("Name (@p.", ") | x")).when(k % 5 == 2, text("see @P_", ""))
        .when(k % 5 == 3, text("page", " (old)")).otherwise(F.col("url"))
    )
    return read_table(spark, sf_dir, "pages").select("page_id", extract_handle(url).alias("handle"))
