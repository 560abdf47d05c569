"""Time: incremental selection, late arrivals, watermarks, backfill, service levels, monitoring, alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.catalog import query, read_table
from tidemill.functions.parse import lenient_date
from tidemill.operators.dedupe import last_of_each
from tidemill.operators.fingerprint import bucketed_fingerprint


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def dated(rows: DataFrame, field: str) -> DataFrame:
    """Rows with a valid date in a text field, as `event_date`."""
    return rows.withColumn("event_date", lenient_date(F.col(field))).where("event_date is not null")


def with_arrival(rows: DataFrame, id_col: str, default_delay: int = 1, overrides: dict[object, int] | None = None) -> DataFrame:
    """rows with arrival_date: the event date and a delay in days, by id where there is an override."""
    if any(v < 0 for v in (overrides or {}).values()):
        raise ValueError("an arrival can't be before its event")
    delay = F.lit(default_delay)
    if overrides:
        table = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
        delay = F.coalesce(F.try_element_at(table, F.col(id_col)), delay)
    return rows.withColumn("arrival_date", F.date_add("event_date", delay.cast("int")))


def incremental(rows: DataFrame, watermark: str) -> DataFrame:
    """Rows with an event after the watermark."""
    return rows.where(F.col("event_date") > day(watermark))


def late_arrivals(rows: DataFrame, watermark: str, previous: str, current: str) -> DataFrame:
    """Rows with an event up to the watermark that arrived after the previous run and up to the current one."""
    if current < previous:
        raise ValueError("the current run is before the previous one")
    return rows.where((F.col("event_date") <= day(watermark)) & (F.col("arrival_date") > day(previous)) & (F.col("arrival_date") <= day(current)))


def watermark_state(watermark: Column, newest: Column, most_stale: int) -> Column:
    """struct(code, lag_days) of a watermark's text against the newest event."""
    mark = lenient_date(watermark)
    lag = F.datediff(newest, mark)
    code = F.when(lag.isNull(), "WATERMARK_INVALID_FORMAT").when(lag < 0, "WATERMARK_AHEAD_OF_SOURCE").when(lag > most_stale, "WATERMARK_STALE").otherwise("WATERMARK_VALID")
    return F.struct(code.alias("code"), F.coalesce(lag, F.lit(0)).alias("lag_days"))


def safe_backfill(source: DataFrame, start: str, end: str, existing: DataFrame, key: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows to add, counters): the window's last row of each key that isn't there yet; a rerun adds nothing."""
    window = source.where(F.col("event_date").between(day(start), day(end)))
    survivors = last_of_each(window, [key], order)
    new = survivors.join(existing.select(key).distinct(), key, "left_anti")
    counters = (
        window.agg(F.count("*").alias("window_rows"))
        .crossJoin(survivors.agg(F.count("*").alias("distinct_keys")))
        .crossJoin(new.agg(F.count("*").alias("new_rows")))
        .crossJoin(bucketed_fingerprint(new, [key]).select("fingerprint"))
    )
    return new, counters.withColumn("already_present", F.col("distinct_keys") - F.col("new_rows"))


@dataclass(frozen=True)
class TemporalLimits:
    """A falsy critical limit means its default."""

    max_freshness_lag_days: int = 2
    critical_freshness_lag_days: int = 4
    min_completeness: float = 0.99
    critical_completeness: float = 0.98
    max_watermark_lag_days: int = 2


def events_of(*checks: tuple[Column, Column | str, str, Column, Column]) -> Column:
    """Array of struct(event_code, severity, observed, threshold) of the checks that hold, in order."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    test,
                    F.struct(
                        F.lit(code).alias("event_code"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
                        observed.cast("double").alias("observed"), threshold.cast("double").alias("threshold"),
                    ),
                )
                for test, severity, code, observed, threshold in checks
            ]
        )
    )


def temporal_events(runs: DataFrame, limits: TemporalLimits = TemporalLimits()) -> DataFrame:
    """(run_id, event_code, severity, observed, threshold) of runs(run_id, as_of_date, latest_event_date, watermark_date, expected_rows, loaded_rows)."""
    fresh = F.greatest(F.lit(0), F.datediff("as_of_date", "latest_event_date"))
    lag = F.greatest(F.lit(0), F.datediff("latest_event_date", "watermark_date"))
    expected = F.when(F.col("expected_rows") > 0, F.col("expected_rows")).otherwise(F.raise_error(F.lit("expected_rows must be positive")).cast("long"))
    complete = F.col("loaded_rows") / expected
    critical = limits.critical_freshness_lag_days or 4
    found = events_of(
        (fresh > limits.max_freshness_lag_days, F.when(fresh > critical, "CRITICAL").otherwise("WARN"), "FRESHNESS_SLO_BREACH", fresh, F.lit(limits.max_freshness_lag_days)),
        (complete < limits.min_completeness, F.when(complete < limits.critical_completeness, "CRITICAL").otherwise("WARN"), "COMPLETENESS_SLO_BREACH", complete, F.lit(limits.min_completeness)),
        (lag > limits.max_watermark_lag_days, "WARN", "WATERMARK_LAG_HIGH", lag, F.lit(limits.max_watermark_lag_days)),
    )
    return runs.select("run_id", F.inline(found))


def slo_dashboard(runs: DataFrame) -> DataFrame:
    return runs.select(
        "run_id", F.greatest(F.lit(0), F.datediff("as_of_date", "latest_event_date")).alias("freshness_lag_days"), F.round(F.col("loaded_rows") / F.col("expected_rows"), 6).alias("completeness"),
        F.greatest(F.lit(0), F.datediff("latest_event_date", "watermark_date")).alias("watermark_lag_days"),
    )


@dataclass(frozen=True)
class RunLimits:
    """A duration limit of 0 switches that check off."""

    max_duration_seconds: float = 300
    max_retries: int = 2
    max_rejected_rows: int = 0
    min_completeness: float = 1.0


def monitoring_events(runs: DataFrame, limits: RunLimits = RunLimits()) -> DataFrame:
    """(run_id, event_code, severity, observed, threshold) of runs(run_id, status, duration_seconds, retry_count, rows_attempted, rows_loaded, rows_rejected)."""
    complete = F.when(F.col("rows_attempted") > 0, F.col("rows_loaded") / F.col("rows_attempted"))
    found = events_of(
        (F.col("status") == "FAILED", "CRITICAL", "RUN_FAILED", F.lit(1), F.lit(0)),
        (F.lit(limits.max_duration_seconds > 0) & (F.col("duration_seconds") > limits.max_duration_seconds), "WARN", "RUN_DURATION_HIGH", F.col("duration_seconds"), F.lit(limits.max_duration_seconds)),
        (F.col("retry_count") > limits.max_retries, "WARN", "RETRY_COUNT_HIGH", F.col("retry_count"), F.lit(limits.max_retries)),
        (F.col("rows_rejected") > limits.max_rejected_rows, "WARN", "REJECTED_ROWS_HIGH", F.col("rows_rejected"), F.lit(limits.max_rejected_rows)),
        (complete < limits.min_completeness, "CRITICAL", "ROW_COMPLETENESS_LOW", complete, F.lit(limits.min_completeness)),
    )
    return runs.select("run_id", F.posexplode(found).alias("position", "e")).select("run_id", "position", "e.*")


def simple_alerts(events: DataFrame) -> DataFrame:
    """One alert an event, numbered from 1 in its run."""
    number = F.lpad((F.col("position") + 1).cast("string"), 3, "0")
    return events.select("run_id", F.concat(F.lit("alert_"), number, F.lit("_"), F.col("run_id").cast("string")).alias("alert_id"), "event_code", "severity", F.lit("portfolio_lab_sink").alias("channel"), F.lit("SIMULATED_DELIVERED").alias("delivery_status"))


def escalated_alerts(events: DataFrame, order: list[Column], severities: tuple[str, ...] = ("CRITICAL",), after_minutes: int = 30, channels: tuple[str, str] = ("portfolio_lab_primary", "portfolio_lab_secondary")) -> DataFrame:
    """A primary alert an event, and an escalated one on the second channel for the given severities; a falsy pause means its default."""
    n = F.format_string("%02d", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))

    def alert(letter: str, level: str, channel: str, minutes: int | None, status: str) -> Column:
        name = F.concat_ws("-", F.lit("ALT"), F.col("run_id").cast("string"), "n", F.lit(letter))
        return F.struct(name.alias("alert_id"), F.lit(level).alias("level"), F.lit(channel).alias("channel"), F.lit(minutes).cast("int").alias("after_minutes"), F.lit(status).alias("delivery_status"))

    primary = alert("P", "PRIMARY", channels[0], None, "SIMULATED_DELIVERED")
    second = alert("E", "ESCALATED", channels[1], after_minutes or 30, "SIMULATED_ESCALATED")
    both = F.when(F.upper("severity").isin(*[x.upper() for x in severities]), F.array(primary, second)).otherwise(F.array(primary))
    return events.withColumn("n", n).select("run_id", "event_code", "severity", F.explode(both).alias("a")).select("run_id", "event_code", "severity", "a.*")


# --- queries ----------------------------------------------------------------------------------------------------

EVENTS_SQL = "ev AS (SELECT event_id, CAST(ts AS DATE) AS event_date, event_type, user_id, value, CAST(ts AS DATE) + CAST(CASE WHEN event_id % 97 = 0 THEN 3 + event_id % 5 ELSE 1 END AS INTEGER) AS arrival_date FROM events)"
RUNS_SQL = """runs AS (SELECT o_custkey AS run_id, CAST(max(o_orderdate) AS DATE) AS latest_event_date, CAST(max(o_orderdate) AS DATE) + CAST(o_custkey % 7 AS INTEGER) AS as_of_date, CAST(max(o_orderdate) AS DATE) - CAST(o_custkey % 5 AS INTEGER) AS watermark_date,
  count(*) * 100 AS expected_rows, count(*) * 100 - o_custkey % 4 * count(*) AS loaded_rows FROM orders GROUP BY o_custkey)"""
OPS_SQL = """ops AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 50 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CAST(o_orderkey % 400 AS DOUBLE) AS d, o_orderkey % 4 AS r, 100 AS a, 100 - o_orderkey % 3 AS l, o_orderkey % 3 AS j FROM orders)"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").withColumn("event_date", F.col("ts").cast("date"))
    delay = F.when(F.col("event_id") % 97 == 0, 3 + F.col("event_id") % 5).otherwise(1).cast("int")
    return e.withColumn("arrival_date", F.date_add("event_date", delay))


@query("incremental_select", f"WITH {EVENTS_SQL} SELECT event_id, event_date FROM ev WHERE event_date > DATE '2024-01-20'")
def incremental_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental(arrivals(spark, sf_dir), "2024-01-20").select("event_id", "event_date")


@query("late_arrivals", f"WITH {EVENTS_SQL} SELECT event_id, event_date, arrival_date FROM ev WHERE event_date <= DATE '2024-01-20' AND arrival_date > DATE '2024-01-20' AND arrival_date <= DATE '2024-01-24'")
def late_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_arrivals(arrivals(spark, sf_dir), "2024-01-20", "2024-01-20", "2024-01-24").select("event_id", "event_date", "arrival_date")


@query(
    "watermark_validate",
    """WITH m AS (SELECT event_type, CAST(max(ts) AS DATE) AS newest FROM events GROUP BY 1), w AS (SELECT * FROM (VALUES ('2024-01-29'), ('2024-01-02'), ('2025-01-01'), ('soon')) AS t(mark)),
    x AS (SELECT event_type, mark, date_diff('day', CASE WHEN mark LIKE '____-__-__' THEN TRY_CAST(mark AS DATE) END, newest) AS lag FROM m CROSS JOIN w)
    SELECT event_type, mark, CASE WHEN lag IS NULL THEN 'WATERMARK_INVALID_FORMAT' WHEN lag < 0 THEN 'WATERMARK_AHEAD_OF_SOURCE' WHEN lag > 7 THEN 'WATERMARK_STALE' ELSE 'WATERMARK_VALID' END AS code, CAST(coalesce(lag, 0) AS INTEGER) AS lag_days FROM x""",
)
def watermark_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").cast("date").alias("newest"))
    marks = newest.select("event_type", "newest", F.explode(F.array(*[F.lit(m) for m in ("2024-01-29", "2024-01-02", "2025-01-01", "soon")])).alias("mark"))
    return marks.select("event_type", "mark", watermark_state(F.col("mark"), F.col("newest"), 7).alias("w")).select("event_type", "mark", "w.*")


@query(
    "safe_backfill",
    f"""WITH {EVENTS_SQL}, w AS (SELECT * FROM ev WHERE event_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-15'), s AS (SELECT user_id, max(event_id) AS event_id FROM w GROUP BY 1), x AS (SELECT DISTINCT user_id FROM ev WHERE event_date < DATE '2024-01-02')
    SELECT (SELECT count(*) FROM w) AS window_rows, (SELECT count(*) FROM s) AS distinct_keys, (SELECT count(*) FROM s WHERE user_id NOT IN (SELECT user_id FROM x)) AS new_rows, (SELECT count(*) FROM s WHERE user_id IN (SELECT user_id FROM x)) AS already_present""",
)
def backfill_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals(spark, sf_dir)
    _, counters = safe_backfill(rows, "2024-01-05", "2024-01-15", rows.where("event_date < date'2024-01-02'"), "user_id", [F.col("event_id")])
    return counters.drop("fingerprint")


def example_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").alias("latest_event_date"), F.count("*").alias("n"))
    k = F.col("o_custkey")
    return g.select(k.alias("run_id"), "latest_event_date", F.date_add("latest_event_date", (k % 7).cast("int")).alias("as_of_date"), F.date_sub("latest_event_date", (k % 5).cast("int")).alias("watermark_date"), (F.col("n") * 100).alias("expected_rows"), (F.col("n") * 100 - k % 4 * F.col("n")).alias("loaded_rows"))


@query(
    "temporal_slo",
    f"""WITH {RUNS_SQL}, x AS (SELECT run_id, date_diff('day', latest_event_date, as_of_date) AS f, loaded_rows / expected_rows AS c, date_diff('day', watermark_date, latest_event_date) AS w FROM runs)
    SELECT run_id, 'FRESHNESS_SLO_BREACH' AS event_code, CASE WHEN f > 4 THEN 'CRITICAL' ELSE 'WARN' END AS severity, CAST(f AS DOUBLE) AS observed, 2.0 :: DOUBLE AS threshold FROM x WHERE f > 2
    UNION ALL SELECT run_id, 'COMPLETENESS_SLO_BREACH', CASE WHEN c < 0.98 THEN 'CRITICAL' ELSE 'WARN' END, c, 0.99 :: DOUBLE FROM x WHERE c < 0.99
    UNION ALL SELECT run_id, 'WATERMARK_LAG_HIGH', 'WARN', CAST(w AS DOUBLE), 2.0 :: DOUBLE FROM x WHERE w > 2""",
)
def slo_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_events(example_runs(spark, sf_dir))


def example_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read_table(spark, sf_dir, "orders").select(
        k.alias("run_id"), F.when(k % 50 == 0, "FAILED").otherwise("SUCCESS").alias("status"), (k % 400).cast("double").alias("duration_seconds"), (k % 4).alias("retry_count"), F.lit(100).alias("rows_attempted"),
        (100 - k % 3).alias("rows_loaded"), (k % 3).alias("rows_rejected"),
    )


@query(
    "monitoring_events",
    f"""WITH {OPS_SQL} SELECT event_code, severity, CAST(count(*) AS BIGINT) AS n, round(sum(o), 4) AS observed_sum FROM (
      SELECT 'RUN_FAILED' AS event_code, 'CRITICAL' AS severity, 1.0 AS o FROM ops WHERE status = 'FAILED' UNION ALL SELECT 'RUN_DURATION_HIGH', 'WARN', d FROM ops WHERE d > 300 UNION ALL SELECT 'RETRY_COUNT_HIGH', 'WARN', r FROM ops WHERE r > 2
      UNION ALL SELECT 'REJECTED_ROWS_HIGH', 'WARN', j FROM ops WHERE j > 0 UNION ALL SELECT 'ROW_COMPLETENESS_LOW', 'CRITICAL', l / a FROM ops WHERE l < a) GROUP BY 1, 2""",
)
def monitoring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring_events(example_ops(spark, sf_dir)).groupBy("event_code", "severity").agg(F.count("*").alias("n"), F.round(F.sum("observed"), 4).alias("observed_sum"))


@query(
    "alert_escalation",
    f"""WITH {RUNS_SQL}, x AS (SELECT run_id, date_diff('day', latest_event_date, as_of_date) AS f FROM runs), e AS (SELECT run_id, CASE WHEN f > 4 THEN 'CRITICAL' ELSE 'WARN' END AS severity FROM x WHERE f > 2)
    SELECT 'ALT-' || run_id || '-01-P' AS alert_id, 'PRIMARY' AS level, 'SIMULATED_DELIVERED' AS delivery_status, severity FROM e UNION ALL SELECT 'ALT-' || run_id || '-01-E', 'ESCALATED', 'SIMULATED_ESCALATED', severity FROM e WHERE severity = 'CRITICAL'""",
)
def alert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = temporal_events(example_runs(spark, sf_dir)).where("event_code = 'FRESHNESS_SLO_BREACH'")
    return escalated_alerts(events, [F.col("event_code")]).select("alert_id", "level", "delivery_status", "severity")


@query("json_props", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).agg(F.count("*").alias("n"))
