"""Failure labs: faults are put into copies, guards must tell them, and a recovery must leave no trace.

Each lab gives frames of experiments, timeline, runs, controls and reconciliation. Rows stay in frames; only counts,
codes and one chosen row come to the driver. Alerts are simulated and pauses aren't slept.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import query, read_table
from tidemill.operators.fingerprint import bucketed_fingerprint
from tidemill.operators.upsert import upsert, upsert_counts
from tidemill.plans import reliability, temporal
from tidemill.plans.scans import example_workbooks
from tidemill.plans.sheets import classify, header_signature, is_nonempty, texts
from tidemill.functions.text import normalized
from tidemill.sources import faults, xlsx
from tidemill.sources.files import discover

#: Rows and columns of a sheet that a manifest looks at.
SCAN_ROWS, SCAN_COLS = 20, 25
#: (control, what it tells, stage) of each lab's guards.
CONTROLS = {
    "REL": [("Expected source manifest", "Missing or unexpected workbook", "source discovery"), ("Unique content hashes", "Duplicate workbook", "source discovery"), ("Candidate header baseline", "Schema drift", "pre-ingestion"),
            ("Expected sheet isn't empty", "Empty sheet", "pre-ingestion"), ("Batch fingerprint ledger", "Rerun of a batch", "batch admission")],
    "OPS": [("State points to a successful batch", "Unknown or corrupt checkpoint", "pre-run"), ("Staging and commit manifest", "Partial write taken for a whole one", "load"), ("Committed runs are skipped", "Second commit on a rerun", "commit"),
            ("Bounded retries", "Retry storm", "integration"), ("Limits and alerts", "Silently failed, slow or incomplete run", "monitor")],
    "TEMP": [("Arrival-aware late gate", "Event behind the watermark", "select"), ("Watermark validation", "Watermark ahead or stale", "pre-run"), ("Bounded backfill by business key", "Lost or doubled rows", "backfill"),
             ("Service levels and escalation", "Stale or incomplete data of a run that succeeded", "monitor")],
}


@dataclass
class Lab:
    """What was tried and seen; `observed` is the count that an experiment turns on."""

    spark: SparkSession
    prefix: str
    experiments: list[tuple] = field(default_factory=list)
    steps: list[tuple] = field(default_factory=list)
    runs: list[tuple] = field(default_factory=list)
    checks: list[tuple] = field(default_factory=list)

    def step(self, number: int, step: str, detail: object) -> None:
        name = f"{self.prefix}-{number:03d}"
        self.steps.append((name, 1 + sum(s[0] == name for s in self.steps), step, str(detail)))

    def conclude(self, number: int, failure: str, detected: list[str], recovered: str, observed: int, passed: bool) -> None:
        self.experiments.append((f"{self.prefix}-{number:03d}", failure, ";".join(detected), recovered, observed, "PASS" if passed else "FAIL"))

    def run(self, run_id: str, status: str, attempted: int, loaded: int, code: str = "") -> None:
        self.runs.append((run_id, status, attempted, loaded, code))

    def check(self, metric: str, value: int, passed: bool = True) -> None:
        self.checks.append((metric, value, "PASS" if passed else "FAIL"))

    def passed(self) -> bool:
        return all(e[-1] == "PASS" for e in self.experiments) and all(c[-1] == "PASS" for c in self.checks)

    def frames(self) -> dict[str, DataFrame]:
        frame = self.spark.createDataFrame
        controls = [(f"{self.prefix}-C{i:02d}", *c, "IMPLEMENTED") for i, c in enumerate(CONTROLS[self.prefix], start=1)]
        return {
            "experiments": frame(self.experiments, "experiment_id string, failure_type string, detection string, recovery string, observed long, pass_fail string"),
            "timeline": frame(self.steps, "experiment_id string, step_order int, step string, detail string"),
            "runs": frame(self.runs, "run_id string, status string, rows_attempted long, rows_loaded long, failure_code string"),
            "controls": frame(controls, "control_id string, control string, prevents_or_detects string, stage string, status string"),
            "reconciliation": frame(self.checks, "metric string, value long, status string"),
        }


# --- snapshots --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """workbooks(name, content_hash, size, error) and sheets(name, sheet, sheet_type, filled_rows, headers, signature, ..) of a folder."""

    workbooks: DataFrame
    sheets: DataFrame

    def save(self, folder: str) -> Manifest:
        """The same manifest, written and read back."""
        spark = self.workbooks.sparkSession
        for name, df in (("workbooks", self.workbooks), ("sheets", self.sheets)):
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return Manifest(spark.read.parquet(f"{folder}/workbooks"), spark.read.parquet(f"{folder}/sheets"))


def build_manifest(spark: SparkSession, folder: str, staged: str) -> Manifest:
    """The manifest of a folder's workbooks; a preview of each sheet's first rows is read once, and kept at `staged`."""
    xlsx.register(spark)
    options = {"path": folder, "maxRows": str(SCAN_ROWS), "maxCols": str(SCAN_COLS), "emptySheets": "true"}
    spark.read.format("xlsx").options(**options).load().write.mode("overwrite").parquet(staged)
    grid = spark.read.parquet(staged)
    errors = grid.where("error is not null").groupBy(F.col("file").alias("name")).agg(F.min("error").alias("error"))
    workbooks = discover(spark, folder).select("name", "content_hash", "size").join(errors, "name", "left")
    preview = grid.where("error is null")
    v = texts(F.col("cells"))
    kinds = classify(preview).select("file", "sheet", "sheet_type", "confidence", "primary_header_row")
    rows = preview.join(kinds, ["file", "sheet"])
    at_header = F.col("ord") == F.col("primary_header_row")
    headers = F.filter(F.transform(F.filter(v, lambda x: x.isNotNull()), normalized), lambda x: x != "")
    sheets = rows.groupBy(F.col("file").alias("name"), "sheet").agg(
        F.first("sheet_type").alias("sheet_type"), F.first("confidence").alias("confidence"), F.first("primary_header_row").alias("primary_header_row"), F.first("dimension").alias("dimension"),
        F.count_if(F.exists(v, is_nonempty)).cast("int").alias("filled_rows"),
        F.coalesce(F.max(F.when(at_header, headers)), F.array().cast("array<string>")).alias("headers"),
        F.coalesce(F.max(F.when(at_header, header_signature(v))), F.array().cast("array<string>")).alias("signature"),
    )
    return Manifest(workbooks, sheets)


def validate_snapshot(baseline: Manifest, current: Manifest) -> DataFrame:
    """(name, sheet, issue, severity) of a snapshot against its manifest."""
    books = reliability.snapshot_drift(baseline.workbooks, current.workbooks).select("name", F.lit("").alias("sheet"), "issue", "severity")
    return books.unionByName(reliability.sheet_drift(baseline.sheets, current.sheets).select("name", "sheet", "issue", "severity"))


def issue_codes(found: DataFrame) -> list[str]:
    """The distinct codes, of which there are nine at most."""
    return sorted(r.issue for r in found.select("issue").distinct().collect())


def snapshot_lab(spark: SparkSession, folder: str, work: str) -> Lab:
    """REL: missing, duplicate, renamed, emptied and repeated input; needs a workbook with a candidate sheet."""
    lab, scene = Lab(spark, "REL"), Path(work) / "scene"
    baseline = build_manifest(spark, folder, f"{work}/preview").save(f"{work}/manifest")
    validate = lambda at: issue_codes(validate_snapshot(baseline, build_manifest(spark, str(at), f"{work}/preview-now")))
    names = faults.copy_workbooks(folder, scene)
    sheet = baseline.sheets.where("sheet_type = 'influencer_candidate'").orderBy("name", "sheet").first()
    if validate(folder) or sheet is None:
        raise ValueError("the approved folder doesn't pass its own manifest, or has no candidate sheet")

    def experiment(number: int, failure: str, target: str, inject: Callable[[Path], int], wanted: str) -> None:
        changed = inject(scene / target)
        lab.step(number, "inject", f"{failure} in a copy of {target}: {changed}")
        codes = validate(scene)
        lab.step(number, "detect", codes)
        faults.copy_workbooks(folder, scene)
        after = validate(scene)
        lab.step(number, "recover", after or "clean")
        lab.conclude(number, failure, codes, "FAIL" if after else "PASS", changed, wanted in codes and not after and changed > 0)

    experiment(1, "missing_workbook", names[-1], lambda p: p.unlink() or 1, "MISSING_WORKBOOK")
    experiment(2, "duplicate_workbook", names[0], lambda p: len([shutil.copy2(p, p.with_name(f"DUPLICATE__{p.name}"))]), "DUPLICATE_WORKBOOK_HASH")
    experiment(3, "schema_drift_column_rename", sheet.name, lambda p: faults.rename_string(p, "Follower", "Audience Size"), "CANDIDATE_SCHEMA_DRIFT")
    experiment(4, "empty_candidate_sheet", sheet.name, lambda p: min(1, faults.clear_sheet(p, sheet.sheet)), "EMPTY_SHEET")
    fingerprint = bucketed_fingerprint(baseline.workbooks, ["name", "content_hash"]).first().fingerprint
    ledger = reliability.Ledger(Path(work) / "batches.json")
    actions = [ledger.register(fingerprint), ledger.register(fingerprint)]
    lab.step(5, "rerun", actions)
    lab.conclude(5, "same_batch_rerun_idempotency", actions[1:], "PASS", ledger.document["batches"][fingerprint], actions == ["PROCESS_NEW_BATCH", "SKIP_ALREADY_PROCESSED"])
    lab.check("baseline_workbooks", len(names))
    left = validate(folder)
    lab.check("source_issues_left", len(left), not left)
    return lab


# --- operations -------------------------------------------------------------------------------------------------


def operations_lab(spark: SparkSession, rows: DataFrame, keys: list[str], work: str) -> Lab:
    """OPS: a wrong state, a load that broke off, a dependency that comes back, and a run beyond its limits."""
    lab, expected = Lab(spark, "OPS"), rows.count()
    fingerprint = bucketed_fingerprint(rows, keys).first().fingerprint
    ledger = reliability.Ledger(Path(work) / "runs.json")

    def ran(run_id: str, status: str, loaded: int, code: str = "") -> None:
        ledger.append_run(run_id=run_id, status=status, batch_fingerprint=fingerprint, rows_attempted=expected, rows_loaded=loaded, failure_code=code)
        lab.run(run_id, status, expected, loaded, code)

    ran("ops_baseline_success", "SUCCESS", expected)
    bad = reliability.state_problem(reliability.new_state("tampered_unknown_batch_fingerprint"), ledger)
    good = reliability.state_problem(reliability.new_state(fingerprint), ledger)
    lab.step(1, "detect", bad)
    lab.step(1, "recover", good)
    ran("ops_bad_incremental_state", "FAILED", 0, bad)
    lab.conclude(1, "bad_incremental_state", [bad], good, 0, (bad, good) == ("BAD_INCREMENTAL_STATE_UNKNOWN_BATCH", "INCREMENTAL_STATE_VALID"))

    load = reliability.TwoPhase(work, "ops_partial_load")
    load.stage(rows.where(F.pmod(F.xxhash64(*keys), F.lit(10)) < 3))
    torn = load.state(spark)
    lab.step(2, "detect", torn)
    ran("ops_partial_load", "FAILED", 0, torn)
    action, again, after = load.recover(rows), load.commit(rows), load.state(spark)
    committed = spark.read.parquet(load.committed).count()
    lab.step(2, "recover", action)
    lab.step(2, "rerun", again)
    ran("ops_partial_load_recovery", "SUCCESS", committed)
    lab.conclude(2, "partial_load", [torn], after, committed, torn == "PARTIAL_LOAD_STAGING_WITHOUT_COMMIT" and after == "LOAD_STATE_CLEAN" and again == "SKIP_ALREADY_COMMITTED" and committed == expected)

    failures = iter([True, True, False])

    def dependency() -> str:
        if next(failures):
            raise reliability.RetryableDependencyError("not there yet")
        return "READY"

    result, attempts = reliability.execute_with_retry(dependency, 4, (1, 2, 4))
    for a in attempts:
        lab.step(3, a["status"].lower(), f"attempt {a['attempt']} after {a['backoff_seconds']} s")
    ran("ops_retry_recovery", "SUCCESS", expected)
    lab.conclude(3, "retry_recovery_transient_dependency", ["RetryableDependencyError"], str(result), len(attempts), result == "READY" and len(attempts) == 3)

    kind = "run_id string, status string, duration_seconds double, retry_count int, rows_attempted long, rows_loaded long, rows_rejected int"
    told = temporal.monitoring_events(spark.createDataFrame([("bad", "FAILED", 780.0, 3, max(expected, 1), expected // 2, 3), ("clean", "SUCCESS", 55.0, 0, expected, expected, 0)], kind))
    codes = {r.run_id: list(r.codes) for r in told.groupBy("run_id").agg(F.array_sort(F.collect_list("event_code")).alias("codes")).collect()}
    alerts = temporal.simple_alerts(told.where("run_id = 'bad'")).count()
    ran("ops_monitoring_injected_failure", "FAILED", expected // 2, ";".join(codes.get("bad", [])))
    ran("ops_monitoring_recovery", "SUCCESS", expected)
    lab.step(4, "alert", alerts)
    lab.conclude(4, "monitoring_alerting", codes.get("bad", []), "FAIL" if "clean" in codes else "PASS", alerts, len(codes.get("bad", [])) >= 4 and alerts == len(codes["bad"]) and "clean" not in codes)
    lab.check("feature_input_rows", expected)
    lab.check("partial_load_recovered_rows", committed, committed == expected)
    return lab


# --- time -------------------------------------------------------------------------------------------------------


def temporal_lab(spark: SparkSession, rows: DataFrame, key: str, lookback_days: int = 7, lag_days: int = 2) -> Lab:
    """TEMP: a late row, watermarks ahead and stale, a backfill with its rerun, and missed service levels; rows(key, event_date)."""
    lab = Lab(spark, "TEMP")
    rows = rows.select(key, "event_date")
    span = rows.agg(F.max("event_date").alias("newest"), F.count_distinct(key).alias("n")).first()
    if span.newest is None:
        raise ValueError("no dated rows")
    newest, expected = span.newest, span.n
    mark = newest - timedelta(days=lag_days)
    start, previous, current = mark - timedelta(days=lookback_days), mark + timedelta(days=1), mark + timedelta(days=5)
    late = rows.where(F.col("event_date").between(F.lit(start), F.lit(mark))).agg(F.max(F.struct("event_date", key)).alias("r")).first().r
    if late is None:
        raise ValueError("no row within the backfill window")
    arrived = temporal.with_arrival(rows, key, 1, {late[key]: (previous + timedelta(days=3) - late.event_date).days})
    selected = temporal.incremental(arrived, str(mark))
    found = temporal.late_arrivals(arrived, str(mark), str(previous), str(current))
    n_late, missed = found.count(), selected.where(F.col(key) == late[key]).isEmpty()
    lab.step(1, "inject", f"{key} {late[key]} of {late.event_date} arrives late")
    lab.step(1, "detect", n_late)
    lab.run("temporal_late_arrival_detection", "SUCCESS", expected, expected - 1, "LATE_ARRIVAL_BEHIND_WATERMARK")
    lab.conclude(1, "late_arriving_data", ["LATE_ARRIVAL_BEHIND_WATERMARK"], "TEMP-004", n_late, missed and not found.where(F.col(key) == late[key]).isEmpty())

    marks = spark.createDataFrame([(2, "watermark_ahead_of_source", newest + timedelta(days=15)), (3, "stale_watermark", newest - timedelta(days=30))], "number int, failure string, mark date")
    states = marks.select("number", "failure", temporal.watermark_state(F.col("mark").cast("string"), F.lit(newest), 7).alias("w")).orderBy("number").collect()
    for s, wanted in zip(states, ("WATERMARK_AHEAD_OF_SOURCE", "WATERMARK_STALE"), strict=True):
        lab.step(s.number, "detect", s.w.code)
        lab.run(f"temporal_bad_{s.failure}", "FAILED", expected, 0, s.w.code)
        lab.conclude(s.number, s.failure, [s.w.code], "restore the last watermark that was reconciled", s.w.lag_days, s.w.code == wanted)

    loaded = rows.where(F.col(key) != late[key])
    new, _ = temporal.safe_backfill(rows, str(start), str(mark), loaded, key, [F.col("event_date")])
    merged = upsert(loaded, new, [key])
    first = upsert_counts(merged).first()
    again = upsert_counts(upsert(merged.drop("action"), new, [key])).first()
    lab.step(4, "backfill", first.inserted)
    lab.step(4, "rerun", again.inserted)
    lab.run("temporal_safe_backfill", "SUCCESS", expected, again.row_count)
    lab.conclude(4, "safe_backfill_and_idempotency", ["BACKFILL_RECONCILIATION"], "PASS" if again.row_count == expected else "FAIL", first.inserted, (first.inserted, again.inserted, again.updated, again.row_count) == (1, 0, 0, expected))

    kind = "run_id string, as_of_date date, latest_event_date date, watermark_date date, expected_rows long, loaded_rows long"
    asked = newest + timedelta(days=1)
    runs = [("degraded", asked, newest - timedelta(days=5), newest - timedelta(days=8), expected, expected - max(10, expected // 20)), ("recovered", asked, newest, newest, expected, expected)]
    told = temporal.temporal_events(spark.createDataFrame(runs, kind))
    events = told.orderBy("event_code").collect()
    alerts = temporal.escalated_alerts(told, [F.col("event_code")]).count()
    codes = [e.event_code for e in events if e.run_id == "degraded"]
    lab.step(5, "alert", alerts)
    lab.run("temporal_slo_breach", "SUCCESS_WITH_DATA_SLO_BREACH", expected, runs[0][-1], ";".join(codes))
    lab.run("temporal_slo_recovery", "SUCCESS", expected, expected)
    lab.conclude(5, "freshness_completeness_slo_and_alert_escalation", codes, "PASS" if len(codes) == len(events) else "FAIL", alerts, len(codes) >= 3 and len(codes) == len(events) and any(e.severity == "CRITICAL" for e in events))
    lab.check("dated_rows", expected)
    return lab


# --- queries ----------------------------------------------------------------------------------------------------


def work_folder(spark: SparkSession) -> str:
    """A fresh folder in the checkpoint folder, which executors share, if there is one."""
    shared = (spark.conf.get("spark.checkpoint.dir", "") or "").removeprefix("file://")
    return tempfile.mkdtemp(prefix="lab-", dir=shared if shared and Path(shared).is_dir() else None)


@query("reliability_lab")
def snapshot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_lab(spark, example_workbooks(spark, sf_dir), work_folder(spark)).frames()["experiments"]


@query(
    "operational_lab",
    """SELECT * FROM (VALUES ('OPS-001', 'bad_incremental_state', 'BAD_INCREMENTAL_STATE_UNKNOWN_BATCH', 'INCREMENTAL_STATE_VALID', CAST(0 AS BIGINT), 'PASS'),
      ('OPS-002', 'partial_load', 'PARTIAL_LOAD_STAGING_WITHOUT_COMMIT', 'LOAD_STATE_CLEAN', (SELECT count(*) FROM customer), 'PASS'),
      ('OPS-003', 'retry_recovery_transient_dependency', 'RetryableDependencyError', 'READY', 3, 'PASS'),
      ('OPS-004', 'monitoring_alerting', 'REJECTED_ROWS_HIGH;RETRY_COUNT_HIGH;ROW_COMPLETENESS_LOW;RUN_DURATION_HIGH;RUN_FAILED', 'PASS', 5, 'PASS')) AS t(experiment_id, failure_type, detection, recovery, observed, pass_fail)""",
)
def operations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations_lab(spark, read_table(spark, sf_dir, "customer"), ["c_custkey"], work_folder(spark)).frames()["experiments"]


@query(
    "temporal_lab",
    """WITH d AS (SELECT max(CAST(ts AS DATE)) AS newest FROM events), x AS (SELECT newest, newest - 2 AS mark FROM d), l AS (SELECT max(event_id) AS id FROM events, x WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events, x WHERE CAST(ts AS DATE) BETWEEN mark - 7 AND mark)),
    a AS (SELECT event_id, CAST(ts AS DATE) AS day, CASE WHEN event_id = (SELECT id FROM l) THEN mark + 4 ELSE CAST(ts AS DATE) + 1 END AS arrival, mark FROM events, x)
    SELECT 'TEMP-001' AS experiment_id, 'late_arriving_data' AS failure_type, 'LATE_ARRIVAL_BEHIND_WATERMARK' AS detection, 'TEMP-004' AS recovery, (SELECT count(*) FROM a WHERE day <= mark AND arrival > mark + 1 AND arrival <= mark + 5) AS observed, 'PASS' AS pass_fail
    UNION ALL SELECT 'TEMP-002', 'watermark_ahead_of_source', 'WATERMARK_AHEAD_OF_SOURCE', 'restore the last watermark that was reconciled', -15, 'PASS'
    UNION ALL SELECT 'TEMP-003', 'stale_watermark', 'WATERMARK_STALE', 'restore the last watermark that was reconciled', 30, 'PASS'
    UNION ALL SELECT 'TEMP-004', 'safe_backfill_and_idempotency', 'BACKFILL_RECONCILIATION', 'PASS', (SELECT count(*) FROM events WHERE event_id = (SELECT id FROM l)), 'PASS'
    UNION ALL SELECT 'TEMP-005', 'freshness_completeness_slo_and_alert_escalation', 'COMPLETENESS_SLO_BREACH;FRESHNESS_SLO_BREACH;WATERMARK_LAG_HIGH', 'PASS', 5, 'PASS'""",
)
def temporal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("event_date"))
    return temporal_lab(spark, rows, "event_id").frames()["experiments"]
