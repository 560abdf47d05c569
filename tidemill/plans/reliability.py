"""Files and runs: snapshot drift, batch ledger, incremental state, two-phase commit, retry."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import query, read_table
from tidemill.sources.files import rename_path, write_json


def snapshot_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(name, issue, severity) of workbooks(name, content_hash, error) against a baseline(name, content_hash).

    A workbook of both can be changed and unreadable; a group of equal ones is one issue under its first name.
    """
    b, c = baseline.alias("b"), current.alias("c")
    joined = b.join(c, F.col("b.name") == F.col("c.name"), "full_outer")
    gone, new = F.col("c.name").isNull(), F.col("b.name").isNull()
    issues = F.array_compact(
        F.array(
            F.when(gone, "MISSING_WORKBOOK"),
            F.when(new, "UNEXPECTED_WORKBOOK"),
            F.when(~gone & ~new & (F.col("b.content_hash") != F.col("c.content_hash")), "WORKBOOK_HASH_CHANGED"),
            F.when(~gone & ~new & F.col("c.error").isNotNull(), "WORKBOOK_UNREADABLE"),
        )
    )
    own = joined.select(F.coalesce("b.name", "c.name").alias("name"), F.explode(issues).alias("issue"))
    groups = current.where("content_hash is not null").groupBy("content_hash").agg(F.min("name").alias("name"), F.count("*").alias("n")).where("n > 1")
    return own.unionByName(groups.select("name", F.lit("DUPLICATE_WORKBOOK_HASH").alias("issue"))).withColumn("severity", F.lit("ERROR"))


def sheet_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(name, sheet, issue, severity, removed, added) of sheets(name, sheet, sheet_type, filled_rows, headers, signature).

    Only workbooks that are still there and readable are compared. A candidate sheet that is no candidate any more has a
    drifted schema; one that still is, but by other signals, gets a warning.
    """
    keys, candidate = ["name", "sheet"], "influencer_candidate"
    there = current.select("name").distinct()
    b = baseline.join(there, "name", "left_semi").select(*keys, *[F.col(x).alias(f"b_{x}") for x in ("sheet_type", "filled_rows", "headers", "signature")])
    joined = b.join(current, keys, "left")
    removed, added = F.array_sort(F.array_except("b_headers", "headers")), F.array_sort(F.array_except("headers", "b_headers"))
    here, was = F.col("filled_rows").isNotNull(), F.col("b_sheet_type") == candidate
    issue = lambda test, name, severity: F.when(test, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity")))
    found = F.array_compact(
        F.array(
            issue(~here, "MISSING_SHEET", "ERROR"),
            issue(here & (F.col("b_filled_rows") > 0) & (F.col("filled_rows") == 0), "EMPTY_SHEET", "ERROR"),
            issue(here & was & (F.col("sheet_type") != candidate), "CANDIDATE_SCHEMA_DRIFT", "ERROR"),
            issue(here & was & (F.col("sheet_type") == candidate) & (F.col("b_signature") != F.col("signature")), "CANDIDATE_HEADER_SIGNATURE_CHANGED", "WARN"),
        )
    )
    return joined.select(*keys, removed.alias("removed"), added.alias("added"), F.inline(found))


@dataclass
class Ledger:
    """Batches that were seen and runs that were made, kept in one JSON file by one writer."""

    path: Path
    document: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.path = Path(self.path)
        if self.path.exists():
            self.document = json.loads(self.path.read_text())
        self.document.setdefault("batches", {})
        self.document.setdefault("runs", [])

    def save(self) -> None:
        write_json(self.path, self.document)

    def register(self, fingerprint: str) -> str:
        """PROCESS_NEW_BATCH for a batch seen first, else SKIP_ALREADY_PROCESSED."""
        seen = self.document["batches"].get(fingerprint, 0)
        self.document["batches"][fingerprint] = seen + 1
        self.save()
        return "SKIP_ALREADY_PROCESSED" if seen else "PROCESS_NEW_BATCH"

    def append_run(self, **event: object) -> None:
        self.document["runs"].append(event)
        self.save()

    def successful(self) -> set[str]:
        return {r["batch_fingerprint"] for r in self.document["runs"] if r.get("status") == "SUCCESS" and r.get("batch_fingerprint")}


def new_state(fingerprint: str, watermark: str | None = None) -> dict:
    return {"state_version": 1, "last_successful_batch_fingerprint": fingerprint, "watermark": watermark}


def state_problem(state: dict | None, ledger: Ledger) -> str:
    """INCREMENTAL_STATE_VALID, or what is wrong with an incremental state."""
    held = state or {}
    pointer = str(held.get("last_successful_batch_fingerprint") or "").strip()
    if held.get("state_version") != 1:
        return "BAD_INCREMENTAL_STATE_VERSION"
    if not pointer:
        return "BAD_INCREMENTAL_STATE_EMPTY_POINTER"
    return "INCREMENTAL_STATE_VALID" if pointer in ledger.successful() else "BAD_INCREMENTAL_STATE_UNKNOWN_BATCH"


@dataclass(frozen=True)
class TwoPhase:
    """A table written beside its place, then moved, then confirmed by a manifest."""

    root: str
    run_id: str

    @property
    def staging(self) -> str:
        return f"{self.root}/_staging/{self.run_id}"

    @property
    def committed(self) -> str:
        return f"{self.root}/data/{self.run_id}"

    @property
    def manifest(self) -> Path:
        return Path(self.root) / "manifests" / f"{self.run_id}.json"

    def stage(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.staging)

    def state(self, spark: SparkSession) -> str:
        """What a run left behind."""
        staged, committed = Path(self.staging).exists(), Path(self.committed).exists()
        if staged and not self.manifest.exists():
            return "PARTIAL_LOAD_STAGING_WITHOUT_COMMIT"
        if committed and self.manifest.exists() and spark.read.parquet(self.committed).count() != json.loads(self.manifest.read_text())["row_count"]:
            return "COMMITTED_ROW_COUNT_MISMATCH"
        return "LOAD_STATE_CLEAN"

    def commit(self, df: DataFrame) -> str:
        """COMMIT_NEW_BATCH, or SKIP_ALREADY_COMMITTED where manifest and data are there."""
        if self.manifest.exists() and Path(self.committed).exists():
            return "SKIP_ALREADY_COMMITTED"
        self.stage(df)
        n = df.sparkSession.read.parquet(self.staging).count()
        rename_path(df.sparkSession, self.staging, self.committed)
        write_json(self.manifest, {"run_id": self.run_id, "row_count": n})
        return "COMMIT_NEW_BATCH"

    def recover(self, df: DataFrame) -> str:
        """Stage and commit anew what a partial load left."""
        if self.state(df.sparkSession) != "PARTIAL_LOAD_STAGING_WITHOUT_COMMIT":
            return "NOTHING_TO_RECOVER"
        return self.commit(df)


class RetryableDependencyError(Exception):
    """A failure that a later attempt may not meet."""


class RetryExhaustedError(Exception):
    """Every allowed attempt failed."""


def execute_with_retry(operation: Callable[[], object], max_attempts: int = 3, backoff_seconds: Sequence[float] = (1.0, 2.0)) -> tuple[object, list[dict]]:
    """(result, attempts); only a retryable failure is tried again. The pause before an attempt is recorded, not slept; the last one given holds on."""
    if max_attempts < 1:
        raise ValueError("at least one attempt is needed")
    attempts: list[dict] = []
    for n in range(1, max_attempts + 1):
        pause = float(backoff_seconds[min(n - 2, len(backoff_seconds) - 1)]) if n > 1 and backoff_seconds else 0.0
        told = {"attempt": n, "backoff_seconds": pause}
        try:
            result = operation()
        except RetryableDependencyError as e:
            attempts.append({**told, "status": "RETRY" if n < max_attempts else "FAILED", "error_type": type(e).__name__, "error": str(e)})
            failure = e
        else:
            return result, [*attempts, {**told, "status": "SUCCESS", "error_type": "", "error": ""}]
    raise RetryExhaustedError(f"{max_attempts} attempts failed: {failure}", attempts) from failure


@query(
    "snapshot_drift_full_outer",
    """WITH b AS (SELECT 'doc_' || doc_id AS name, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), c AS (SELECT 'doc_' || doc_id AS name, CASE WHEN doc_id % 11 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h, CASE WHEN doc_id % 13 = 0 THEN 'bad zip' END AS e FROM documents WHERE doc_id % 5 <> 0)
    SELECT coalesce(b.name, c.name) AS name, CASE WHEN c.name IS NULL THEN 'MISSING_WORKBOOK' ELSE 'UNEXPECTED_WORKBOOK' END AS issue, 'ERROR' AS severity FROM b FULL JOIN c ON b.name = c.name WHERE c.name IS NULL OR b.name IS NULL
    UNION ALL SELECT b.name, 'WORKBOOK_HASH_CHANGED', 'ERROR' FROM b JOIN c ON b.name = c.name WHERE b.h <> c.h
    UNION ALL SELECT b.name, 'WORKBOOK_UNREADABLE', 'ERROR' FROM b JOIN c ON b.name = c.name WHERE e IS NOT NULL
    UNION ALL SELECT min(name), 'DUPLICATE_WORKBOOK_HASH', 'ERROR' FROM c GROUP BY h HAVING count(*) > 1""",
)
def drift_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").withColumn("name", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    baseline = d.where("doc_id % 7 <> 0").select("name", F.sha2("text", 256).alias("content_hash"))
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    current = d.where("doc_id % 5 <> 0").select("name", F.sha2(changed, 256).alias("content_hash"), F.when(F.col("doc_id") % 13 == 0, "bad zip").alias("error"))
    return snapshot_drift(baseline, current)
