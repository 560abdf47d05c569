"""The warehouse: text staging, typed core by idempotent upserts, data-quality gate, and a run state that only moves forward."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import query, read_table
from tidemill.contracts import CONTRACTS, TableContract, missing_columns, orphans, reference_violations
from tidemill.functions.parse import strict_date, try_integer, try_numeric, warehouse_truth
from tidemill.functions.text import blank_to_null
from tidemill.operators.dedupe import extra_occurrences
from tidemill.operators.fingerprint import table_fingerprint
from tidemill.operators.reconcile import check_rows, count_reconciliation
from tidemill.operators.upsert import rerun_effect, upsert
from tidemill.plans.history import campaign_facts
from tidemill.plans.proxy import observations
from tidemill.sources.files import read_text_table, rename_path, write_json

STAGES = ["PRE_LOAD", "STAGING_LOAD", "CORE_UPSERT", "RECONCILIATION", "COMPLETED"]
CHECKS = [
    "missing_staging_keys_after_upsert", "duplicate_campaign_influencer_groups", "orphan_campaign_influencer", "orphan_deliverable_campaign",
    "orphan_deliverable_influencer", "influencer_mart_grain_mismatch", "campaign_mart_grain_mismatch", "mart_fanout_mismatch",
]


def with_date_twins(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each date column parsed, beside its raw text."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({f"{c}_raw": F.col(c) for c in present}).withColumns({c: strict_date(F.col(f"{c}_raw")) for c in present})


def promoted(staged: DataFrame, contract: TableContract) -> DataFrame:
    """Typed core rows of text staging rows: blanks are null, what can't be read is null, columns get their core names."""

    def typed(name: str) -> Column:
        text = blank_to_null(F.col(name))
        if name in contract.decimals:
            return try_numeric(text, contract.decimals[name])
        if name in contract.integers:
            return try_integer(text)
        if name in contract.booleans:
            return warehouse_truth(text)
        if name in contract.date_columns:
            return strict_date(text)
        return text

    twins = [blank_to_null(F.col(c)).alias(f"{c}_raw") for c in contract.date_columns if c in staged.columns and f"{c}_raw" not in staged.columns]
    return staged.select(*[typed(c).alias(contract.renamed.get(c, c)) for c in staged.columns], *twins)


def core_upsert(core: DataFrame | None, staged: DataFrame, contract: TableContract) -> DataFrame:
    """The core table after the staged rows; loaded_at stays with rows that were there, also when they change."""
    new = promoted(staged, contract).withColumn("loaded_at", F.current_timestamp())
    keys = list(contract.conflict_key or contract.primary_key)
    if core is None:
        core = new.limit(0)
    return upsert(core, new, keys, [F.col(c).cast("string") for c in contract.primary_key], kept="loaded_at")


def dq_vector(staged_keys: DataFrame, facts: DataFrame, deliverables: DataFrame, influencers: DataFrame, campaigns: DataFrame, influencer_mart: DataFrame, campaign_mart: DataFrame) -> DataFrame:
    """(check_name, observed, expected, status) of the eight checks, each of which must observe 0.

    staged_keys(campaign_id, influencer_id) are the pairs that staging promised.
    """
    pair = ["campaign_id", "influencer_id"]
    number = lambda df, name: df.agg(F.count("*").alias(name))
    fanout = influencer_mart.agg(F.sum("campaign_count").alias("a")).crossJoin(facts.select(*pair).distinct().agg(F.count("*").alias("b")))
    gap = lambda a, b, name: number(a, "a").crossJoin(number(b, "b")).select(F.abs(F.col("a") - F.col("b")).alias(name))
    parts = [
        number(staged_keys.join(facts, pair, "left_anti"), CHECKS[0]),
        number(facts.groupBy(*pair).count().where("count > 1"), CHECKS[1]),
        number(orphans(facts, ("campaign_id",), campaigns, ("campaign_id",)), CHECKS[2]),
        number(orphans(deliverables, ("campaign_id",), campaigns, ("campaign_id",)), CHECKS[3]),
        number(orphans(deliverables, ("influencer_id",), influencers, ("influencer_id",)), CHECKS[4]),
        gap(influencer_mart, influencers, CHECKS[5]),
        gap(campaign_mart, campaigns, CHECKS[6]),
        fanout.select(F.abs(F.coalesce("a", F.lit(0)) - F.col("b")).alias(CHECKS[7])),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(p)  # one row each
    return check_rows(row, [(c, c) for c in CHECKS])


@dataclass(frozen=True)
class RunResult:
    run_id: str
    status: str
    fingerprint: str
    counts: dict[str, int]


class Warehouse:
    """A warehouse in one folder, with one writer. Each core table has versions; the state file names the current ones.

    A run goes through STAGES by compare-and-set on its own file; the state moves last, after the checks, so that a
    failed run leaves readers with what they had. A batch that is already loaded is skipped.
    """

    def __init__(self, spark: SparkSession, root: str, contracts: dict[str, TableContract] = CONTRACTS):
        self.spark, self.root, self.contracts = spark, Path(root), contracts

    def state(self) -> dict:
        path = self.root / "ops" / "state.json"
        return json.loads(path.read_text()) if path.exists() else {"fingerprint": None, "tables": {}}

    def core(self, name: str) -> DataFrame | None:
        at = self.state()["tables"].get(name)
        return self.spark.read.parquet(at) if at else None

    def run_file(self, run_id: str) -> Path:
        return self.root / "ops" / "runs" / f"{run_id}.json"

    def _move(self, run_id: str, expected: str, to: str, **more: object) -> None:
        """Compare-and-set of a run's stage."""
        run = json.loads(self.run_file(run_id).read_text())
        if run["stage"] != expected:
            raise RuntimeError(f"run {run_id} is in {run['stage']}, not in {expected}")
        write_json(self.run_file(run_id), run | {"stage": to} | more)

    def batch_fingerprint(self, folder: str) -> str:
        """Of the files' names and contents, in order of names."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(folder)
        lines = files.select(F.concat_ws(":", F.element_at(F.split("path", "/"), -1), F.sha2("content", 256)).alias("line"))
        return lines.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256)).first()[0]

    def stage(self, folder: str, run_id: str) -> dict[str, DataFrame]:
        """Staging tables of text, one for each contract's CSV."""
        staged = {}
        for name in self.contracts:
            path = Path(folder) / f"{name}.csv"
            if not path.exists():
                raise FileNotFoundError(path)
            rows = read_text_table(self.spark, str(path))
            if missing := missing_columns(rows, self.contracts[name]):
                raise ValueError(f"{name} lacks {', '.join(missing)}")
            target = str(self.root / "stg" / run_id / name)
            rows.write.mode("overwrite").parquet(target)
            staged[name] = self.spark.read.parquet(target)
        return staged

    def load(self, folder: str) -> RunResult:
        """Load a folder of CSVs, or skip it where it is the batch that was loaded last."""
        fingerprint = self.batch_fingerprint(folder)
        run_id = f"run_{uuid.uuid4().hex[:12]}"
        tables = self.state()["tables"]
        if self.state()["fingerprint"] == fingerprint:
            counts = {n: self.core(n).count() for n in tables}
            write_json(self.run_file(run_id), {"run_id": run_id, "status": "SKIPPED", "stage": "COMPLETED", "fingerprint": fingerprint})
            return RunResult(run_id, "SKIPPED", fingerprint, counts)
        write_json(self.run_file(run_id), {"run_id": run_id, "status": "RUNNING", "stage": "PRE_LOAD", "fingerprint": fingerprint})
        try:
            self._move(run_id, "PRE_LOAD", "STAGING_LOAD")
            staged = self.stage(folder, run_id)
            expected = {n: read_text_table(self.spark, str(Path(folder) / f"{n}.csv")).count() for n in staged}
            if count_reconciliation(staged, expected).where("status = 'FAIL'").count():
                raise ValueError("staged rows don't match the files")
            self._move(run_id, "STAGING_LOAD", "CORE_UPSERT")
            new = {}
            for name, contract in self.contracts.items():
                part = str(self.root / "_staging" / run_id / name)
                core_upsert(self.core(name), staged[name], contract).drop("action").write.parquet(part)
                new[name] = str(self.root / "core" / name / run_id)
                rename_path(self.spark, part, new[name])
            self._move(run_id, "CORE_UPSERT", "RECONCILIATION")
            core = {n: self.spark.read.parquet(p) for n, p in new.items()}
            bad = reference_violations(core, self.contracts).where("violations > 0").count()
            write_json(self.root / "ops" / "dq" / f"{run_id}.json", {"run_id": run_id, "reference_violations": bad})
            if bad:
                raise ValueError(f"{bad} references point nowhere")
            write_json(self.root / "ops" / "state.json", {"fingerprint": fingerprint, "run_id": run_id, "tables": new})
            self._move(run_id, "RECONCILIATION", "COMPLETED", status="SUCCESS")
            return RunResult(run_id, "SUCCESS", fingerprint, {n: df.count() for n, df in core.items()})
        except Exception as e:
            run = json.loads(self.run_file(run_id).read_text())
            write_json(self.run_file(run_id), run | {"status": "FAILED", "failed_stage": run["stage"], "error": str(e)[:1800]})
            raise


# --- queries ----------------------------------------------------------------------------------------------------


@query(
    "fk_violations",
    """SELECT 'orders' AS child, CAST(count(*) AS BIGINT) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)
    UNION ALL SELECT 'lineitem', CAST(count(*) AS BIGINT) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3)""",
)
def fk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read_table(spark, sf_dir, n)
    a = orphans(t("orders"), ("o_custkey",), t("customer").where("c_custkey % 10 <> 3"), ("c_custkey",))
    b = orphans(t("lineitem"), ("l_suppkey",), t("supplier").where("s_suppkey % 10 <> 3"), ("s_suppkey",))
    return a.agg(F.lit("orders").alias("child"), F.count("*").alias("violations")).unionByName(b.agg(F.lit("lineitem").alias("child"), F.count("*").alias("violations")))


@query(
    "duplicate_pk",
    "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_extendedprice, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS INTEGER) AS occurrence FROM lineitem QUALIFY occurrence > 1",
)
def duplicate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")]
    return extra_occurrences(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "occurrence")


@query(
    "table_fingerprint",
    """SELECT sha256(string_agg(l, chr(10) ORDER BY l) || chr(10)) AS fingerprint, CAST(count(*) AS BIGINT) AS row_count FROM (SELECT n_nationkey || '|' || n_name AS l FROM nation)""",
)
def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_fingerprint(read_table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"])


UPSERT_SQL = """e AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'Z' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 2 = 0)"""


@query(
    "upsert",
    f"WITH {UPSERT_SQL} SELECT coalesce(e.k, i.k) AS k, coalesce(i.v, e.v) AS v, CASE WHEN e.k IS NULL THEN 'inserted' WHEN i.k IS NULL OR e.v = i.v THEN 'unchanged' ELSE 'updated' END AS action FROM e FULL JOIN i ON e.k = i.k",
)
def upsert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return upsert(o.where("k % 3 <> 0"), o.where("k % 2 = 0").withColumn("v", F.when(F.col("k") % 4 == 0, "Z").otherwise(F.col("v"))), ["k"])


@query("idempotent_rerun", "SELECT count(DISTINCT l_orderkey) AS first_count, count(DISTINCT l_orderkey) AS second_count, CAST(0 AS BIGINT) AS changed_on_rerun, count(*) AS incoming_count FROM lineitem")
def rerun_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey")]
    return rerun_effect(read_table(spark, sf_dir, "lineitem"), ["l_orderkey"], order)


@query(
    "dq_vector_unpivot",
    """WITH p AS (SELECT DISTINCT l_partkey AS c, l_suppkey AS i FROM lineitem), f AS (SELECT * FROM p WHERE c % 100 <> 0)
    SELECT check_name, CAST(observed AS BIGINT) AS observed, CAST(0 AS BIGINT) AS expected, CASE WHEN observed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT 'missing_staging_keys_after_upsert' AS check_name, count(*) AS observed FROM p WHERE c % 100 = 0 UNION ALL SELECT 'duplicate_campaign_influencer_groups', 0 UNION ALL SELECT 'orphan_campaign_influencer', count(*) FROM f WHERE c % 30 = 1
      UNION ALL SELECT 'orphan_deliverable_campaign', count(*) FROM lineitem WHERE l_partkey % 30 = 1 UNION ALL SELECT 'orphan_deliverable_influencer', count(*) FROM lineitem WHERE l_suppkey % 50 = 0
      UNION ALL SELECT 'influencer_mart_grain_mismatch', count(*) FROM supplier WHERE s_suppkey % 50 = 0 UNION ALL SELECT 'campaign_mart_grain_mismatch', 0 UNION ALL SELECT 'mart_fanout_mismatch', 0)""",
)
def dq_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    facts = campaign_facts(obs.where("campaign_id % 100 <> 0"))
    everyone = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("influencer_id"))
    campaigns = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("campaign_id")).where("campaign_id % 30 <> 1")
    mart = everyone.join(facts.groupBy("influencer_id").agg(F.count_distinct("campaign_id").alias("campaign_count")), "influencer_id", "left")
    return dq_vector(obs.select("campaign_id", "influencer_id").distinct(), facts, obs, everyone.where("influencer_id % 50 <> 0"), campaigns, mart, campaigns)


@query(
    "staging_recon",
    "SELECT 'supplier' AS table_name, count(*) AS observed, CAST(100 AS BIGINT) AS expected, CASE WHEN count(*) = 100 THEN 'PASS' ELSE 'FAIL' END AS status FROM supplier UNION ALL SELECT 'nation', count(*), CAST(24 AS BIGINT), CASE WHEN count(*) = 24 THEN 'PASS' ELSE 'FAIL' END FROM nation",
)
def recon_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_reconciliation({n: read_table(spark, sf_dir, n) for n in ("supplier", "nation")}, {"supplier": 100, "nation": 24})


@query(
    "try_cast_suite",
    """WITH v AS (SELECT * FROM (VALUES ('12.5'), ('1500.0'), ('7'), ('x'), (''), ('nan'), ('yes'), ('f'), ('2026-02-03'), ('2026-2-3'), ('2026-02'), ('1e3')) AS t(x))
    SELECT x, CASE WHEN regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(x AS DOUBLE) END AS numeric_value, CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN TRY_CAST(x AS INTEGER) END AS integer_value,
      CASE WHEN x IN ('true', 't', '1', 'yes') THEN true WHEN x IN ('false', 'f', '0', 'no') THEN false END AS boolean_value, CASE WHEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(x AS DATE) END AS date_value FROM v""",
)
def try_cast_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["12.5", "1500.0", "7", "x", "", "nan", "yes", "f", "2026-02-03", "2026-2-3", "2026-02", "1e3"]
    v = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in values])).alias("x"))
    x = F.col("x")
    return v.select("x", try_numeric(x, "double").alias("numeric_value"), try_integer(x).alias("integer_value"), warehouse_truth(x).alias("boolean_value"), strict_date(x).alias("date_value"))
