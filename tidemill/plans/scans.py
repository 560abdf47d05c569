"""Queries over workbooks made from the example tables."""

from __future__ import annotations

import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import query, read_table
from tidemill.plans.sheets import candidate_observations, classify
from tidemill.sources import xlsx


#: Keys of suppliers that a workbook takes.
BOOK_ROWS = 5000


def write_book(folder: str, book: int, keys: list[int]) -> None:
    header = ["Number", "Influencer", "Link Tiktok", "Follower", "Engagement %", "BUDGET"]
    body = [[k, f"Sup {k}", f"https://www.tiktok.com/@sup.{k}", 1000 + k, "5.4%", "*Free*" if k % 2 else 1500] for k in sorted(keys)]
    xlsx.write_workbook(f"{folder}/book-{book:06d}.xlsx", {"KOL List": [["Tier Nano"], header, *body], "Report Oct": [["Date", "Revenue"], ["2025-10-01", 5]]})


def example_workbooks(spark: SparkSession, sf_dir: str) -> str:
    """A folder with workbooks of all suppliers as candidates, each written by a task; in the checkpoint folder, which executors share, if there is one."""
    shared = (spark.conf.get("spark.checkpoint.dir", "") or "").removeprefix("file://")
    folder = tempfile.mkdtemp(prefix="workbooks-", dir=shared if shared and Path(shared).is_dir() else None)

    def write(rows: pa.Table) -> pa.Table:
        book = rows.column("book")[0].as_py()
        write_book(folder, book, rows.column("s_suppkey").to_pylist())
        return pa.table({"book": pa.array([book], pa.int64())})

    keys = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.floor(F.col("s_suppkey") / BOOK_ROWS).cast("long").alias("book"))
    keys.groupBy("book").applyInArrow(write, "book long").count()
    return folder


@query("xlsx_scan")
def scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of all suppliers' workbooks, by way of reader, classification and adapter."""
    xlsx.register(spark)
    grid = spark.read.format("xlsx").option("path", example_workbooks(spark, sf_dir)).load()
    wanted = classify(grid).where("sheet_type = 'influencer_candidate'").select("file", "sheet")
    found = candidate_observations(grid.join(wanted, ["file", "sheet"], "left_semi"))
    return found.select("source_sheet_name", "source_row_number", "canonical_handle_candidate", "follower_normalized", F.round("engagement_normalized", 6).alias("engagement_normalized"), "fee_model", "dq_status", "dq_codes", "section_context_raw")
