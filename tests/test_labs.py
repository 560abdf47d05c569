"""Failure labs, their faults and the snapshot manifest."""

import zipfile

from pyspark.sql import functions as F

from tidemill.plans import labs
from tidemill.sources import faults, xlsx
from tidemill.sources.files import discover

HEADER = ["Influencer", "Link Tiktok", "Follower", "Engagement %", "BUDGET"]


def workbooks(folder):
    folder.mkdir()
    for i in range(3):
        body = [[f"P {i}", f"https://www.tiktok.com/@p.{i}", 1000 + i, "5%", 100]]
        xlsx.write_workbook(str(folder / f"book-{i}.xlsx"), {"KOL List": [["Tier"], HEADER, *body], "Report Oct": [["Date"], [f"2025-10-0{i + 1}"]], "Void": []})
    return folder


def test_faults_change_copies_only(spark, tmp_path):
    source, copy = workbooks(tmp_path / "in"), tmp_path / "copy"
    before = discover(spark, str(source)).collect()
    assert faults.copy_workbooks(source, copy) == ["book-0.xlsx", "book-1.xlsx", "book-2.xlsx"]
    book = copy / "book-0.xlsx"
    assert faults.rename_string(book, "Follower", "Audience Size") == 1 and faults.rename_string(book, "Follower", "x") == 0
    assert faults.clear_sheet(book, "Report Oct") == 2 and faults.clear_sheet(book, "Void") == 0
    with zipfile.ZipFile(book) as z:
        assert "Audience Size" in xlsx.shared_strings(z) and z.testzip() is None
    assert discover(spark, str(source)).collect() == before


def test_manifest_and_snapshot(spark, tmp_path):
    source, copy = workbooks(tmp_path / "in"), tmp_path / "copy"
    manifest = labs.build_manifest(spark, str(source), str(tmp_path / "a")).save(str(tmp_path / "manifest"))
    first = {r.sheet: r for r in manifest.sheets.where("name = 'book-0.xlsx'").collect()}
    assert (first["KOL List"].sheet_type, first["KOL List"].primary_header_row, first["KOL List"].filled_rows, first["Void"].filled_rows) == ("influencer_candidate", 2, 3, 0)
    assert "follower" in first["KOL List"].headers and "follower" in first["KOL List"].signature and first["Void"].headers == []
    faults.copy_workbooks(source, copy)
    (copy / "book-1.xlsx").write_text("no workbook")
    (copy / "book-9.xlsx").write_bytes((copy / "book-2.xlsx").read_bytes())
    faults.rename_string(copy / "book-0.xlsx", "Engagement %", "Rate")
    found = labs.validate_snapshot(manifest, labs.build_manifest(spark, str(copy), str(tmp_path / "b")))
    assert sorted((r.name, r.issue, r.severity) for r in found.collect()) == [
        ("book-0.xlsx", "CANDIDATE_HEADER_SIGNATURE_CHANGED", "WARN"),
        ("book-0.xlsx", "WORKBOOK_HASH_CHANGED", "ERROR"),
        ("book-1.xlsx", "WORKBOOK_HASH_CHANGED", "ERROR"),
        ("book-1.xlsx", "WORKBOOK_UNREADABLE", "ERROR"),
        ("book-2.xlsx", "DUPLICATE_WORKBOOK_HASH", "ERROR"),
        ("book-9.xlsx", "UNEXPECTED_WORKBOOK", "ERROR"),
    ]


def test_snapshot_lab(spark, tmp_path):
    lab = labs.snapshot_lab(spark, str(workbooks(tmp_path / "in")), str(tmp_path / "work"))
    frames = lab.frames()
    found = {r.experiment_id: r for r in frames["experiments"].collect()}
    assert lab.passed() and len(found) == 5
    assert found["REL-001"].detection == "MISSING_WORKBOOK" and found["REL-002"].detection == "DUPLICATE_WORKBOOK_HASH;UNEXPECTED_WORKBOOK"
    assert found["REL-004"].detection == "CANDIDATE_SCHEMA_DRIFT;EMPTY_SHEET;WORKBOOK_HASH_CHANGED"
    assert [r.step for r in frames["timeline"].where("experiment_id = 'REL-001'").orderBy("step_order").collect()] == ["inject", "detect", "recover"]
    assert frames["controls"].count() == 5 and frames["reconciliation"].where("status <> 'PASS'").isEmpty()


def test_operations_lab(spark, tmp_path):
    lab = labs.operations_lab(spark, spark.range(40).withColumnRenamed("id", "k"), ["k"], str(tmp_path))
    frames = lab.frames()
    assert lab.passed() and [r.observed for r in frames["experiments"].orderBy("experiment_id").collect()] == [0, 40, 3, 5]
    assert frames["runs"].where("status = 'SUCCESS'").count() == 4


def test_temporal_lab_tells_a_guard_that_fails(spark, monkeypatch):
    rows = spark.range(60).select(F.col("id").alias("k"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("event_date"))
    lab = labs.temporal_lab(spark, rows, "k")
    assert lab.passed() and [e[4] for e in lab.experiments] == [1, -15, 30, 1, 5]
    monkeypatch.setattr(labs.temporal, "late_arrivals", lambda rows, *_: rows.limit(0))
    assert not labs.temporal_lab(spark, rows, "k").passed()
