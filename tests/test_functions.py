"""Golden values of the column functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import identity, parse, pii, requirements, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "percent", "expected"),
    [("21K", False, 21000.0), (": 11,489", False, 11489.0), ("5.4%%", True, 0.054), ("`11047`", False, 11047.0), ("12,84%", True, 0.1284), ("2m", False, 2e6), ("-", False, None), ("nan", False, None), ("1_000", False, None), (None, False, None)],
)
def test_parse_number(spark, raw, percent, expected):
    got = value(spark, parse.parse_number(F.lit(raw).cast("string"), percent))
    assert got == (pytest.approx(expected) if expected is not None else None)


def test_metric_numbers_keep_percent_and_have_no_m(spark):
    assert value(spark, parse.parse_metric(F.lit("12%"))) == 12.0
    assert value(spark, parse.parse_metric(F.lit("2m"))) is None


@pytest.mark.parametrize(
    ("raw", "model", "amount"),
    [("*Free*", "free", 0.0), ("Barter No Budget", "barter", 0.0), ("1500/hr", "hourly", 1500.0), ("ยังไม่ตอบกลับ", "pending", None), ("2500", "fixed", 2500.0), ("ask", "unknown", None), (" - ", "missing", None), (None, "missing", None)],
)
def test_parse_fee(spark, raw, model, amount):
    got = value(spark, parse.parse_fee(F.lit(raw).cast("string")))
    assert (got["model"], got["amount"]) == (model, amount)


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("@bbNawut (@bb.nattawut) | TikTok", "bb.nattawut"), ("creamwor (Cream)", "creamwor"), ("https://www.tiktok.com/@Creator_A?x=1", "creator_a"), ("plain.name", "plain.name"), ("two words", None), ("-", None)],
)
def test_extract_handle(spark, raw, expected):
    assert value(spark, identity.extract_handle(F.lit(raw))) == expected


@pytest.mark.parametrize(("raw", "expected"), [("ที่อยู่ 12/3 โทร 0812345678", True), ("หมู่บ้านสวย", False), ("WB222936496TH", True), ("tel: 123", False), ("ถนน 5 แขวง x", True), ("", False), (None, False)])
def test_looks_like_pii(spark, raw, expected):
    assert value(spark, pii.looks_like_pii(F.lit(raw).cast("string"))) is expected


def test_dates_and_truth(spark):
    assert value(spark, parse.excel_date(F.lit("46125"))) == "2026-04-13"
    assert value(spark, parse.strict_date(F.lit("2026-2-3"))) is None
    assert str(value(spark, parse.lenient_date(F.lit("2026-2-3")))) == "2026-02-03"
    assert [value(spark, f(F.lit("t"))) for f in (parse.source_truth, parse.warehouse_truth, parse.two_state_truth)] == [None, True, False]


def test_requirement_fits(spark):
    lit = F.lit
    assert value(spark, requirements.age_overlap(lit(18), lit(34), lit(18), lit(24))) == 100.0
    assert value(spark, requirements.age_overlap(lit(18), lit(24), lit(20), lit(29))) == 50.0
    history = F.array(lit("hair_care"))
    assert value(spark, requirements.tag_coverage(F.array(lit("hair_care"), lit("skin_care")), history)) == 50.0
    assert value(spark, requirements.tag_coverage(F.array().cast("array<string>"), history)) is None
    assert value(spark, requirements.tag_coverage(F.array(lit("x")), F.array().cast("array<string>"))) == 0.0
    assert value(spark, requirements.target_gender(lit("หญิง 70% ชาย 30%")))["mode"] == "mixed_weighted"
    assert value(spark, requirements.gender_fit(lit("mixed_weighted"), lit(0.0), lit(0.5), lit("male"), lit(2), 50.0)) == 80.0
    assert value(spark, requirements.age_range(lit("18 - 24 ปี")))["age_max"] == 24
    assert value(spark, requirements.tags(lit("โลชั่น ผิวแห้ง"), requirements.TAXONOMY["campaign_theme"])) == ["skin_care"]


def test_stable_id_keeps_nulls_apart(spark):
    a = value(spark, identity.stable_id("cmp", F.lit("x"), F.lit(None).cast("string"), F.lit("y")))
    b = value(spark, identity.stable_id("cmp", F.lit("x"), F.lit("y")))
    assert a != b and a.startswith("cmp_") and len(a) == 20


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 700))
def test_column_letters_round_trip(spark, index):
    letters = value(spark, text.column_letters(F.lit(index)))
    assert value(spark, text.column_letters_index(F.lit(letters))) == index
