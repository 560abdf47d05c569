"""Personal data in text: detection and suppression."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import ERROR_LITERALS, contains_any, safe_text, stripped

#: Words of Thai addresses, and of phone numbers.
ADDRESS_MARKERS = ["จังหวัด", "อำเภอ", "ตำบล", "แขวง", "เขต", "ซอย", "ถนน", "หมู่ที่"]
ADDRESS_WORD = "ที่อยู่"
PHONE_WORDS = ["เบอร์โทร", "โทร:", "โทร :", "tel:"]
#: Parts of column names that no table may carry out.
FORBIDDEN_COLUMNS = ["address", "phone", "tracking", "ที่อยู่", "เบอร์", "โทร", "เลขพัสดุ"]
PHONE = r"(?<!\d)0(?:[\s-]?\d){8,9}(?!\d)"
TRACKING = r"(?i)\b[A-Z]{2}\s*\d{9}\s*TH\b"


def looks_like_pii(x: Column) -> Column:
    """Thai phone numbers, addresses (two markers, or the word with a digit), phone words with digits, tracking numbers."""
    text = stripped(F.coalesce(x, F.lit("")))
    lower = F.lower(text)
    has_digit = text.rlike(r"\d")
    markers = reduce(add, [F.contains(text, F.lit(m)).cast("int") for m in ADDRESS_MARKERS])
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return (
        text.rlike(PHONE)
        | (F.contains(lower, F.lit(ADDRESS_WORD)) & has_digit)
        | (contains_any(lower, PHONE_WORDS) & (digits >= 9))
        | ((markers >= 2) & has_digit)
        | text.rlike(TRACKING)
    )


def suppressed(x: Column) -> Column:
    """struct(text, suppressed): the stripped text, or empty where it looks personal."""
    text = safe_text(x)
    personal = (text != "") & looks_like_pii(text)
    return F.struct(F.when(personal, "").otherwise(text).alias("text"), personal.alias("suppressed"))


def pii_safe_text(x: Column) -> Column:
    """The stripped text; empty where it is an error literal or looks personal."""
    text = safe_text(x)
    return F.when(text.isin(*ERROR_LITERALS) | looks_like_pii(text), "").otherwise(text)


def check_columns(names: list[str]) -> None:
    """Raise if a column's name tells of personal data."""
    bad = [n for n in names if any(w in n.lower() for w in FORBIDDEN_COLUMNS)]
    if bad:
        raise ValueError(f"columns with personal data: {', '.join(bad)}")
