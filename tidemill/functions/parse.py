"""Numbers, fees, dates and truth values from text. Nothing here throws: what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import ERROR_LITERALS, normalized, stripped

PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Words for true and false, as each source writes them.
SOURCE_TRUE, SOURCE_FALSE = ["true", "1", "yes", "y"], ["false", "0", "no", "n"]
KNOWN_TRUE = [*SOURCE_TRUE, "posted", "confirm", "confirmed", "ลงแล้ว", "โพสต์แล้ว"]
KNOWN_FALSE = [*SOURCE_FALSE, "not posted", "ยังไม่ลง", "ไม่ลง"]
WAREHOUSE_TRUE, WAREHOUSE_FALSE = ["true", "t", "1", "yes"], ["false", "f", "0", "no"]
PENDING_WORDS = ["ยังไม่ตอบกลับ", "pending"]


def plain_double(x: Column) -> Column:
    """A double where the whole stripped text is a plain decimal number."""
    text = stripped(x)
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def parse_float(x: Column) -> Column:
    """Thousands commas are dropped; error literals and dashes are null."""
    return plain_double(F.regexp_replace(x, ",", ""))


def parse_int(x: Column) -> Column:
    """Truncated towards zero."""
    return parse_float(x).cast("long")


def parse_number(x: Column, percent: bool = False) -> Column:
    """A snapshot number: k and m suffixes; with `percent`, a decimal comma, and a percent sign divides by 100."""
    text = stripped(F.regexp_replace(stripped(x), ":", ""))
    text = F.regexp_replace(text, "^[`'\" ]+|[`'\" ]+$", "")
    had = F.contains(text, F.lit("%"))
    text = stripped(F.regexp_replace(text, "%", ""))
    whole = F.regexp_replace(text, ",", "")
    if percent:
        whole = F.when(text.rlike(r"^-?\d+,\d{1,2}$"), F.regexp_replace(text, ",", ".")).otherwise(whole)
    unit = F.lower(F.right(whole, F.lit(1)))
    number = plain_double(F.when(unit.isin("k", "m"), F.substr(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole))
    number = number * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)
    return F.when(had, number / 100).otherwise(number) if percent else number


def parse_metric(x: Column) -> Column:
    """A performance number: only the k suffix; a percent sign is dropped without dividing."""
    text = F.regexp_replace(stripped(x), ",", "")
    text = F.when(~text.isin("", "-", *ERROR_LITERALS), text)
    k = F.lower(text).endswith("k")
    return plain_double(F.regexp_replace(F.when(k, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text), "%", "")) * F.when(k, 1e3).otherwise(1.0)


def parse_fee(x: Column) -> Column:
    """struct(model, amount, unit): missing, pending, barter, free, hourly, fixed or unknown, tested in this order."""
    text = stripped(F.coalesce(x, F.lit("")))
    lower = F.lower(text)
    hourly = F.regexp_extract(lower, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*/\s*(?:hr|hour)", 1)
    number = parse_number(x)
    fee = lambda model, amount, unit: F.struct(F.lit(model).alias("model"), amount.cast("double").alias("amount"), F.lit(unit).alias("unit"))
    none = F.lit(None)
    return (
        F.when(text.isin("", "-"), fee("missing", none, ""))
        .when(F.contains(text, F.lit(PENDING_WORDS[0])) | F.contains(lower, F.lit(PENDING_WORDS[1])), fee("pending", none, ""))
        .when(F.contains(lower, F.lit("barter")), fee("barter", F.lit(0.0), "campaign"))
        .when(F.contains(lower, F.lit("free")), fee("free", F.lit(0.0), "campaign"))
        .when(hourly != "", fee("hourly", parse_float(hourly), "hour"))
        .when(number.isNotNull(), fee("fixed", number, "campaign"))
        .otherwise(fee("unknown", none, ""))
    )


def first_number(x: Column) -> Column:
    """The first number of 1,000 or more, else the first number."""
    found = F.regexp_extract_all(F.regexp_replace(x, ",", ""), F.lit(r"(?<![\w.])(\d+(?:\.\d+)?)"), F.lit(1))
    numbers = F.transform(found, lambda n: n.try_cast("double"))
    return F.coalesce(F.try_element_at(F.filter(numbers, lambda n: n >= 1000), F.lit(1)), F.try_element_at(numbers, F.lit(1)))


def truth(x: Column, true: list[str], false: list[str]) -> Column:
    """Three-valued: null where neither vocabulary has the normalised text."""
    text = normalized(x)
    return F.when(text.isin(*true), True).when(text.isin(*false), False)


def source_truth(x: Column) -> Column:
    return truth(x, SOURCE_TRUE, SOURCE_FALSE)


def known_truth(x: Column) -> Column:
    return truth(x, KNOWN_TRUE, KNOWN_FALSE)


def warehouse_truth(x: Column) -> Column:
    return truth(x, WAREHOUSE_TRUE, WAREHOUSE_FALSE)


def two_state_truth(x: Column) -> Column:
    """False where the text isn't a word for true."""
    return F.coalesce(source_truth(x), F.lit(False))


def excel_date(x: Column) -> Column:
    """ISO text of a day number from 40000 to 60000; error literals are empty; other text is itself."""
    text = stripped(F.coalesce(x, F.lit("")))
    number = plain_double(text)
    day = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int")), "yyyy-MM-dd")
    return F.when(number.between(40000, 60000), day).when(text.isin(*ERROR_LITERALS), "").otherwise(text)


def strict_date(x: Column) -> Column:
    """A date only from YYYY-MM-DD."""
    text = stripped(x)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def lenient_date(x: Column) -> Column:
    """A date from YYYY-MM-DD; month and day may have one digit."""
    text = stripped(x)
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def try_numeric(x: Column, kind: str = "decimal(20,4)") -> Column:
    text = stripped(x)
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast(kind))


def try_integer(x: Column) -> Column:
    text = stripped(x)
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
