"""Checks as rows: metrics with a status, code counts, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import split_list


def code_frequency(df: DataFrame, codes: Column) -> DataFrame:
    """(code, n) of semicolon-joined codes; blanks are dropped."""
    return df.select(F.explode(F.filter(F.transform(F.split(F.coalesce(codes, F.lit("")), ";"), F.trim), lambda c: c != "")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def check_rows(measured: DataFrame, checks: list[tuple[str, str]]) -> DataFrame:
    """(check_name, observed, expected, status) from a row with a column for each check, all of which must be 0."""
    stack = ", ".join(f"'{name}', cast({column} as bigint)" for name, column in checks)
    return measured.select(F.expr(f"stack({len(checks)}, {stack}) as (check_name, observed)")).select(
        "check_name", "observed", F.lit(0).cast("long").alias("expected"), F.when(F.col("observed") == 0, "PASS").otherwise("FAIL").alias("status")
    )


def reconciliation(metrics: DataFrame, fail: Column, warn: Column | None = None) -> DataFrame:
    """metrics with status: FAIL, WARN or PASS, computed for every row."""
    status = F.when(fail, "FAIL")
    if warn is not None:
        status = status.when(warn, "WARN")
    return metrics.withColumn("status", status.otherwise("PASS"))


def gate(checked: DataFrame) -> tuple[bool, int]:
    """(no row failed, rows)."""
    row = checked.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "FAIL").alias("bad")).first()
    return row["bad"] == 0, row["n"]


def count_reconciliation(staged: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """(table_name, observed, expected, status) of staged tables."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("observed"), F.lit(expected.get(name, 0)).cast("long").alias("expected")) for name, df in staged.items()]
    found = reduce(DataFrame.unionByName, counts)
    return reconciliation(found, F.col("observed") != F.col("expected"))


def distinct_codes(codes: Column) -> Column:
    return F.array_join(F.array_sort(split_list(codes)), ";")
