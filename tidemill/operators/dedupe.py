"""One row of each key, by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_of_each(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The last row of each key; order is ascending."""
    return first_of_each(df, keys, [c.desc() for c in order])


def extra_occurrences(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every row but the first of a trimmed key."""
    w = Window.partitionBy(*[F.trim(F.col(k).cast("string")) for k in keys]).orderBy(*order)
    return df.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


def ordered_list(value: Column, order: Column) -> Column:
    """Values of a group in an order, duplicates kept."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])


def sorted_distinct_text(value: Column, separator: str) -> Column:
    return F.array_join(F.sort_array(F.collect_set(value)), separator)


def step_order(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """df with step_order, from 1 in each group."""
    return df.withColumn("step_order", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
