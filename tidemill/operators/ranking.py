"""Ranks and shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_rank(value: Column, partition: list | None = None) -> Column:
    """0 to 100 among non-null values; ties get their average rank, a single value 100.

    Without a partition all rows meet in one task; use `with_percentile_rank` for whole tables.
    """
    part = Window.partitionBy(*(partition or []), value.isNull())
    rank = F.rank().over(part.orderBy(value)).cast("double")
    same = F.count("*").over(Window.partitionBy(*(partition or []), value.isNull(), value)).cast("double")
    n = F.count("*").over(part).cast("double")
    average = rank + (same - 1) / 2
    return F.when(value.isNotNull(), F.when(n == 1, 100.0).otherwise((average - 1) * 100.0 / (n - 1)))


def with_percentile_rank(df: DataFrame, value: str, output: str, partition: list[str] | None = None) -> DataFrame:
    """df with `output`, the percentile rank of `value`, from the counts of its distinct values.

    Only distinct values are ordered, by ranges: their running counts are taken within each range,
    and the ranges' totals (one row each) are added.
    """
    keys = partition or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__same"))
    if keys:
        w = Window.partitionBy(*keys).orderBy(value)
        placed = counted.withColumn("__upto", F.sum("__same").over(w)).withColumn("__n", F.sum("__same").over(Window.partitionBy(*keys)))
    else:
        ranged = counted.repartitionByRange(value).withColumn("__part", F.spark_partition_id())
        totals = ranged.groupBy("__part").agg(F.sum("__same").alias("__total"))
        before = totals.select(
            "__part",
            F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
            F.sum("__total").over(Window.partitionBy(F.lit(1))).alias("__n"),
        )
        inner = F.sum("__same").over(Window.partitionBy("__part").orderBy(value))
        placed = ranged.withColumn("__in", inner).join(before, "__part").withColumn("__upto", F.col("__before") + F.col("__in"))
    average = F.col("__upto").cast("double") - (F.col("__same") - 1) / F.lit(2.0)
    rank = F.when(F.col("__n") == 1, 100.0).otherwise((average - 1) * 100.0 / (F.col("__n") - 1))
    # rows without a value find none, and are dealt out by their hash
    spread = F.when(F.col(value).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(1 << 16)) + 1).otherwise(F.lit(0).cast("long"))
    found = placed.select(*keys, value, F.lit(0).cast("long").alias("__spread"), rank.alias(output))
    return df.withColumn("__spread", spread).join(found, [*keys, value, "__spread"], "left").drop("__spread")


def ranked(df: DataFrame, eligible: Column, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """df with rank among eligible rows, null for the others; over the whole table by ranges, without a single task."""
    if not partition:
        marked = df.withColumn("__eligible", F.coalesce(eligible, F.lit(False)))
        numbered = with_row_number(marked, [F.desc("__eligible"), *order], "rank")
        return numbered.withColumn("rank", F.when(F.col("__eligible"), F.col("rank").cast("int"))).drop("__eligible")
    keys = partition
    w = Window.partitionBy(*keys, F.col("__eligible")).orderBy(*order)
    return df.withColumn("__eligible", eligible).withColumn("rank", F.when(F.col("__eligible"), F.row_number().over(w))).drop("__eligible")


def top_n(df: DataFrame, eligible: Column, order: list[Column], n: int, partition: list[str] | None = None) -> DataFrame:
    """The first n eligible rows of each partition, with rank; the window is limited before the shuffle."""
    w = Window.partitionBy(*(partition or [])).orderBy(*order)
    return df.where(eligible).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def with_row_number(df: DataFrame, order: list[Column], output: str) -> DataFrame:
    """df with `output`, the number of each row from 1 by an order without ties, over all rows and without a bound.

    Rows are ordered by ranges and numbered within each, and the ranges' totals (one row each) are
    added. The ranges are drawn from a sample, so they are kept: rows and totals must see the same ones.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).persist()
    totals = ranged.groupBy("__part").agg(F.count("*").alias("__total"))
    before = totals.select("__part", F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__in", inner).join(before, "__part").withColumn(output, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def review_priority(rank: Column, primary_limit: int) -> Column:
    return F.when(rank <= primary_limit, "primary_review").otherwise("backup_review")
