"""Upserts by business key, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.dedupe import last_of_each


def not_blank(keys: list[str]) -> Column:
    """All parts of the key hold text."""
    return F.forall(F.array(*[F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) for k in keys]), lambda k: k != "")


def _same(left: str, right: str, columns: list[str]) -> Column:
    pack = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in columns])
    return pack(left).eqNullSafe(pack(right))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None, kept: str | None = None) -> DataFrame:
    """existing with incoming's rows put in; action is inserted, updated or unchanged.

    Rows with a blank key are skipped; of several incoming rows of a key the last by `order` counts;
    the column `kept` (as loaded_at) keeps its existing value on a conflict.
    """
    columns = existing.columns
    new = incoming.where(not_blank(keys)).select(*columns, *([] if order is None else [c.alias(f"__o{i}") for i, c in enumerate(order)]))
    new = last_of_each(new, keys, [F.col(f"__o{i}") for i in range(len(order))]).select(*columns) if order else new.dropDuplicates(keys)
    data = [c for c in columns if c not in keys and c != kept]
    condition = [F.col(f"e.{k}") == F.col(f"i.{k}") for k in keys]
    e = existing.withColumn("__e", F.lit(True)).alias("e")
    i = new.withColumn("__i", F.lit(True)).alias("i")
    joined = e.join(i, condition, "full_outer")
    has_e, has_i = F.col("e.__e").isNotNull(), F.col("i.__i").isNotNull()
    action = F.when(has_e & has_i, F.when(_same("e", "i", data), "unchanged").otherwise("updated")).when(has_i, "inserted").otherwise("unchanged")
    value = lambda c: (F.when(has_e, F.col(f"e.{c}")) if c == kept else F.when(has_i, F.col(f"i.{c}"))).otherwise(F.coalesce(F.col(f"e.{c}"), F.col(f"i.{c}"))).alias(c)
    return joined.select(*[value(c) for c in columns], action.alias("action"))


def upsert_counts(result: DataFrame) -> DataFrame:
    return result.agg(F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "updated").alias("updated"), F.count("*").alias("row_count"))


def rerun_effect(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """(first_count, second_count, changed): rows by key after one run, after a second one, and rows that a later one replaced."""
    valid = rows.where(not_blank(keys))
    survivors = last_of_each(valid, keys, order)
    again = upsert(survivors, survivors, keys)
    return (
        survivors.agg(F.count("*").alias("first_count"))
        .crossJoin(again.agg(F.count("*").alias("second_count"), F.count_if(F.col("action") != "unchanged").alias("changed_on_rerun")))
        .crossJoin(valid.agg(F.count("*").alias("incoming_count")))
    )
