"""The governed tables: keys, references, required columns, and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.dedupe import extra_occurrences
from tidemill.operators.upsert import not_blank


@dataclass(frozen=True)
class TableContract:
    """references: (columns, parent table, parent columns); date_columns keep a raw twin; kept isn't overwritten on conflict."""

    name: str
    primary_key: tuple[str, ...]
    required: tuple[str, ...]
    references: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    date_columns: tuple[str, ...] = ()
    decimals: dict[str, str] = field(default_factory=dict)
    integers: tuple[str, ...] = ()
    booleans: tuple[str, ...] = ()
    renamed: dict[str, str] = field(default_factory=dict)
    conflict_key: tuple[str, ...] | None = None


_campaign = (("campaign_id",), "dim_campaign", ("campaign_id",))
_influencer = (("influencer_id",), "dim_influencer", ("influencer_id",))
_MONEY, _METRIC, _RATE = "decimal(18,2)", "decimal(20,4)", "decimal(18,8)"
CONTRACTS: dict[str, TableContract] = {
    c.name: c
    for c in [
        TableContract("dim_influencer", ("influencer_id",), ("influencer_id", "platform", "canonical_handle"), integers=("observation_count", "workbook_count", "sheet_count")),
        TableContract("influencer_identity_alias", ("source_row_hash", "alias_type", "alias_value"), ("influencer_id", "alias_type", "alias_value"), (_influencer,)),
        TableContract("dim_brand", ("brand_id",), ("brand_id", "canonical_brand_name"), renamed={"canonical_brand_name": "brand_name"}),
        TableContract("dim_campaign", ("campaign_id",), ("campaign_id", "brand_id"), ((("brand_id",), "dim_brand", ("brand_id",)),), renamed={"campaign_display_name": "campaign_name"}),
        TableContract("campaign_requirement", ("campaign_id",), ("campaign_id", "requirement_status"), (_campaign,), integers=("target_age_min", "target_age_max")),
        TableContract(
            "fact_campaign_influencer", ("campaign_influencer_id",), ("campaign_influencer_id", "campaign_id", "influencer_id"), (_campaign, _influencer),
            decimals={"fee_min": _MONEY, "fee_max": _MONEY, "follower_snapshot_min": _MONEY, "follower_snapshot_max": _MONEY, "engagement_snapshot_min": _RATE, "engagement_snapshot_max": _RATE},
            integers=("observation_count",), conflict_key=("campaign_id", "influencer_id"),
        ),
        TableContract("fact_campaign_deliverable", ("deliverable_id",), ("deliverable_id", "campaign_id", "influencer_id"), (_campaign, _influencer), ("posted_date", "schedule_date"), booleans=("posted_raw", "confirmed_raw"), renamed={"posted_raw": "posted", "confirmed_raw": "confirmed"}),
        TableContract(
            "fact_influencer_performance", ("performance_id",), ("performance_id", "campaign_id", "influencer_id"),
            (_campaign, _influencer, (("deliverable_id",), "fact_campaign_deliverable", ("deliverable_id",))), ("event_date",),
            decimals={m: _METRIC for m in ("views", "likes", "comments", "saves", "shares", "gmv", "sales_amount", "orders")},
        ),
        TableContract("fact_campaign_performance", ("campaign_performance_id",), ("campaign_performance_id", "campaign_id"), (_campaign,), ("event_date",), decimals={m: _METRIC for m in ("revenue", "orders", "traffic", "viewers", "cost")}),
    ]
}


def missing_columns(df: DataFrame, contract: TableContract) -> list[str]:
    return sorted(set(contract.required) - set(df.columns))


def blank_keys(df: DataFrame, contract: TableContract) -> DataFrame:
    return df.where(~not_blank(list(contract.primary_key)))


def duplicate_keys(df: DataFrame, contract: TableContract) -> DataFrame:
    order = [F.col(c).cast("string") for c in df.columns if c not in contract.primary_key] or [F.lit(0)]
    return extra_occurrences(df, list(contract.primary_key), order)


def orphans(child: DataFrame, columns: tuple[str, ...], parent: DataFrame, parent_columns: tuple[str, ...]) -> DataFrame:
    """Rows of child whose reference isn't in parent; rows with an all-blank reference are skipped."""
    any_text = F.exists(F.array(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns]), lambda k: k != "")
    keys = parent.select(*[F.col(p).alias(f"__{c}") for c, p in zip(columns, parent_columns, strict=True)]).distinct()
    return child.where(any_text).join(keys, [F.col(c) == F.col(f"__{c}") for c in columns], "left_anti")


def reference_violations(tables: dict[str, DataFrame], contracts: dict[str, TableContract] = CONTRACTS) -> DataFrame:
    """(table_name, reference, violations) of every reference of the given tables."""
    found = []
    for name, contract in contracts.items():
        for columns, parent, parent_columns in contract.references:
            if name in tables and parent in tables and set(columns) <= set(tables[name].columns):
                bad = orphans(tables[name], columns, tables[parent], parent_columns)
                found.append(bad.agg(F.lit(name).alias("table_name"), F.lit(",".join(columns)).alias("reference"), F.count("*").alias("violations")))
    return reduce(DataFrame.unionByName, found)


def preflight(tables: dict[str, DataFrame], contracts: dict[str, TableContract] = CONTRACTS) -> DataFrame:
    """(table_name, missing_columns, row_count, blank_keys, duplicate_keys) of the given tables."""
    found = []
    for name, df in tables.items():
        contract = contracts[name]
        missing = missing_columns(df, contract)
        keyed = set(contract.primary_key) <= set(df.columns)
        blank = blank_keys(df, contract).count() if keyed else 0
        duplicate = duplicate_keys(df, contract).count() if keyed else 0
        found.append((name, ",".join(missing), df.count(), blank, duplicate))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(found, "table_name string, missing_columns string, row_count long, blank_keys long, duplicate_keys long")
