"""Time the headline queries once each; print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidemill import catalog, plans

HEADLINE = [
    "mart_influencer", "mart_campaign", "fact_campaign_influencer", "campaign_summary", "historical_features", "match_v1_rank", "match_v2_replay", "percentile_rank_avg", "deliverable_collapse", "audience_profile", "tag_experience",
    "identity_cluster", "golden_master", "upsert", "duplicate_pk", "fk_violations", "dq_vector_unpivot", "temporal_slo", "late_arrivals", "safe_backfill", "nearest_label_window", "section_segmentation", "pii_scan",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    plans.register_all()
    catalog.QUERIES["tri_state_bool"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's code
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
