"""An extension: events as a stream, deduplicated within a watermark, counted in windows, upserted by batch."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import query


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the event files of a folder, or of one file; event times get the zone that a watermark needs."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    found = reader.option("pathGlobFilter", name).parquet(folder) if path.endswith(".parquet") else reader.parquet(path)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, lateness: str = "2 days", window: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; repeated ids count once while the watermark hasn't passed them."""
    once = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def upsert_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Start a query that hands each batch to `apply`."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


@query("streaming_ext")
def streaming_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed over the events at hand."""
    name = f"windows_{uuid.uuid4().hex[:8]}"
    base = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoints-")
    counted = windowed_counts(event_stream(spark, f"{sf_dir}/events.parquet"))
    flat = counted.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
    flat.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{base}/{name}").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
