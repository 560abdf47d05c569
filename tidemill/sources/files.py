"""Files: discovery, text tables, sinks with an explicit policy for empty tables."""

from __future__ import annotations

import json
import os
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.pii import check_columns


def discover(spark: SparkSession, folder: str, pattern: str = "*.xlsx") -> DataFrame:
    """(name, path, size, modified, content_hash) of the files of a folder, in case-insensitive order of names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("content_hash")).orderBy(F.lower("name"))


def discovery_failures(found: DataFrame, expected: int | None = None) -> list[str]:
    """Why a discovery can't go on: equal files, or another number of them than expected."""
    groups = found.groupBy("content_hash").count().where("count > 1").count()
    n = found.count()
    return ([f"{groups} groups of equal files"] if groups else []) + ([f"{n} files, {expected} expected"] if expected is not None and n != expected else [])


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, every column as text; empty stays empty, and a byte-order mark is dropped."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="\x01", emptyValue="")


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a CSV; 0 where there is no file."""
    return read_text_table(spark, path).count() if Path(path).exists() else 0


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames with the columns of all, in the order they are first seen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_table(df: DataFrame, path: str, when_empty: str = "write", columns: list[str] | None = None, format: str = "parquet") -> None:
    """Write a table after checking its columns for personal data; an empty one is written, skipped or an error."""
    out = df if columns is None else df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    check_columns(out.columns)
    if when_empty != "write" and out.isEmpty():
        if when_empty == "raise":
            raise ValueError(f"no rows for {path}")
        return
    writer = out.write.mode("overwrite")
    if format == "csv":
        writer.csv(path, header=True, emptyValue="", nullValue="")
    else:
        writer.format(format).save(path)


def export_csv(df: DataFrame, path: str) -> int:
    """A small table as one CSV file with a byte-order mark, put in place at once; its rows come one at a time."""
    import csv

    check_columns(df.columns)
    target, n = Path(path), 0
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".tmp")
    with part.open("w", encoding="utf-8-sig", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if x is None else x for x in row])
            n += 1
    os.replace(part, target)
    return n


def write_json(path: str | Path, document: object) -> None:
    """Put a JSON document in place at once."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".tmp")
    part.write_text(json.dumps(document, ensure_ascii=False, indent=2, default=str))
    os.replace(part, target)


def rename_path(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder on the file system that holds it."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{source} can't be moved to {target}")
