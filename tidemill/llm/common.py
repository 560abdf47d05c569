"""What the operators share: tables, staged tables, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemill

#: Functions of this package travel to the executors with the queries; nothing has to be installed there.
cloudpickle.register_pickle_by_value(tidemill)

#: Arrow batches hold at most this many bytes, so that a worker's memory doesn't follow the rows' width.
BATCH_BYTES = "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; rows of long texts then travel a few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives the memory it no longer needs back to the system at the end of a task: Python workers wait for the next one."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only where the session names none (as in tests) a temporary folder is set.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def shared_value(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast of value, which may hold this package's classes; a task calls the result once."""
    blob = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(blob.value)  # noqa: S301


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


#: For each open `temporary` block, the innermost last, the paths of the tables staged in it.
_open: list[list[str]] = []


def staged(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: lost executors cost no recomputation beyond this table, and what is
    read twice is computed once. The table is deleted at the end of the innermost `temporary`
    block, or of the one around it if it is to be kept; without such a block when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    owners = _open[:-1] if keep else _open
    if owners:
        owners[-1].append(path)
    else:
        atexit.register(_delete, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables staged in the block are deleted at its end, unless they are kept; so a result may only read kept ones.

    A result thus owns what it reads: frames may be chained and run later, and other queries delete nothing of theirs.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, path)


#: A key is hot if it holds at least one in so many of all rows; there can't be more hot keys than this.
HOT = 256


def lookup(rows: DataFrame, unique: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows with the columns of unique, which has a row a key and in `weight` how many of the `total` rows have it.

    Rows with a hot key find it in a broadcast of at most HOT keys and are dealt out by their own hash, so that no
    key's rows meet in one task; the others are joined by key. Rows whose key isn't in unique get nulls.
    """
    hot_key, hot, salt, rest_key, rest, rest_salt = free_names([*rows.columns, *unique.columns], "hot_key", "hot", "salt", "rest_key", "rest", "rest_salt")
    values, is_hot = F.struct(*[c for c in unique.columns if c != key]), F.col(weight) * HOT >= max(total, 1)
    few = unique.where(is_hot).select(F.col(key).alias(hot_key), values.alias(hot))
    many = unique.where(~is_hot).select(F.col(key).alias(rest_key), F.lit(0).alias(rest_salt), values.alias(rest))
    own = F.when(F.col(hot).isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 16)).cast("int") + 1)
    marked = rows.join(F.broadcast(few), F.col(key) == F.col(hot_key), "left").withColumn(salt, own)
    joined = marked.join(many, (F.col(key) == F.col(rest_key)) & (F.col(salt) == F.col(rest_salt)), "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(hot)[c], F.col(rest)[c]).alias(c) for c in unique.columns if c != key])


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores before it until none of the columns is called so."""
    taken, found = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found
