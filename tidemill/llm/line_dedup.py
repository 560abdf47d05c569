"""Fuzzy line dedup by MinHash: one line of each component of similar lines stays, the first.

A line's set holds the hashes of its 8-character shingles, after lower-casing and with white
space runs as one space. One hash a shingle is dealt into bins, each bin keeps its minimum, and
empty bins borrow from the next full one. Bands of four bins are the keys of candidate pairs:
12 bands find a pair of Jaccard 0.8 with probability 0.998, and one of 0.9 practically always.
Candidates are verified exactly (5 * intersection >= 4 * union) and joined by distributed
union-find; of every component the line with the smallest (doc_id, line number) stays.

Cases: lines are what stands between `\\n`; a line without a word stays and is in no class; a
line shorter than a shingle is a set of its own text; equal lines are one item from the start,
however many there are; a null text has no lines; rows that repeat a document's id and text are
one document; rows without an id count as id null, which comes first; other columns are ignored
or pass through; an empty table gives an empty result. Lines are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import bounded_batches, free_names, lookup, staged, temporary, tidy
from tidemill.llm.linking import buckets, components, link_by_sets, with_ids
from tidemill.llm.ngram_join import mixed

SHINGLE_CHARS, BANDS, BAND_BINS = 8, 12, 4
NUMERATOR, DENOMINATOR = 4, 5
BINS = BANDS * BAND_BINS
#: Characters shingled at a time.
STEP_CHARS = 1 << 18
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))
NONE = np.uint32(0xFFFFFFFF)


def normal_line(line: str) -> str:
    return " ".join(line.lower().split())


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


def rolling(codes: np.ndarray) -> np.ndarray:
    """Hash of the 8 characters from each place on, by doubling; the last 7 places are left out."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * ODD[0]
    for step, odd in ((1, ODD[1]), (2, ODD[2]), (4, ODD[3])):
        h = (h[:-step] * odd) ^ ((h[step:] >> np.uint64(17)) + h[step:])
        h *= ODD[0]
    return mixed(h)


def padded(lines: list[str]) -> list[str]:
    return [x if len(x) >= SHINGLE_CHARS else x + "\0" * (SHINGLE_CHARS - len(x)) for x in lines]


def steps(lines: list[str]) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of lines of about STEP_CHARS characters."""
    start = 0
    while start < len(lines):
        end, total = start, 0
        while end < len(lines) and (end == start or total + len(lines[end]) + SHINGLE_CHARS < STEP_CHARS):
            total += max(len(lines[end]), SHINGLE_CHARS)
            end += 1
        yield start, end
        start = end


def char_shingles(lines: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each normalised line."""
    out = []
    for start, end in steps(lines):
        part = padded(lines[start:end])
        h = rolling(np.frombuffer("".join(part).encode("utf-32-le"), np.uint32))
        at = 0
        for line in part:
            own = np.sort(h[at : at + len(line) - SHINGLE_CHARS + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            at += len(line)
    return out


def signatures(lines: list[str]) -> np.ndarray:
    """Minima by bin, one row a line."""
    found = np.full((len(lines), BINS), NONE, np.uint32)
    flat = found.ravel()
    for start, end in steps(lines):
        part = padded(lines[start:end])
        codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(sizes)
        h = rolling(codes)
        whole = np.ones(len(h), bool)
        for k in range(1, SHINGLE_CHARS):
            whole[ends[:-1] - k] = False
        row = np.repeat(np.arange(start, end), sizes)[: len(h)][whole]
        h = h[whole]
        bins = ((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
        np.minimum.at(flat, row * BINS + bins.astype(np.int64), np.minimum(h.astype(np.uint32), NONE - np.uint32(1)))
    empty = found == NONE
    rows = np.flatnonzero(empty.any(axis=1))
    part, gap = found[rows], empty[rows]
    for _ in range(BINS):
        if not gap.any():
            break
        shifted = np.roll(part, -1, axis=1)
        fill = gap & (shifted != NONE)
        part[fill] = (shifted[fill] * np.uint32(0x85EBCA6B) + np.uint32(0x165667B1)) & np.uint32(0x7FFFFFFF)
        gap = part == NONE
    found[rows] = part
    return found


def band_keys(minima: np.ndarray) -> np.ndarray:
    """Keys of signatures, one row a line and one column a band."""
    rows = minima.astype(np.uint64).reshape(len(minima), BANDS, BAND_BINS)
    total = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * ODD[0], rows.shape[:2])
    for k in range(BAND_BINS):
        total = mixed(total + rows[:, :, k] * ODD[k])
    return total.view(np.int64)


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, lines, new, keys): ids of a document's lines (null without a word); of those new in its task the keys."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            lines, hashes, fresh, owners = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                own = []
                text = text.as_py()
                for line in (text or "").split("\n"):
                    plain = normal_line(line)
                    own.append(line_id(plain) if plain else None)
                    if plain and own[-1] not in seen:
                        seen.add(own[-1])
                        fresh.append(plain)
                        owners.append((i, own[-1]))
                lines.append(own if text is not None else [])
                hashes.append(xxhash.xxh3_64_intdigest((text or "").encode()) - (1 << 63))
            new = [[] for _ in lines]
            keys = [[] for _ in lines]
            for (i, line), row in zip(owners, band_keys(signatures(fresh)), strict=True):
                new[i].append(line)
                keys[i].append(row)
            keys = [np.concatenate(k) if k else np.zeros(0, np.int64) for k in keys]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hashes, pa.int64()), pa.array(lines, longs), pa.array(new, longs), pa.array(keys, longs)], names=["doc_id", "text_hash", "lines", "new", "keys"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(tidy(run), "doc_id long, text_hash long, lines array<long>, new array<long>, keys array<long>"
    )


def keyed_lines(table: DataFrame) -> DataFrame:
    """(key, id) of table's new lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.repeat(batch.column(0).flatten().to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(1).flatten(), pa.array(ids)], names=["key", "id"])

    return table.select("new", "keys").mapInArrow(tidy(run), "key long, id long")


def line_texts(docs: DataFrame) -> DataFrame:
    """(id, blob) of every line of docs(text) that is new in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, blobs = [], []
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if (plain := normal_line(line)) and (i := line_id(plain)) not in seen:
                        seen.add(i)
                        ids.append(i)
                        blobs.append(plain.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "blob"])

    return docs.select("text").mapInArrow(tidy(run), "id long, blob binary")


def judge_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(table, lines): the line ids of every row, and (doc_id, text_hash, line, class_id, kept) of every line with a word."""
    table = staged(line_table(docs, id_col, text_col))
    members = staged(buckets(keyed_lines(table)))
    source = docs.select(F.col(text_col).alias("text"))
    texts = with_ids(line_texts(source), staged(members.select("id").distinct())).dropDuplicates(["id"])
    roots = components(link_by_sets(members, texts, lambda blobs: char_shingles([b.decode() for b in blobs]), NUMERATOR, DENOMINATOR))
    own = table.select("doc_id", "text_hash", F.posexplode("lines").alias("line", "id")).where("id is not null")
    placed = own.join(roots, "id", "left").select("doc_id", "text_hash", "line", F.coalesce("root", "id").alias("class_id"))
    place = F.struct("doc_id", "line", "text_hash")
    placed = staged(placed)
    first = staged(placed.groupBy("class_id").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    kept = lookup(placed, first, "class_id", "n", placed.count()).withColumn("kept", F.coalesce(place.eqNullSafe(F.col("first")) | F.col("first").isNull(), F.lit(True)))
    return table, kept.select("doc_id", "text_hash", "line", "class_id", "kept")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, removed, classes): a row a document; removed has line numbers from 0, classes the class of each line with a word."""
    with temporary(docs.sparkSession):
        return staged(_judged_documents(*judge_lines(docs, id_col, text_col)), keep=True)


def _judged_documents(table: DataFrame, lines: DataFrame) -> DataFrame:
    found = lines.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("line", "class_id", "kept"))).alias("x"))
    found = found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "x")
    rows = table.select("doc_id", "text_hash").join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    gone = F.transform(F.filter("x", lambda s: ~s["kept"]), lambda s: s["line"])
    return rows.select(
        "doc_id",
        F.when(F.col("x").isNull(), 0).otherwise(F.size("x")).cast("long").alias("n_lines"),
        F.when(F.col("x").isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
        F.coalesce(gone, F.array().cast("array<int>")).alias("removed"),
        F.coalesce(F.transform("x", lambda s: s["class_id"]), F.array().cast("array<long>")).alias("classes"),
    )


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines that repeat an earlier one; a document that loses every line with a word goes."""
    own, own_hash, cut, left, hash_ = free_names(docs.columns, "own", "own_hash", "cut", "left_lines", "hash")
    with temporary(docs.sparkSession):
        _, lines = judge_lines(docs, id_col, text_col)
        gone = lines.groupBy("doc_id", "text_hash").agg(F.collect_set(F.when(~F.col("kept"), F.col("line"))).alias(cut), F.count_if("kept").alias(left)).where(F.size(cut) > 0)
        gone = staged(gone.select(F.col("doc_id").alias(own), F.col("text_hash").alias(own_hash), cut, left), keep=True)
    bounded_batches(docs.sparkSession)
    text = docs.schema[text_col].name

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            hashes = [xxhash.xxh3_64_intdigest((t.as_py() or "").encode()) - (1 << 63) for t in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.int64())], names=[*batch.schema.names, hash_])

    schema = T.StructType([*docs.schema, T.StructField(hash_, T.LongType())])
    rows = docs.mapInArrow(tidy(hashed), schema)
    joined = rows.join(gone, rows[id_col].cast("long").eqNullSafe(gone[own]) & (rows[hash_] == gone[own_hash]), "left").where(F.col(left).isNull() | (F.col(left) > 0))
    split = F.split(F.col(text_col), "\n", -1)
    rest = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(cut, i)), "\n")
    return joined.withColumn(text_col, F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(rest)).select(*[F.col(f"`{c}`") for c in docs.columns])
