"""Minimax contiguous partition of documents into shards [native].

Atoms are groups of equal texts, in the order of a 60-bit prefix of the text's SHA-256. The
driver looks for the smallest capacity with which a greedy scan fills at most n shards. It sees
only sums: first of 65,536 ranges of the order, then, only where a cut may fall, of 256 parts of
a range, and so on down to single atoms. Ranges give an upper bound of the capacity when they are
taken as indivisible, and a lower bound when those of several atoms are taken as divisible at
will. Once both agree, the capacity is exact. What the driver collects depends on the number of
shards and not on the number of documents.

Cases: a null text counts as an empty one (size 16, CRC 0); equal texts (ties, repeated rows)
share a shard; an empty table gives an empty result; with fewer atoms than shards some shards
stay empty; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import staged, temporary

ORDER_BITS, FIRST_BITS, STEP_BITS = 60, 16, 8
#: A row's overhead in bytes, added to its text's.
ROW_BYTES = 16
#: Cells of a shard, among which its rows are numbered separately.
CELLS = 512


def order_key(text: F.Column) -> F.Column:
    """The first 60 bits of the SHA-256 of the text."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, ORDER_BITS // 4), 16, 10).cast("long")


class Ranges:
    """Ranges of the order: first key, bits left, bytes and atoms of each, sorted by first key."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        rows = sorted(rows)
        self.rows = rows
        self.ends = np.cumsum(np.array([r[2] for r in rows], dtype=np.int64)) if rows else np.zeros(0, np.int64)
        self.single = np.array([r[3] == 1 for r in rows], dtype=bool)
        self.total = int(self.ends[-1]) if rows else 0

    def fill(self, start: int, capacity: int, divisible: bool) -> int:
        """Where a shard that begins at byte `start` has to end."""
        target = start + capacity
        if target >= self.total:
            return self.total
        k = int(np.searchsorted(self.ends, target, side="right"))
        begin = int(self.ends[k - 1]) if k else 0
        return target if divisible and not self.single[k] else max(begin, start)

    def cuts(self, n: int, capacity: int, divisible: bool) -> list[int]:
        """Ends of n greedy shards; the last is the total if the capacity is feasible."""
        ends, at = [], 0
        for _ in range(n):
            at = self.fill(at, capacity, divisible)
            ends.append(at)
        return ends

    def least(self, n: int, divisible: bool) -> int:
        """The smallest feasible capacity, by binary search with greedy checks."""
        low, high = -(-self.total // n), self.total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(n, middle, divisible)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def at_cuts(self, n: int, low: int, high: int) -> list[int]:
        """Ranges of several atoms in which a greedy cut with a capacity from low to high may fall."""
        found = np.zeros(len(self.rows), dtype=bool)
        for a, b in zip(self.cuts(n, low, False), self.cuts(n, high, True), strict=True):
            first = int(np.searchsorted(self.ends, a, side="right"))
            last = int(np.searchsorted(self.ends, b, side="left"))
            found[first : last + 1] = True
        return [int(k) for k in np.flatnonzero(found & ~self.single)]

    def starts(self, n: int, capacity: int) -> list[int]:
        """First keys of shards 1 to n-1: within the capacity, each cut as near to an even share as it can be."""
        latest, at = [], self.total
        for _ in range(n - 1):  # the furthest back that the later shards can begin
            k = int(np.searchsorted(self.ends, at - capacity, side="left"))
            at = 0 if at <= capacity else int(self.ends[k])
            latest.append(at)
        latest.reverse()
        keys, at = [], 0
        for j in range(n - 1):
            ideal = at + (self.total - at) / (n - j)
            k = int(np.searchsorted(self.ends, ideal, side="left"))
            near = [at, latest[j]] + [int(self.ends[i]) for i in (k - 1, k) if 0 <= i < len(self.ends)]
            at = min((x for x in near if max(at, latest[j]) <= x <= at + capacity), key=lambda x: abs(x - ideal))
            k = int(np.searchsorted(self.ends, at, side="right"))
            keys.append(self.rows[k][0] if k < len(self.rows) else 1 << ORDER_BITS)
        return keys


def _sums(atoms: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
    part = F.shiftright("ord", bits)
    rows = atoms.groupBy(part.alias("part")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    return [(r["part"] << bits, bits, r["b"], r["n"]) for r in rows]


def shard_starts(atoms: DataFrame, n_shards: int) -> tuple[list[int], int]:
    """(first keys of shards 1 to n-1, capacity) for atoms(ord, bytes), one row an atom."""
    ranges = Ranges(_sums(atoms, ORDER_BITS - FIRST_BITS))
    while True:
        high = ranges.least(n_shards, False)
        low = ranges.least(n_shards, True)
        if low >= high or not (split := ranges.at_cuts(n_shards, low, high)):
            return ranges.starts(n_shards, high), high
        rows, gone = [], set(split)
        for bits in sorted({ranges.rows[k][1] for k in split}):
            prefixes = [ranges.rows[k][0] >> bits for k in split if ranges.rows[k][1] == bits]
            inside = atoms.where(F.shiftright("ord", bits).isin(prefixes))
            rows += _sums(inside, max(0, bits - STEP_BITS))
        ranges = Ranges([r for k, r in enumerate(ranges.rows) if k not in gone] + rows)


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            order_key(text).alias("ord"),
        )
    )
    with temporary(docs.sparkSession):
        starts, _ = shard_starts(staged(rows.groupBy("ord").agg(F.sum("size").alias("bytes"))), n_shards)
    placed = rows.withColumns(
        {
            "shard": reduce(add, [(F.col("ord") >= F.lit(k)).cast("int") for k in starts], F.lit(0)),
            "cell": F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int"),
        }
    )
    counted = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "ord")
    return (
        placed.withColumn("k", F.row_number().over(within))
        .join(offsets, ["shard", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("k") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
