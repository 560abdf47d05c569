"""Links between similar items: buckets, candidate pairs, exact verification, union-find.

Items share a bucket where they share a key. Links are found in two steps. First each bucket
offers a spanning forest of its likely pairs, which joins large groups of near copies by as many
verified links as they have members. Then every likely pair whose items are still in different
components, and that was not verified before, is verified. So no link that would join two
components is lost, and pairs inside a component are not multiplied out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import staged, tidy

#: Buckets of more items are cut into parts of this size, and every two parts are taken together.
PART = 4096
#: Likely pairs an item, on average, beyond which a bucket gives a forest first.
MANY = 4
#: Candidate ids are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_IDS = 1_000_000


class Likely:
    """Which items of a bucket may be linked, by their payloads."""

    #: Items compared with each other at once.
    chunk = 32

    def prepared(self, payloads: list) -> object:
        raise NotImplementedError

    def near(self, at: object, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(indices, closeness) of all that may be linked with item k, itself included or not."""
        raise NotImplementedError

    def matrix(self, at: object, items: np.ndarray) -> np.ndarray:
        """Closeness of every two of a few items; 0 where they can't be linked."""
        raise NotImplementedError

    def order(self, at: object) -> np.ndarray:
        """All items, with similar ones next to each other."""
        raise NotImplementedError

    def both(self, left: list, right: list) -> np.ndarray:
        """Whether each left item may be linked with the right one."""
        raise NotImplementedError

    def forest(self, payloads: list) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that join what is alike: in chunks of similar items each with its closest earlier one, then the chunks' heads alike.

        Heads that are left are looked up among all items, so every item that may be linked is in a pair.
        """
        at, i, j = self.prepared(payloads), [np.zeros(0, int)], [np.zeros(0, int)]
        level = self.order(at)
        while len(level) > 1:
            heads = []
            for a in range(0, len(level), self.chunk):
                items = level[a : a + self.chunk]
                close = np.tril(self.matrix(at, items), -1)
                best = close.argmax(axis=1)
                linked = close[np.arange(len(items)), best] > 0
                i.append(items[linked])
                j.append(items[best[linked]])
                heads.append(items[~linked])
            rest = np.concatenate(heads)
            if len(rest) == len(level):
                break
            level = rest
        for k in level.tolist() if len(level) > 1 else []:
            found, close = self.near(at, k)
            found, close = found[found != k], close[found != k]
            if len(found):
                i.append(np.array([k]))
                j.append(found[[int(np.argmax(close))]])
        return np.concatenate(i), np.concatenate(j)

    def pairs(self, payloads: list) -> tuple[np.ndarray, np.ndarray, bool]:
        """(i, j, whether pairs were left out): all pairs that may be linked, or a forest where they are many."""
        at, n = self.prepared(payloads), len(payloads)
        if n <= self.chunk:
            i, j = np.nonzero(np.tril(self.matrix(at, np.arange(n)), -1))
        else:
            i, j, total = [np.zeros(0, int)], [np.zeros(0, int)], 0
            for k in range(1, n):
                found = self.near(at, k)[0]
                found = found[found < k]
                i.append(np.full(len(found), k))
                j.append(found)
                total += len(found)
                if total > MANY * n:
                    break
            i, j = np.concatenate(i), np.concatenate(j)
        return (i, j, False) if len(i) <= MANY * n else (*self.forest(payloads), True)

    def across(self, payloads: list, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of items of different components; items of the largest one are only looked up by others."""
        at, i, j = self.prepared(payloads), [np.zeros(0, int)], [np.zeros(0, int)]
        names, sizes = np.unique(roots, return_counts=True)
        largest = names[sizes.argmax()]
        for k in np.flatnonzero(roots != largest).tolist():
            found, _ = self.near(at, k)
            found = found[(roots[found] != roots[k]) & ((found < k) | (roots[found] == largest))]
            i.append(np.full(len(found), k))
            j.append(found)
        return np.concatenate(i), np.concatenate(j)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in edges(a, b); root is the smallest id that it is linked with.

    Each round points every node to its smallest neighbour, follows the pointers twice, and
    contracts the edges; what is left shrinks by a factor each round. Hubs are no hot keys, since
    the minimum is taken before the shuffle and skewed joins are split.
    """
    spark = edges.sparkSession
    left = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root"))
        for _ in range(2):
            to = staged(to)
            on = to.select(F.col("id").alias("mid"), F.col("root").alias("end"))
            to = to.join(on, F.col("root") == F.col("mid")).select("id", F.col("end").alias("root"))
        to = staged(to)
        step = to.select(F.col("id").alias("mid"), F.col("root").alias("end"))
        if found is None:
            found = to
        else:
            found = staged(found.join(step, F.col("root") == F.col("mid"), "left").select("id", F.coalesce("end", "root").alias("root")))
        a, b = (to.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        moved = left.join(a, "a").join(b, "b").where("a_root <> b_root")
        left = staged(moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
    return found if found is not None else spark.createDataFrame([], "id long, root long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, starts, ends): rows sorted by the first column, and its runs; a run is never cut."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if rest and rest[-1].column(0)[-1].as_py() == int(keys[0]) == int(keys[-1]):
            rest.append(batch)
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        rows = pa.concat_batches([*rest, batch.slice(0, last)])
        rest = [batch.slice(last)]
        if rows.num_rows:
            yield rows, *_bounds(rows)
    if rest:
        rows = pa.concat_batches(rest)
        yield rows, *_bounds(rows)


def _bounds(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    keys = rows.column(0).to_numpy()
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))


def _pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (b.astype(np.uint64) ^ np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _by_key(df: DataFrame, key: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key)


def buckets(keyed: DataFrame) -> DataFrame:
    """(bucket, id) of the different sets of two or more ids that share a key in keyed(key, id)."""

    def batch_of(names: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(names), lists], names=["bucket", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in _runs(batches):
            ids, sizes = rows.column(1).to_numpy(), ends - starts
            two = starts[sizes == 2]
            a, b = np.minimum(ids[two], ids[two + 1]), np.maximum(ids[two], ids[two + 1])
            names, at = np.unique(_pair_names(a, b)[a != b], return_index=True)
            if len(names):
                yield batch_of(names, np.column_stack((a[a != b][at], b[a != b][at])).ravel(), np.full(len(names), 2))
            for i in np.flatnonzero(sizes > 2).tolist():
                members = np.unique(ids[starts[i] : ends[i]])
                parts = [members[k : k + PART] for k in range(0, len(members), PART)]
                for k, p in enumerate(parts):
                    for q in parts[:k] if len(parts) > 1 else [p[:0]]:
                        both = np.concatenate((q, p))
                        if len(both) == 2:
                            yield batch_of(_pair_names(both[:1], both[1:]), both, np.array([2]))
                        elif len(both) > 2:
                            yield batch_of(np.array([xxhash.xxh3_64_intdigest(both.tobytes()) - (1 << 63)]), both, np.array([len(both)]))

    found = _by_key(keyed.select("key", "id"), "key").mapInArrow(tidy(run), "bucket long, ids array<long>")
    return found.dropDuplicates(["bucket"]).select("bucket", F.explode("ids").alias("id"))


def likely_pairs(members: DataFrame, likely: Likely) -> DataFrame:
    """Distinct (a, b, dense) of members(bucket, id, payload), a < b: all likely pairs of a bucket, or a forest of one that has many.

    A bucket with a forest adds a row (bucket, bucket, true). With a column root: all likely pairs across components.
    """
    rooted = "root" in members.columns
    columns = ["bucket", "id", "payload", *(["root"] if rooted else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in _runs(batches):
            ids, payloads, sizes = rows.column(1).to_numpy(), rows.column(2), ends - starts
            all_roots = rows.column(3).to_numpy() if rooted else None
            two = starts[sizes == 2]
            if rooted:
                two = two[all_roots[two] != all_roots[two + 1]]
            two = two[likely.both(payloads.take(pa.array(two)).to_pylist(), payloads.take(pa.array(two + 1)).to_pylist())] if len(two) else two
            out_a, out_b, dense = [np.minimum(ids[two], ids[two + 1])], [np.maximum(ids[two], ids[two + 1])], []
            for k in np.flatnonzero(sizes > 2).tolist():
                at = slice(int(starts[k]), int(ends[k]))
                roots = all_roots[at] if rooted else None
                if rooted and (roots == roots[0]).all():
                    continue
                order = np.argsort(ids[at], kind="stable")
                own = ids[at][order]
                values = payloads.slice(at.start, at.stop - at.start).take(pa.array(order)).to_pylist()
                i, j, left_out = (*likely.across(values, roots[order]), False) if rooted else likely.pairs(values)
                if left_out:
                    dense.append(rows.column(0)[at.start].as_py())
                out_a.append(np.minimum(own[i], own[j]))
                out_b.append(np.maximum(own[i], own[j]))
            n = sum(map(len, out_a))
            if n or dense:
                marks = np.array(dense, dtype=np.int64)
                told = [pa.array(np.concatenate([*x, marks])) for x in (out_a, out_b)]
                yield pa.RecordBatch.from_arrays([*told, pa.array([False] * n + [True] * len(dense))], names=["a", "b", "dense"])

    return _by_key(members.select(*columns), "bucket").mapInArrow(tidy(run), "a long, b long, dense boolean").distinct()


def with_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose id is in ids(id); a small set is broadcast, a large one shuffled."""
    small = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, to_set: Callable[[bytes], np.ndarray], numerator: int, denominator: int) -> DataFrame:
    """The (a, b) whose sets have denominator * intersection >= numerator * union; texts(id, blob) has each id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        held = 0

        def of(item: int, blob: bytes) -> np.ndarray:
            nonlocal held
            if (found := kept.get(item)) is None:
                if held > 1 << 20:
                    kept.clear()
                    held = 0
                found = kept[item] = to_set(blob)
                held += len(found)
            return found

        for batch in batches:
            good = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                p, q = of(a, x.as_py()), of(b, y.as_py())
                shared = len(p) + len(q) - len(np.unique(np.concatenate((p, q))))
                good.append(denominator * shared >= numerator * (len(p) + len(q) - shared))
            kept_rows = batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
            yield kept_rows

    left = texts.select(F.col("id").alias("a"), F.col("blob").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("blob").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def link(
    members: DataFrame,
    likely: Likely,
    texts_of: Callable[[DataFrame], DataFrame],
    to_set: Callable[[bytes], np.ndarray],
    numerator: int,
    denominator: int,
    equal: DataFrame | None = None,
) -> DataFrame:
    """(id, root) of all ids that are linked, for members(bucket, id, payload).

    texts_of(ids) gives (id, blob) of the ids asked for; equal(a, b) has links known without verification.
    Every item that may be linked with another is in the forest, whose texts serve both steps.
    """
    found = staged(likely_pairs(members, likely))
    pairs, dense = found.where("not dense").select("a", "b"), found.where("dense").select(F.col("a").alias("bucket"))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = staged(texts_of(staged(ids)))
    edges = verified(pairs, texts, to_set, numerator, denominator)
    known = staged(edges if equal is None else edges.unionByName(equal))
    roots = components(known)
    if dense.isEmpty():
        return roots
    placed = members.join(dense, "bucket", "left_semi").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    others = staged(likely_pairs(placed, likely).select("a", "b").join(pairs, ["a", "b"], "left_anti"))
    if others.isEmpty():
        return roots
    more = staged(verified(others, texts, to_set, numerator, denominator))
    return roots if more.isEmpty() else components(known.unionByName(more))


def _linked(sets: list[np.ndarray], numerator: int, denominator: int) -> tuple[list[int], list[int]]:
    """Links that join the items of each component, by a search that compares found items with those not yet found."""
    sizes = np.array([len(x) for x in sets])
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flag = np.zeros(int(numbers.max(initial=0)) + 1, bool)
    left, i, j = np.arange(len(sets)), [], []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        entries, owners = None, None
        while queue and len(left):
            k = queue.pop()
            if entries is None:
                entries = np.concatenate([numbers[starts[x] : starts[x + 1]] for x in left])
                owners = np.concatenate(([0], np.cumsum(sizes[left])[:-1]))
            own = numbers[starts[k] : starts[k + 1]]
            flag[own] = True
            shared = np.add.reduceat(flag[entries], owners, dtype=np.int64)
            flag[own] = False
            like = denominator * shared >= numerator * (sizes[left] + sizes[k] - shared)
            if like.any():
                found = left[like].tolist()
                i += [k] * len(found)
                j += found
                queue += found
                left, entries = left[~like], None
    return i, j


def link_by_sets(members: DataFrame, texts: DataFrame, to_sets: Callable[[list[bytes]], list[np.ndarray]], numerator: int, denominator: int) -> DataFrame:
    """(a, b) of verified links that join what is linked in each bucket of members(bucket, id); texts(id, blob) has each id once.

    For items whose texts are small: every text goes to its buckets, whose components are found exactly, so that no
    pair leaves a task but the links of a spanning forest.
    """

    def alike(p: np.ndarray, q: np.ndarray) -> bool:
        if numerator * max(len(p), len(q)) > denominator * min(len(p), len(q)):
            return False
        both = np.concatenate((p, q))
        both.sort()
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        return denominator * shared >= numerator * (len(both) - shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in _runs(batches):
            ids = rows.column(1).to_numpy()
            _, first, number = np.unique(ids, return_index=True, return_inverse=True)
            sets = to_sets(rows.column(2).take(pa.array(first)).to_pylist())
            out_a, out_b = [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                own = number[s:e].tolist()
                if e - s == 2 and alike(sets[own[0]], sets[own[1]]):
                    i, j = [0], [1]
                elif e - s > 2:
                    i, j = _linked([sets[x] for x in own], numerator, denominator)
                else:
                    continue
                out_a += [int(ids[s + x]) for x in i]
                out_b += [int(ids[s + x]) for x in j]
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    placed = members.join(texts, "id").select("bucket", "id", "blob")
    return _by_key(placed, "bucket").mapInArrow(tidy(run), "a long, b long")
