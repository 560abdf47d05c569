"""N-gram Jaccard join over word shingles, by count vectors in R-trees.

A document's set holds its distinct word shingles as 64-bit hashes. Two documents link when
denominator * intersection >= numerator * union; by default shingles have three words and the
fraction is 90 / 100.

Each set is a point: its hashes are dealt into groups, and the counts of the groups are the
coordinates. The summed minima of two points' coordinates bound their sets' overlap from above.
An R-tree over the points prunes whole nodes by the same bound, taken with the node's largest
coordinates; pairs that survive are verified on the sets themselves.

One R-tree over all documents would compare each size band with itself, since boxes of unrelated
texts overlap in every coordinate. So points are first dealt into buckets without losing a pair:
the shingles of sets of at most U shingles are dealt into groups, and a set of n shingles differs
from any linked one in at most D = (n + m) * (denominator - numerator) // (denominator + numerator)
shingles, m being the size of its largest partner; so in at most D groups. Sizes are banded, and
each document is dealt by D + 1 groups of its own band, and of the next band if a partner can be there.

Which D + 1 groups follows from one order of all groups' contents: rare ones first, those without
shingles last. Two linked sets share more groups than either leaves out, and leave out the last ones
of the order, so both are dealt by the first one that they share. How often shingles occur is counted
in slots by hash, over all documents, for the order only: any order loses no pair, and this one keeps
passages that many documents share from gathering them in one bucket.

Cases: a text of fewer than three words is one shingle, the whole sequence; a null text or one
without words has no shingles and links with nothing; equal sets are one class (chained to its
smallest id, so thousands of copies cost no pairs); rows without an id are returned with a null
component; repeated ids are one document for linking and are returned as often as they occur;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import bounded_batches, free_names, lookup, staged, temporary, tidy
from tidemill.llm.linking import BROADCAST_IDS, Likely, buckets, link, with_ids


@dataclass(frozen=True)
class Similarity:
    """Words of a shingle, and the least Jaccard similarity as a fraction."""

    words: int = 3
    numerator: int = 90
    denominator: int = 100

    def differing(self, longest: int) -> int:
        """Shingles in which two linked sets, the larger one of at most `longest`, can differ."""
        return longest * (self.denominator - self.numerator) // self.numerator

    def apart(self, size: int, most: int) -> int:
        """Shingles in which a set of so many can differ from a linked one of at most `most`."""
        partner = min(most, size * self.denominator // self.numerator)
        return (size + partner) * (self.denominator - self.numerator) // (self.denominator + self.numerator)

    def groups(self, longest: int) -> int:
        d = self.differing(longest)
        return d + 3 + int(1.5 * d * np.exp(-0.6 * longest / max(1, d)))

    def bands(self, most: int) -> list[int]:
        """Upper ends of size bands, wide enough that a partner is in the same band or the next."""
        ends = [1]
        while ends[-1] < most:
            ends.append(max(ends[-1] + 1, ends[-1] * self.denominator**2 // self.numerator**2))
        return ends


#: Coordinates of a point by the size of its set, so that unrelated sets' bounds stay below the threshold.
COORDINATES = ((400, 64), (2500, 256), (1 << 62, 1024))
#: Coordinates up to which a point isn't compressed, and the mark of one that is.
PLAIN, PACKED = 64, 0x80
LEAF = 32
#: Pairs whose bounds are taken at once.
STEP_PAIRS = 1024
#: Bits of the slots in which shingles are counted; tasks whose counts are added in one.
SLOT_BITS, ADDING_TASKS = 20, 16
#: Warmth of a group without shingles, above that of all others.
WARMEST = 255
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A finer mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingles(data: bytes, hashes: WordHashes, size: int = 3) -> np.ndarray:
    """Sorted distinct shingle hashes of lower-cased bytes."""
    words = data.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(hashes) > 1 << 17:
        hashes.clear()
    k = min(size, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total = mixed(total + h[i : len(h) - k + 1 + i] * np.uint64(MULTIPLIERS[i % len(MULTIPLIERS)]))
    return np.unique(total)


def normal(text: str | None) -> bytes:
    return (text or "").encode().lower()


def slots(found: np.ndarray) -> np.ndarray:
    return ((found * np.uint64(MULTIPLIERS[0])) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def warmth(counted: np.ndarray) -> np.ndarray:
    """Slots' counts on a logarithmic scale of a byte."""
    return np.minimum(8 * np.log2(1.0 + counted), WARMEST - 1).astype(np.uint8)


def bucket_keys(found: np.ndarray, ends: np.ndarray, like: Similarity, warm: np.ndarray) -> np.ndarray:
    """Keys of a set: the hash of a group's members, of as many groups as can differ and one, for its band and, where a partner may be, the next."""
    n = len(found)
    own = int(np.searchsorted(ends, n))
    keys = []
    member, heat = mixed(found), warm[slots(found)]
    for level in [own] if n * like.denominator // like.numerator <= ends[own] else [own, own + 1]:
        groups = like.groups(int(ends[level]))
        of = ((found >> np.uint64(33)) * np.uint64(groups)) >> np.uint64(31)
        order = np.argsort(of, kind="stable")
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(member[order], dtype=np.uint64)))
        bounds = np.searchsorted(of[order], np.arange(groups + 1, dtype=np.uint64))
        total = sums[bounds[1:]] - sums[bounds[:-1]]
        name = np.arange(groups, dtype=np.uint64) * np.uint64(MULTIPLIERS[0]) + np.uint64((level + 1) * MULTIPLIERS[1] & (1 << 64) - 1)
        own_keys = mixed(mixed(name) ^ total)
        full = bounds[1:] > bounds[:-1]
        place = np.full(groups, WARMEST, np.uint64)
        place[full] = np.minimum.reduceat(heat[order], bounds[:-1][full])
        place = (place << np.uint64(56)) | (own_keys >> np.uint64(8))
        last = like.apart(n, int(ends[level]))
        keys.append(own_keys[place <= np.partition(place, last)[last]] if last < groups else own_keys)
    return np.concatenate(keys).view(np.int64)


def counts(found: np.ndarray) -> bytes:
    """The point of a set: a byte that tells the bytes of a coordinate, and the coordinates, packed where they are many."""
    size = next(k for most, k in COORDINATES if len(found) < most)
    at = np.bincount((mixed(found) >> np.uint64(40)).astype(np.int64) % size, minlength=size)
    width = next(w for w in (1, 2, 4) if int(at.max()) < 1 << 8 * w)
    body = at.astype(f"<u{width}").tobytes()
    return bytes([width]) + body if size <= PLAIN else bytes([width | PACKED]) + zstandard.ZstdCompressor(level=1).compress(body)


def unpacked(blobs: list[bytes]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By bytes of a coordinate and of a point: (places in the list, matrix of the points)."""
    unpacker, found = zstandard.ZstdDecompressor(), {}
    for k, b in enumerate(blobs):
        body = unpacker.decompress(b[1:]) if b[0] & PACKED else b[1:]
        at, bodies = found.setdefault((b[0] & ~PACKED, len(body)), ([], []))
        at.append(k)
        bodies.append(body)
    return {(width, n): (np.array(at), np.frombuffer(b"".join(bodies), f"<u{width}").reshape(len(at), -1).astype(np.int32)) for (width, n), (at, bodies) in found.items()}


def folded(at: np.ndarray, size: int) -> np.ndarray:
    """Points of so many coordinates, each the sum of those of finer points that it stands for."""
    return at if at.shape[1] == size else at.reshape(len(at), at.shape[1] // size, size).sum(axis=1, dtype=np.int32)


def points(blobs: list[bytes]) -> np.ndarray:
    """Points of one bucket as rows of one matrix; finer ones are folded if there are coarser ones."""
    found = unpacked(blobs).values()
    size = min(at.shape[1] for _, at in found)
    out = np.empty((len(blobs), size), np.int32)
    for places, at in found:
        out[places] = folded(at, size)
    return out


class RTree:
    """Sort-tile-recursive leaves over points, with the largest coordinates of each node on every level."""

    def __init__(self, at: np.ndarray):
        self.at = at

    def __getattr__(self, name: str) -> object:
        """Nodes are made when they are first asked for: a bucket of one leaf needs none."""
        if name not in ("order", "leaves", "levels", "least"):
            raise AttributeError(name)
        self._build()
        return self.__dict__[name]

    def _build(self) -> None:
        at = self.at
        order = np.arange(len(at))
        spread = np.argsort(-at.std(axis=0), kind="stable")[:2]
        slabs = max(1, int(np.ceil(np.sqrt(len(at) / LEAF))))
        order = order[np.argsort(at.sum(axis=1), kind="stable")]
        tiles = [t[np.argsort(at[t, spread[0]], kind="stable")] for t in np.array_split(order, slabs)]
        self.order = np.concatenate(tiles)
        self.leaves = [self.order[i : i + LEAF] for i in range(0, len(self.order), LEAF)]
        self.levels = [np.stack([at[x].max(axis=0) for x in self.leaves])]
        while len(self.levels[-1]) > LEAF:
            below = self.levels[-1]
            self.levels.append(np.stack([below[i : i + LEAF].max(axis=0) for i in range(0, len(below), LEAF)]))
        self.least = np.array([at[x].sum(axis=1).min() for x in self.leaves])

    def overlapping(self, point: np.ndarray, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
        """(indices, bounds) of the points whose overlap with `point` can reach the threshold."""
        size = int(point.sum())
        need = lambda n: -(-numerator * (size + n) // (numerator + denominator))
        nodes = np.arange(len(self.levels[-1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            bound = np.minimum(self.levels[depth][nodes], point).sum(axis=1)
            least = self.least[nodes] if depth == 0 else 0
            nodes = nodes[bound >= need(least)]
            if depth:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1])]
        if not len(nodes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = np.concatenate([self.leaves[k] for k in nodes])
        bound = np.minimum(self.at[inside], point).sum(axis=1)
        good = bound >= need(self.at[inside].sum(axis=1))
        return inside[good], bound[good]


class PointBound(Likely):
    """Pairs of points whose bound reaches the threshold, by an R-tree."""

    def __init__(self, like: Similarity):
        self.like = like

    def prepared(self, payloads: list) -> RTree:
        return RTree(points(payloads))

    def near(self, at: RTree, k: int) -> tuple[np.ndarray, np.ndarray]:
        return at.overlapping(at.at[k], self.like.numerator, self.like.denominator)

    def matrix(self, at: RTree, items: np.ndarray) -> np.ndarray:
        own = at.at[items]
        bound, sizes = np.minimum(own[:, None, :], own[None, :, :]).sum(axis=2), own.sum(axis=1)
        good = (self.like.numerator + self.like.denominator) * bound >= self.like.numerator * (sizes[:, None] + sizes[None, :])
        return np.where(good, bound, 0)

    def order(self, at: RTree) -> np.ndarray:
        return at.order

    def both(self, left: list, right: list) -> np.ndarray:
        out = np.zeros(len(left), bool)
        top = self.like.numerator + self.like.denominator
        for a in range(0, len(left), STEP_PAIRS):
            n = len(left[a : a + STEP_PAIRS])
            kinds = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
            rows = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
            matrices: list[list[np.ndarray]] = [[], []]
            for side, blobs in enumerate((left[a : a + n], right[a : a + n])):
                for places, at in unpacked(blobs).values():
                    kinds[side][places] = len(matrices[side])
                    rows[side][places] = np.arange(len(places))
                    matrices[side].append(at)
            for x, p in enumerate(matrices[0]):
                for y, q in enumerate(matrices[1]):
                    own = np.flatnonzero((kinds[0] == x) & (kinds[1] == y))
                    size = min(p.shape[1], q.shape[1])
                    p_own, q_own = folded(p[rows[0][own]], size), folded(q[rows[1][own]], size)
                    bound = np.minimum(p_own, q_own).sum(axis=1, dtype=np.int64)
                    out[a + own] = top * bound >= self.like.numerator * (p_own.sum(axis=1, dtype=np.int64) + q_own.sum(axis=1, dtype=np.int64))
        return out


def new_sets(batch: pa.RecordBatch, like: Similarity, hashes: WordHashes, seen: set[bytes]) -> Iterator[tuple[int, np.ndarray, bytes, bool]]:
    """(row, set, digest, whether it is a set's first row in the task that has an id) of rows (id, text)."""
    for k, (id_, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
        found = shingles(normal(text.as_py()), hashes, like.words)
        digest = xxhash.xxh3_128_digest(found.tobytes())
        new = bool(len(found)) and id_.is_valid and digest not in seen
        if new:
            seen.add(digest)
        yield k, found, digest, new


def shingle_table(source: DataFrame, like: Similarity) -> DataFrame:
    """(id, n, digest, point) of every row of source(id, text); a set without shingles has no point.

    Each task adds a row of n -1, whose point has the packed counts of shingles by slot, each set once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hashes, seen, counted = ["id", "n", "digest", "point"], WordHashes(), set(), np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            rows, fresh = [], [np.zeros(0, np.uint64)]
            for _, found, digest, new in new_sets(batch, like, hashes, seen):
                rows.append((len(found), digest, counts(found) if len(found) else None))
                if new:
                    fresh.append(found)
            np.add.at(counted, slots(np.concatenate(fresh)), np.uint32(1))
            sizes, digests, at = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(at, pa.binary())], names=names)
        yield _counts_row(counted, names)

    return source.mapInArrow(tidy(run), "id long, n long, digest binary, point binary")


def _counts_row(counted: np.ndarray, names: list[str]) -> pa.RecordBatch:
    blob = zstandard.ZstdCompressor(level=1).compress(counted.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([None], pa.binary()), pa.array([blob], pa.binary())], names=names)


def slot_counts(table: DataFrame) -> np.ndarray:
    """The sum of the counts by slot of all tasks that wrote table; a few tasks add them before the driver does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            for blob in batch.column(0):
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())], names=["point"])

    total = np.zeros(1 << SLOT_BITS, np.uint64)
    for row in table.where("n = -1").select("point").repartition(ADDING_TASKS).mapInArrow(tidy(run), "point binary").toLocalIterator():
        total += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row[0])), np.uint32)
    return total


def keyed_documents(source: DataFrame, like: Similarity, counted: np.ndarray) -> DataFrame:
    """(key, id) of the sets of source(id, text), each once in a task; sets are made anew rather than kept on disk."""
    shared = source.sparkSession.sparkContext.broadcast(warmth(counted).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, warm = WordHashes(), set(), np.frombuffer(shared.value, np.uint8)
        ends = np.array(like.bands(64), dtype=np.int64)
        for batch in batches:
            keys, owners = [np.zeros(0, np.int64)], []
            for k, found, _, new in new_sets(batch, like, hashes, seen):
                if not new:
                    continue
                if len(found) * 2 > ends[-1]:
                    ends = np.array(like.bands(len(found) * 4), dtype=np.int64)
                keys.append(bucket_keys(found, ends, like, warm))
                owners += [k] * len(keys[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(pa.array(owners, pa.int64()))], names=["key", "id"])

    return source.mapInArrow(tidy(run), "key long, id long")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(id, blob) of docs(id, text), each id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            blobs = [packer.compress(normal(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["id", "blob"])

    return docs.select("id", "text").mapInArrow(tidy(run), "id long, blob binary").dropDuplicates(["id"])


def link_documents(docs: DataFrame, like: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    bounded_batches(docs.sparkSession)
    with temporary(docs.sparkSession):
        return staged(_linked_documents(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), like), keep=True)


def _linked_documents(source: DataFrame, like: Similarity) -> DataFrame:
    written = staged(shingle_table(source, like))
    table = written.where("n >= 0")
    has = table.where("n > 0 and id is not null")
    first = staged(has.groupBy("digest").agg(F.min("id").alias("a"), F.count("*").alias("copies")).where("copies > 1"))
    equal = staged(lookup(has.select("id", "digest"), first, "digest", "copies", has.count()).where("a <> id").select("a", F.col("id").alias("b")).distinct())
    at = table.where("point is not null and id is not null").select("id", "point").dropDuplicates(["id"])
    members = staged(buckets(keyed_documents(source, like, slot_counts(written))).join(at.withColumnRenamed("point", "payload"), "id"))
    hashes = WordHashes()

    def to_set(blob: bytes) -> np.ndarray:
        return shingles(zstandard.ZstdDecompressor().decompress(blob), hashes, like.words)

    roots = link(members, PointBound(like), lambda ids: packed_texts(with_ids(source, ids)), to_set, like.numerator, like.denominator, equal)
    return table.select("id", "n").join(roots, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def keep_one_each(docs: DataFrame, like: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the smallest id of their component, with their columns."""
    (name,) = free_names(docs.columns, "gone")
    with temporary(docs.sparkSession):
        gone = staged(link_documents(docs, like, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), keep=True)
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs[id_col].cast("long") == F.col(name), "left_anti")
