"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Texts are split into pre-tokens and gathered in blocks; a block keeps the positions of its
   words as numbers into its own list of distinct words.
2. The distinct words of all blocks are dealt by word, packed by block and slice of the word
   space, so that equal words meet; each is encoded once where it is met first.
3. The ids go back to the blocks, where they are put together by position.

Decoding joins ids to the token-byte table, which has one row a token and is broadcast: its
size is the vocabulary's, not the corpus's.

Packing keeps the shuffle near the size of the distinct words a block holds, rather than a row
for each pre-token. Blocks are shuffled once and read from there both for their words and for
their positions. They are cut from the input's partitions in their order; reading files, a lost
executor's blocks come out the same again, and a block whose words don't fit its positions fails
the query.

Cases: a null text counts as an empty one, which has no ids; a text of any length belongs to
one block and is split as it is read; equal rows are encoded alike; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import bounded_batches, tidy

#: Bytes of text gathered in a block before it is closed.
BLOCK_BYTES = 8 << 20
#: Words whose ids a task remembers at once.
MEMORY_WORDS = 1 << 21
LONG_PIECE = 64
#: Words of a block put together at a time.
STEP_WORDS = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of the lowest rank merges first, the leftmost of equal ones."""
    if (known := ranks.get(piece)) is not None:
        return [known]
    if len(piece) > LONG_PIECE:
        return _encode_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(piece[i : i + 2]) for i in range(len(piece) - 1)]
    while pairs:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])
    return [ranks[p] for p in parts]


def _encode_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over linked parts, for pieces where a scan for each merge would be quadratic."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (r := ranks.get(piece[i : end[after[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[after[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers, compressed: 15 bits a piece, and what exceeds them apart."""
    values = values.astype(np.uint32, copy=False)
    large = values >= 1 << 15
    low = np.where(large, (values & 0x7FFF) | 0x8000, values).astype("<u2")
    high = (values[large] >> 15).astype("<u4")
    data = len(values).to_bytes(8, "little") + low.view(np.uint8).reshape(-1, 2).T.tobytes() + high.view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(blob: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:8], "little")
    low = np.frombuffer(data, np.uint8, 2 * n, 8).reshape(2, n).T.copy().view("<u2").ravel()
    out = low.astype(np.uint32)
    large = out >= 1 << 15
    k = int(large.sum())
    high = np.frombuffer(data, np.uint8, 4 * k, 8 + 2 * n).reshape(4, k).T.copy().view("<u4").ravel()
    out[large] = (out[large] & 0x7FFF) | (high << 15)
    return out


def pack_words(words: list[bytes]) -> bytes:
    sizes = pack(np.fromiter(map(len, words), np.uint32, len(words)))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def unpack_words(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    ends = np.cumsum(unpack(blob[4 : 4 + n])).tolist()
    data = zstandard.ZstdDecompressor().decompress(blob[4 + n :])
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Block:
    """Documents whose words are numbered by their own list."""

    def __init__(self) -> None:
        self.size, self.ids, self.counts = 0, [], []
        self.numbers: dict[str, int] = {}
        self.places: list[np.ndarray] = []

    def add(self, doc_id: object, text: str, pattern: regex.Pattern) -> None:
        numbers = self.numbers
        if len(text) < 1 << 20:
            found = [numbers.setdefault(w, len(numbers)) for w in pattern.findall(text)]
            places = np.array(found, dtype=np.uint32)
        else:
            places = np.fromiter((numbers.setdefault(m[0], len(numbers)) for m in pattern.finditer(text)), np.uint32)
        self.ids.append(doc_id)
        self.counts.append(len(places))
        self.places.append(places)
        self.size += len(text)

    def row(self, n_slices: int) -> tuple[list, bytes, bytes, bytes, list[bytes]]:
        """(doc ids, words of each, places, slice of each word, words by slice); frequent words get low numbers."""
        places = np.concatenate(self.places) if self.places else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(places, minlength=len(self.numbers)), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        plain = [w.encode() for w in self.numbers]
        words = [plain[i] for i in order.tolist()]
        of = np.fromiter((xxhash.xxh32_intdigest(w) % n_slices for w in words), np.uint32, len(words))
        slices: list[list[bytes]] = [[] for _ in range(n_slices)]
        for w, s in zip(words, of.tolist(), strict=True):
            slices[s].append(w)
        return self.ids, pack(np.array(self.counts, np.uint32)), pack(rank[places] if len(places) else places), pack(of), [pack_words(s) for s in slices]


def token_blocks(docs: DataFrame, pattern: str, n_slices: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, doc_ids, counts, places, slice_of, slices) of docs(doc_id, text), one row a block."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow_id = docs.select("doc_id").limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        block = Block()

        def close() -> pa.RecordBatch:
            ids, counts, places, of, slices = block.row(n_slices)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(arrow_id)), pa.array([counts], pa.binary()), pa.array([places], pa.binary()), pa.array([of], pa.binary()), pa.array([slices], pa.list_(pa.binary()))],
                names=["doc_ids", "counts", "places", "slice_of", "slices"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(doc_id, text.as_py() or "", compiled)
                if block.size >= block_bytes:
                    yield close()
                    block = Block()
        if block.ids:
            yield close()

    found = docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_ids array<{kind}>, counts binary, places binary, slice_of binary, slices array<binary>")
    return found.select(F.monotonically_increasing_id().alias("block"), "*")


def block_words(blocks: DataFrame, n_slices: int) -> DataFrame:
    """(block, slice, words) of blocks. All their columns are read, so that their shuffle is the one that the positions use."""
    at = blocks.columns.index("slices")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                slices = batch.column(at)[i].values
                block = pa.array([batch.column(0)[i].as_py()] * n_slices, pa.int64())
                yield pa.RecordBatch.from_arrays([block, pa.array(range(n_slices), pa.int32()), slices], names=["block", "slice", "words"])

    return blocks.mapInArrow(tidy(run), "block long, slice int, words binary")


def encode_words(slices: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(block, slice, ids) of slices(block, slice, words): each distinct word is encoded once."""
    spark = slices.sparkSession
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = shared.value, {}
        for batch in batches:
            out = []
            for blob in batch.column(2):
                words = unpack_words(blob.as_py())
                if len(known) > MEMORY_WORDS:
                    known.clear()
                ids = []
                for w in words:
                    if (x := known.get(w)) is None:
                        x = known[w] = tuple(encode_piece(w, ranks))
                    ids.append(x)
                sizes = pack(np.fromiter(map(len, ids), np.uint32, len(ids)))
                flat = pack(np.fromiter((i for x in ids for i in x), np.uint32))
                out.append(len(sizes).to_bytes(4, "little") + sizes + flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "slice", "ids"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return slices.repartition(n, "slice").mapInArrow(tidy(run), "block long, slice int, ids binary")


def put_together(row: dict, slices: list[int], blobs: list[bytes], n_slices: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of documents, ids) of a block, from the ids of its words by slice."""
    of, places, counts = unpack(row["slice_of"]), unpack(row["places"]), unpack(row["counts"])
    sizes, starts, flat, base = np.zeros(len(of), np.int32), np.zeros(len(of), np.int32), [], 0
    by_slice = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[by_slice], np.arange(n_slices + 1))
    for s, blob in zip(slices, blobs, strict=True):
        n = int.from_bytes(blob[:4], "little")
        size, own = unpack(blob[4 : 4 + n]).astype(np.int32), unpack(blob[4 + n :])
        at = by_slice[bounds[s] : bounds[s + 1]]
        if len(at) != len(size):
            raise ValueError(f"block {row['block']}: {len(size)} encoded words for {len(at)} of slice {s}")
        sizes[at], starts[at] = size, base + np.cumsum(size) - size
        flat.append(own.astype(np.int32))
        base += len(own)
    if len(slices) != n_slices:
        raise ValueError(f"block {row['block']}: {len(slices)} of {n_slices} slices")
    flat = np.concatenate(flat)
    ends = np.concatenate(([0], np.cumsum(sizes[places], dtype=np.int64)))
    ids = np.empty(int(ends[-1]), np.int32)
    for a in range(0, len(places), STEP_WORDS):
        part = places[a : a + STEP_WORDS]
        each = sizes[part]
        within = np.arange(int(each.sum()), dtype=np.int32) - np.repeat(np.cumsum(each, dtype=np.int32) - each, each)
        ids[ends[a] : ends[a + len(part)]] = flat[np.repeat(starts[part], each) + within]
    return ends[np.concatenate(([0], np.cumsum(counts.astype(np.int64))))], ids


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", n_slices: int | None = None) -> DataFrame:
    """(doc_id, ids) of every row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_slices = n_slices or min(4096, max(16, n))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = token_blocks(source, pattern, n_slices).repartition(n, "block")
    ids = encode_words(block_words(blocks, n_slices), ranks)
    kind = source.schema["doc_id"].dataType.simpleString()

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.drop_columns(["slices"]).to_pylist()[0]
        offsets, flat = put_together(row, right.column("slice").to_pylist(), right.column("ids").to_pylist(), n_slices)
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
        return pa.table([pa.array(row["doc_ids"], left.schema.field("doc_ids").type.value_type), ids], names=["doc_id", "ids"])

    return blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(assemble, f"doc_id {kind}, ids array<int>")


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table, by id."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _joined(ids: pa.Array, table: pa.Array, between: bytes) -> pa.Array:
    """For each list of ids, the table's values joined to bytes; a null list counts as empty."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    taken = pc.take(table, ids.flatten())
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int64()), taken)
    return pc.binary_join(lists.cast(pa.list_(table.type)), pa.scalar(between, table.type))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """encoded with a column `decoded`, the bytes of its ids."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(token_bytes(ranks))
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.binary())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _joined(batch.column(at), table, b"")], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"
    return encoded.mapInArrow(tidy(run), schema)


def digests(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded(doc_id, ids), whose ids are decoded for it."""
    shared = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(shared.value, pa.binary())
        numbers = pa.array([str(i).encode() for i in range(len(tokens))], pa.binary())
        sha = lambda values: pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in values], pa.string())
        for batch in batches:
            ids = batch.column(1)
            n = pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64())
            told, decoded = sha(_joined(ids, numbers, b",")), sha(_joined(ids, tokens, b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, told, decoded], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The digest columns of the registered query."""
    ranks = load_ranks(path)
    return digests(encode(docs, ranks, pattern), ranks)
