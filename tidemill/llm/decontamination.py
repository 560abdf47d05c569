"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Every passage of every document is a query. Items are classed by length, in powers of two; a
passage is one and a half times as long as the longest item of its class, and the next begins half
such an item further, so that every occurrence of an item lies within a passage. The index holds,
for each term, the items with its BM25 impact, in blocks with their largest impact. An item is retrieved where the
passage's score reaches a share of the item's score with itself; impacts are stored divided by
that score, so one threshold serves all items. WAND skips what the bounds rule out: passages
whose terms' largest impacts don't add up to the threshold, then items before the pivot, then
blocks whose maxima don't. What is retrieved is verified on the words around the passage: the
question and the answer of the item must both be there, by their share of word n-grams.

The index is broadcast while it is below a size; a larger benchmark is cut into shards of items,
each taken over all documents in turn. Term weights come from the whole benchmark.

Cases: null texts and items have no words and match nothing; equal items are separate items and
are all reported; an empty benchmark or table gives no matches; documents of any length are read
whole; rows without an id keep a null id; other columns are ignored or pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import bounded_batches, shared_value, staged, tidy

#: BM25 parameters, and the words of the items of the first class.
K1, B, SHORTEST = 1.2, 0.75, 16
#: Share of an item's own score that a passage must reach.
THRESHOLD = 0.6
#: Share of n-grams that verification asks of the question and of the answer.
OVERLAP, GRAM = 0.6, 3
BLOCK_ITEMS = 64
#: Runs of items whose bounds are summed for all passages of a text at once, before WAND.
RANGES = 16
#: Words of a text taken at a time.
STEP_WORDS = 1 << 16
#: Words of the items in one broadcast index.
SHARD_WORDS = 2_000_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case runs of ASCII letters and digits and of characters beyond ASCII."""
    return WORD.findall((text or "").encode().lower())


@dataclass
class Index:
    """The items of up to `longest` words. postings[t]: (items, impacts, maxima of blocks, largest impact) of term t.

    ranges[t]: the largest impacts of t among the items of each of RANGES runs of items; the last row is for words of no item.
    """

    longest: int
    postings: dict[int, tuple[list[int], list[float], list[float], float]]
    ranges: np.ndarray
    items: list[tuple[object, list[bytes], list[bytes]]]


@dataclass
class Indexes:
    terms: dict[bytes, int]
    classes: list[Index]


def split_item(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """(question, answer): at the last question mark with words behind it, else the last third of the words is the answer."""
    text = text or ""
    head, mark, tail = text.rpartition("?")
    if mark and words_of(tail) and words_of(head):
        return words_of(head), words_of(tail)
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 3) if words else 0
    return words[:cut], words[cut:]


def build_indexes(items: list[tuple[object, str | None]], frequencies: Counter, n_items: int, mean: float) -> Indexes:
    """The indexes of a shard of items, by class, with the term statistics of all items."""
    classes: dict[int, list] = defaultdict(list)
    terms: dict[bytes, int] = {}
    for key, text in items:
        if words := words_of(text):
            longest = SHORTEST
            while longest < len(words):
                longest *= 2
            classes[longest].append((key, text, words))
            for w in words:
                terms.setdefault(w, len(terms))
    return Indexes(terms, [_build(longest, classes[longest], terms, frequencies, n_items, mean) for longest in sorted(classes)])


def _build(longest: int, items: list, terms: dict[bytes, int], frequencies: Counter, n_items: int, mean: float) -> Index:
    lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
    ranges = np.zeros((len(terms) + 1, RANGES), np.float32)
    for k, (_, _, words) in enumerate(items):
        norm = K1 * (1 - B + B * len(words) / mean)
        weight = {w: float(np.log1p((n_items - frequencies[w] + 0.5) / (frequencies[w] + 0.5))) * c * (K1 + 1) / (c + norm) for w, c in Counter(words).items()}
        own = sum(weight.values())
        for w, x in weight.items():
            t, r = terms[w], k * RANGES // len(items)
            lists[t].append((k, x / own))
            ranges[t, r] = max(ranges[t, r], x / own)
    postings = {}
    for t, pairs in lists.items():
        at, impact = (list(x) for x in zip(*pairs, strict=True))
        maxima = [max(impact[i : i + BLOCK_ITEMS]) for i in range(0, len(impact), BLOCK_ITEMS)]
        postings[t] = (at, impact, maxima, max(maxima))
    return Index(longest, postings, ranges, [(key, *split_item(text)) for key, text, _ in items])


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[int]:
    """Items whose impacts over the distinct terms add up to the threshold."""
    end, postings = len(index.items), index.postings
    cursors = [[postings[t][0][0], 0, t] for t in terms if t in postings]
    found = []

    def seek(cursor: list[int], item: int) -> None:
        at = postings[cursor[2]][0]
        cursor[1] = bisect_left(at, item, cursor[1])
        cursor[0] = at[cursor[1]] if cursor[1] < len(at) else end

    while True:
        cursors.sort()
        total, pivot = 0.0, None
        for k, (item, _, t) in enumerate(cursors):
            if item == end:
                break
            total += postings[t][3]
            if total >= threshold:
                pivot = k
                break
        if pivot is None:
            return found
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        bound, stop = 0.0, end
        for cursor in cursors[: pivot + 1]:
            at, _, maxima, _ = postings[cursor[2]]
            block = bisect_left(at, item, cursor[1]) // BLOCK_ITEMS
            if block < len(maxima):
                bound += maxima[block]
                last = (block + 1) * BLOCK_ITEMS
                stop = min(stop, at[last] if last < len(at) else end)
        if bound < threshold:
            beyond = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
            target = max(item + 1, min(stop, beyond))
            for cursor in cursors[: pivot + 1]:
                if cursor[0] < target:
                    seek(cursor, target)
        elif cursors[0][0] == item:
            if sum(postings[t][1][i] for at, i, t in cursors[: pivot + 1] if at == item) >= threshold:
                found.append(item)
            for cursor in cursors[: pivot + 1]:
                seek(cursor, item + 1)
        else:
            for cursor in cursors[:pivot]:
                if cursor[0] < item:
                    seek(cursor, item)


def overlap(part: list[bytes], around: list[bytes]) -> float:
    """Share of the part's n-grams that occur around the passage; a short part is one gram."""
    n = min(GRAM, len(part))
    if not n:
        return 1.0
    grams = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
    there = {tuple(around[i : i + n]) for i in range(len(around) - n + 1)}
    return len(grams & there) / len(grams)


def likely_passages(index: Index, ids: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first word, distinct terms) of the passages whose bound for a run of items reaches the threshold."""
    stride, least = index.longest // 2, threshold * (1 - 1e-5)
    padded = np.concatenate((ids, np.full(-len(ids) % stride + 2 * stride, -1)))
    parts = index.ranges[padded].reshape(-1, stride, RANGES).sum(axis=1)
    bounds = parts[:-2] + parts[1:-1] + parts[2:]
    for k in np.flatnonzero((bounds >= least).any(axis=1)).tolist():
        terms = np.unique(ids[k * stride : (k + 3) * stride])
        if (index.ranges[terms].sum(axis=0) >= least).any():
            yield k * stride, terms[terms >= 0]


def passage_matches(text: str | None, indexes: Indexes, threshold: float = THRESHOLD) -> list[tuple[object, int, float, float]]:
    """(item, first word of the passage, question overlap, answer overlap) of the verified items, each at its best passage."""
    words = words_of(text)
    every = np.fromiter(map(indexes.terms.get, words, repeat(-1)), np.int64, len(words))
    out = []
    for index in indexes.classes if words else []:
        stride = index.longest // 2
        step = max(STEP_WORDS // stride, 1) * stride
        best: dict[int, tuple[object, int, float, float]] = {}
        for base in range(0, len(words), step):
            for at, terms in likely_passages(index, every[base : base + step + 2 * stride], threshold):
                start = base + at
                for item in block_max_wand(index, terms.tolist(), threshold):
                    key, question, answer = index.items[item]
                    around = words[max(0, start - stride) : start + 4 * stride]
                    q, a = overlap(question, around), overlap(answer, around)
                    if q >= OVERLAP and a >= OVERLAP and (item not in best or q + a > best[item][2] + best[item][3]):
                        best[item] = (key, start, q, a)
        out += [best[i] for i in sorted(best)]
    return out


def shards(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Indexes]:
    """Indexes of the items, each of at most SHARD_WORDS words beyond its first item, read one at a time.

    Term statistics of all items come first: document frequencies of the terms, which a shard's index takes.
    """
    frequencies, n_items, total = Counter(), 0, 0
    items = benchmark.select(F.col(id_col), F.col(text_col)).orderBy(id_col)
    for row in items.toLocalIterator():
        words = words_of(row[1])
        frequencies.update(set(words))
        n_items, total = n_items + bool(words), total + len(words)
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append((row[0], row[1]))
        size += len(words_of(row[1]))
        if size >= SHARD_WORDS:
            yield build_indexes(held, frequencies, n_items, total / max(1, n_items))
            held, size = [], 0
    if held:
        yield build_indexes(held, frequencies, n_items, total / max(1, n_items))


def _contaminated(docs: DataFrame, indexes: Indexes, id_col: str, text_col: str, item_kind: str) -> DataFrame:
    shared = shared_value(docs.sparkSession, indexes)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, first_word long, question_overlap double, answer_overlap double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = shared()
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1)):
                own = passage_matches(text.as_py(), indexes)
                rows += [i] * len(own)
                found += own
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            kinds = (pa.int64() if item_kind == "bigint" else None, pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["doc_id", "item_id", "first_word", "question_overlap", "answer_overlap"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(tidy(run), schema)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, question_overlap, answer_overlap): a row for each item verified in a document."""
    bounded_batches(docs.sparkSession)
    kind = benchmark.schema[item_id].dataType.simpleString()
    parts = [_contaminated(docs, indexes, id_col, text_col, kind) for indexes in shards(benchmark, item_id, item_text)]
    if not parts:
        schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {kind}, first_word long, question_overlap double, answer_overlap double"
        return docs.sparkSession.createDataFrame([], schema)
    if len(parts) == 1:
        return parts[0]
    out = staged(parts[0])
    for part in parts[1:]:
        out = out.unionByName(staged(part))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no item is verified, with their columns; filtered as they are read, without a join."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = docs.schema
    for indexes in shards(benchmark, item_id, item_text):
        shared = shared_value(docs.sparkSession, indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes = shared()
            for batch in batches:
                clean = [not passage_matches(t.as_py(), indexes) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(tidy(run), schema)
    return docs
