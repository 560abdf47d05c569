"""Suffix-array dedup: byte strings of a given length that start in more than one place.

In a task, suffixes are sorted by prefix doubling. The previous and next smaller positions in
suffix order are each position's closest earlier relatives, and the longer of its matches with the
two is its longest previous factor: a string of LENGTH bytes has occurred earlier where that
factor is LENGTH or longer, and the place it was found at holds the earlier copy.

Over a corpus, every string of LENGTH bytes has an anchor: of its 64-byte grams the one with the
smallest hash, the leftmost of equal ones. Equal strings have their anchors at the same offset, so
strings are compared only within the group of their anchor's gram. A group gets the contexts of
its anchors, which are the runs of strings that share an anchor; texts whose anchors nobody shares
are dropped before any text is read again. Equal contexts are counted in each task before they are
dealt, so a group receives a row a task and different context, however often it occurs; what it
finds is joined back to the places of the contexts. A group larger than SORT_BYTES is taken apart
by the bytes that all strings at some distances from the anchor share, down to single strings.

By default all copies of a string are covered; with `keep_first` the copy of the smallest
(doc_id, position) stays. Matches never cross documents, and are judged on the input. With
`passage_words` a column also tells which documents hold a passage of so many words that another one
holds too (`passages`): it may have fewer bytes than LENGTH, and a text's own repeats don't count.

Cases: a null text counts as an empty one; texts shorter than LENGTH have no strings; equal texts
of LENGTH bytes or more are one class from the start and are covered whole; texts of any length
are read in segments; rows without an id keep a null id; other columns are ignored; an empty table
gives an empty result. Equal texts and contexts are told by digests of 128 bits or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import passages
from tidemill.llm.common import bounded_batches, lookup, staged, temporary, tidy
from tidemill.llm.linking import _by_key, _runs

LENGTH, GRAM = 400, 64
#: Bytes of a text hashed at a time, and bits of an anchor's place in them.
SEGMENT, PLACE_BITS = 1 << 20, 24
#: Bytes of contexts whose suffixes are sorted at once, and bytes of contexts that a task counts before it passes them on.
SORT_BYTES, COUNT_BYTES = 1 << 21, 1 << 25
#: Bytes of contexts of several groups that are sorted together; strings of different groups differ.
TOGETHER = 1 << 16
BROADCAST_DIGESTS = 1_000_000
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


# --- suffix arrays ----------------------------------------------------------------------------------------------


def suffix_order(data: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(suffix order, levels) by the first `length` values, all below 511; suffixes with equal prefixes stand by position.

    Each level has a width and a name of all places by the values of that width, from width 4 on their ranks; the end of
    the data counts as smaller than any. Places whose prefix nobody shares are settled and aren't sorted again.
    """
    n = len(data)
    names, done, bits = data.astype(np.int64) + 1, 1, n.bit_length()
    levels = [(1, names)]
    while done < min(4, length):
        step = min(done, length - done)
        after = np.zeros(n, np.int64)
        after[: max(0, n - done)] = (names if step == done else levels[0][1])[done:]
        names, done = (names << 9 * step) | after, done + step
        levels.append((done, names))
    order, slots, ranks = np.argsort(names, kind="stable"), np.arange(n), names
    at, pairs = order, names[order]
    while n:
        new = np.concatenate(([True], pairs[1:] != pairs[:-1]))
        ranks = ranks.copy()
        ranks[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] + 1
        levels.append((done, ranks))
        slots = slots[~(new & np.concatenate((new[1:], [True])))]
        if done == length or not len(slots):
            break
        step, at = min(done, length - done), order[slots]
        after = np.where(at + step < n, ranks[np.minimum(at + step, n - 1)], 0)
        if 3 * bits < 64:
            keys = np.sort((ranks[at] << 2 * bits) | (after << bits) | at)
            at, pairs = keys & ((1 << bits) - 1), keys >> bits
        else:
            pairs = ranks[at] * (n + 1) + after
            sort = np.argsort(pairs, kind="stable")
            at, pairs = at[sort], pairs[sort]
        order[slots], done = at, done + step
    return order, levels


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the closest one before it with a smaller value, or -1: all between are larger, so pointers may be followed at once."""
    to = np.arange(len(values)) - 1
    left = np.flatnonzero(to >= 0)
    left = left[values[to[left]] > values[left]]
    while len(left):
        to[left] = to[to[left]]
        left = left[to[left] >= 0]
        left = left[values[to[left]] > values[left]]
    return to


def longest_previous_factors(data: np.ndarray, length: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, sources): for each position the longest match with an earlier one, up to `length`, and that position (-1 for none).

    With `whole` matches shorter than `length` count as none; only places that share all of it are looked at then.
    """
    n = len(data)
    order, levels = suffix_order(data, length)
    lengths, sources = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if whole:
        if levels[-1][0] < length:
            return lengths, sources
        levels = levels[-1:]
        same = levels[0][1][order[1:]] == levels[0][1][order[:-1]]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if n else order
    padded = [(width, np.concatenate((ranks, [0]))) for width, ranks in reversed(levels)]
    for to, at in ((previous_smaller(order), order), (previous_smaller(order[::-1]), order[::-1])):
        here = at[to >= 0]
        there = at[to[to >= 0]]
        match = np.zeros(len(here), np.int64)
        for width, ranks in padded:
            same = (match + width <= length) & (ranks[np.minimum(here + match, n)] == ranks[np.minimum(there + match, n)])
            match[same] += width
        longer = match > lengths[here]
        lengths[here[longer]], sources[here[longer]] = match[longer], there[longer]
    return lengths, sources


# --- anchors ----------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 64 bytes from each place on, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * ODD[0]
    for k, step in enumerate((1, 2, 4, 8, 16, 32)):
        h = (h[:-step] * ODD[k]) ^ (h[step:] + (h[step:] >> np.uint64(23)))
        h *= ODD[(k + 1) % 6]
    return h ^ (h >> np.uint64(31))


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place, first string, last string) of each anchor of a text; strings are told by their starts."""
    grams, found = length - GRAM + 1, []
    for base in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        h = gram_hashes(part)
        keys = (h & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        least, width = keys, 1
        while width * 2 <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        n = len(h) - grams + 1
        least = np.minimum(least[:n], least[grams - width : grams - width + n])
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.concatenate((first[1:], [n])) - 1
        place = (least[first] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        found.append((h[place].view(np.int64), place + base, first + base, last + base))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchor_table(docs: DataFrame, id_col: str, text_col: str, length: int, words: int = 0) -> DataFrame:
    """(doc_id, digest, n_bytes, grams) of every row; for a text's first row in a task the distinct grams of its anchors.

    Each is told with whether the text has it more than once, so that a text that repeats itself is one row a gram.
    With `words` also (word_grams, wordy): the anchors of its windows of words, and whether it has one.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        known: set[bytes] = set()
        for batch in batches:
            digests, sizes, grams, first = [], [], [], []
            for text in batch.column(1):
                data = text.as_buffer() if text.is_valid else b""
                digest = hashlib.sha256(data).digest()
                digests.append(digest)
                sizes.append(len(data))
                first.append(digest not in known)
                known.add(digest)
                new = len(data) >= length and digest not in seen
                if new:
                    seen.add(digest)
                if not new:
                    grams.append(None)
                    continue
                each, times = np.unique(anchors(np.frombuffer(data, np.uint8), length)[0], return_counts=True)
                grams.append([{"gram": g, "often": t} for g, t in zip(each.tolist(), (times > 1).tolist(), strict=True)])
            kind_of = pa.list_(pa.struct([("gram", pa.int64()), ("often", pa.bool_())]))
            more = passages.anchor_lists(batch.column(1), np.array(first), words) if words else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(grams, kind_of), *more], names=["doc_id", "digest", "n_bytes", "grams", "word_grams", "wordy"][: 4 + len(more)])

    schema = f"doc_id {kind}, digest binary, n_bytes long, grams array<struct<gram:long,often:boolean>>" + ", word_grams array<long>, wordy boolean" * bool(words)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(tidy(run), schema)


def shared_anchors(table: DataFrame) -> DataFrame:
    """(digest, grams) of the grams that are another anchor's too, in the same text or in another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in _runs(batches):
            shared = np.repeat(ends - starts > 1, ends - starts) | rows.column(2).to_numpy(zero_copy_only=False)
            kept = rows.filter(pa.array(shared))
            yield pa.RecordBatch.from_arrays([kept.column(1), kept.column(0)], names=["digest", "gram"])

    each = table.where("grams is not null").select("digest", F.explode("grams").alias("a")).select(F.col("a.gram").alias("gram"), "digest", F.col("a.often").alias("often"))
    return _by_key(each, "gram").mapInArrow(tidy(run), "digest binary, gram long").groupBy("digest").agg(F.collect_list("gram").alias("grams"))


def texts_by_digest(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """(digest, data) of the texts of at least `length` bytes, new in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, data = [], []
            for text in batch.column(0):
                own = text.as_py().encode() if text.is_valid else b""
                if len(own) >= length and (digest := hashlib.sha256(own).digest()) not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    data.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], names=["digest", "data"])

    return docs.select(text_col).mapInArrow(tidy(run), "digest binary, data binary")


CONTEXT_SCHEMA = "gram long, context_id binary, digest binary, starts array<long>, doc long, start long, times long, offset long, strings long, context binary"
CONTEXT_NAMES = [c.split()[0] for c in CONTEXT_SCHEMA.split(", ")]
CONTEXT_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def contexts(candidates: DataFrame, length: int) -> DataFrame:
    """Of the anchors of candidates(digest, doc, data, grams), two kinds of rows.

    Those with starts are the places of a context in a text. Those with a context are counts: how often
    it occurs in the task, and its first place there as (doc, digest, start).
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(CONTEXT_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, CONTEXT_TYPES, strict=True)], names=CONTEXT_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            for digest, doc, text, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = text.as_buffer()
                view = memoryview(data)
                found = anchors(np.frombuffer(data, np.uint8), length)
                keep = np.isin(found[0], grams.values.to_numpy())
                places: dict[bytes, tuple] = {}
                for g, p, a, b in zip(*[x[keep].tolist() for x in found], strict=True):
                    cut = view[a : b + length]
                    name = xxhash.xxh3_128_digest(cut, seed=(g ^ (p - a)) & 0x7FFFFFFFFFFFFFFF)
                    places.setdefault(name, (g, []))[1].append(a)
                    if (known := counts.get(name)) is None:
                        counts[name] = [g, doc, digest, a, 1, p - a, b - a + 1, bytes(cut)]
                        held += len(cut)
                    else:
                        known[4] += 1
                        if (known[1] is None, known[1] or 0, known[2], known[3]) > (doc is None, doc or 0, digest, a):
                            known[1:4] = doc, digest, a
                yield batch_of([(g, name, digest, starts, None, None, None, None, None, None) for name, (g, starts) in places.items()])
                if held > COUNT_BYTES:
                    yield batch_of([(g, name, d, None, doc_, a, *rest) for name, (g, doc_, d, a, *rest) in counts.items()])
                    counts, held = {}, 0
        yield batch_of([(g, name, d, None, doc_, a, *rest) for name, (g, doc_, d, a, *rest) in counts.items()])

    return candidates.select("digest", "doc", "data", "grams").mapInArrow(tidy(run), CONTEXT_SCHEMA)


def _marks(group: list[tuple[bytes, int, int]], length: int, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For contexts (data, offset, strings) in order: which strings occurred earlier, and which occur elsewhere too.

    The distances of the strings from their anchor are between low and high.
    """
    if len(group) == 1:
        return [(np.zeros(group[0][2], bool), np.zeros(group[0][2], bool))]
    total = sum(len(d) for d, _, _ in group) + len(group)
    if total <= SORT_BYTES:
        joined, at, starts = np.zeros(total, np.int16), 0, []
        for data, _, _ in group:
            joined[at : at + len(data)] = np.frombuffer(data, np.uint8)
            joined[at : at + len(data)] += 1
            starts.append(at)
            at += len(data) + 1
        lengths, sources = longest_previous_factors(joined, length, whole=True)
        own = np.zeros(total, bool)
        for s, (_, _, n) in zip(starts, group, strict=True):
            own[s : s + n] = True
        later = own & (lengths >= length)
        repeated = later.copy()
        repeated[sources[later]] = True
        return [(later[s : s + n], repeated[s : s + n]) for s, (_, _, n) in zip(starts, group, strict=True)]
    if low == high:  # all are one string
        return [(np.full(1, k > 0), np.ones(1, bool)) for k in range(len(group))]
    out = [(np.zeros(n, bool), np.zeros(n, bool)) for _, _, n in group]
    middle = (low + high) // 2
    for a, b in ((low, middle), (middle + 1, high)):
        classes: dict[bytes, dict[tuple[bytes, int, int], list[tuple[int, int]]]] = {}
        for k, (data, offset, n) in enumerate(group):
            first, last = max(0, offset - b), min(n - 1, offset - a)
            if first <= last:
                part = (data[first : last + length], offset - first, last - first + 1)
                core = data[offset - a : offset - b + length] if a < b else part[0]
                classes.setdefault(core, {}).setdefault(part, []).append((k, first))
        for parts in classes.values():
            for (part, places), (later, repeated) in zip(parts.items(), _marks(list(parts), length, a, b), strict=True):
                for nth, (k, first) in enumerate(places):
                    out[k][0][first : first + part[2]] |= later | (nth > 0)
                    out[k][1][first : first + part[2]] |= repeated | (len(places) > 1)
    return out


def _spans(flags: np.ndarray, length: int) -> list[int]:
    """Starts and ends, in turn, of the bytes that runs of flagged strings cover."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    edges[1::2] += length - 1
    return edges.tolist()


def repeated_in_contexts(found: DataFrame, length: int) -> DataFrame:
    """(gram, context_id, spans, first, first_spans) of the contexts with repeated strings, in bytes from a context's start.

    first is the context's first place, (digest, start), and first_spans what of it repeats an earlier place.
    """

    def told(groups: list[tuple[int, list]]) -> Iterator[tuple]:
        """Rows of groups (gram, contexts in order), which share no string, so that they can be sorted as one."""
        every = [(gram, *x) for gram, order in groups for x in order]
        marks = _marks([x[4] for x in every], length, 0, length - GRAM)
        for (gram, name, place, times, _), (later, repeated) in zip(every, marks, strict=True):
            if times > 1:
                repeated[:] = True
            if repeated.any():
                yield gram, name, _spans(repeated, length), place[2], place[3], _spans(later, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, firsts, ends in _runs(batches):
            columns = [rows.column(k).to_pylist() for k in range(1, 9)]
            out: list[tuple] = []
            waiting, held = [], 0
            for a, b in zip(firsts.tolist(), ends.tolist(), strict=True):
                counted: dict[bytes, list] = {}
                for name, digest, doc, start, times, offset, n, data in zip(*[c[a:b] for c in columns], strict=True):
                    place = (doc is None, doc or 0, digest, start)
                    known = counted.setdefault(name, [place, 0, (data, offset, n)])
                    known[0], known[1] = min(known[0], place), known[1] + times
                order = sorted(((name, *x) for name, x in counted.items()), key=lambda x: x[1])
                if len(order) == 1 and order[0][2] == 1:
                    continue
                gram, size = rows.column(0)[a].as_py(), sum(len(x[3][0]) + 1 for x in order)
                if len(order) == 1 or size > TOGETHER:
                    out.extend(told([(gram, order)]))
                    continue
                if held + size > min(TOGETHER, SORT_BYTES) and waiting:
                    out.extend(told(waiting))
                    waiting, held = [], 0
                waiting.append((gram, order))
                held += size
            out.extend(told(waiting))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.list_(pa.int64())]
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["gram", "context_id", "spans", "first_digest", "first_start", "first_spans"])

    counts = found.where("context is not null").select("gram", "context_id", "digest", "doc", "start", "times", "offset", "strings", "context")
    return _by_key(counts, "gram").mapInArrow(tidy(run), "gram long, context_id binary, spans array<long>, first_digest binary, first_start long, first_spans array<long>")


def repeated_spans(found: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(digest, starts, spans) of the places of contexts with repeated strings; spans are relative to each start."""
    places = found.where("starts is not null").select("context_id", "digest", "starts")
    told = repeated_in_contexts(found, length).drop("gram")
    joined = places.join(told, "context_id")
    if not keep_first:
        return joined.select("digest", "starts", "spans")
    first = (F.col("digest") == F.col("first_digest")) & F.array_contains("starts", F.col("first_start"))
    rest = joined.select("digest", F.when(first, F.array_remove("starts", F.col("first_start"))).otherwise(F.col("starts")).alias("starts"), "spans")
    return rest.unionByName(joined.where(first).select("digest", F.array("first_start").alias("starts"), F.col("first_spans").alias("spans")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut_texts(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256, spans) of the texts that lose bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, hashes, told = [], [], [], []
            for data, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cut = merged([(at + a, at + b) for x in own for at in x["starts"] for a, b in zip(x["spans"][::2], x["spans"][1::2], strict=True)])
                kept, at = hashlib.sha256(), 0
                for a, b in cut:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                removed.append(sum(b - a for a, b in cut))
                runs.append(len(cut))
                hashes.append(kept.hexdigest())
                told.append([x for pair in cut for x in pair])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(hashes), pa.array(told, pa.list_(pa.int64()))], names=["digest", "n_removed", "n_spans", "kept_sha256", "spans"])

    grouped = spans.groupBy("digest").agg(F.collect_list(F.struct("starts", "spans")).alias("own"))
    return candidates.select("digest", "data").join(grouped, "digest").mapInArrow(tidy(run), "digest binary, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def dedup_strings(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", passage_words: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans are the removed runs' starts and ends.

    With `passage_words` also shares_passage: whether so many words in a row stand in another row's text too.
    """
    with temporary(docs.sparkSession):
        return staged(_deduped(docs, length, keep_first, id_col, text_col, passage_words), keep=True)


def _deduped(docs: DataFrame, length: int, keep_first: bool, id_col: str, text_col: str, passage_words: int) -> DataFrame:
    table = staged(anchor_table(docs, id_col, text_col, length, passage_words))
    classes = staged(table.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.col("doc_id").cast("long")).alias("doc")))
    with temporary(docs.sparkSession):
        shared = staged(shared_anchors(table))
        small = shared.count() <= BROADCAST_DIGESTS
        hint = F.broadcast if small else (lambda df: df)
        texts = texts_by_digest(docs, text_col, length).join(hint(shared.select("digest")), "digest", "left_semi").dropDuplicates(["digest"])
        candidates = staged(texts.join(shared, "digest").join(classes.select("digest", "doc"), "digest"))
        found = staged(contexts(candidates, length))
        cut = staged(cut_texts(candidates, repeated_spans(found, length, keep_first)), keep=True)
    known = classes.join(cut, "digest", "left")
    told = []
    if passage_words:
        with temporary(docs.sparkSession):
            name = F.xxhash64("digest").alias("name")
            texts = texts_by_digest(docs, text_col, 2 * passage_words - 1).select(name, "data")
            sharing = staged(passages.sharing_texts(table.select(name, "word_grams"), texts, passage_words, BROADCAST_DIGESTS), keep=True)
        known = known.join(sharing.withColumn("shared", F.lit(True)), F.xxhash64("digest") == F.col("name"), "left").drop("name")
        told = [(F.col("wordy") & ((F.col("copies") > 1) | F.col("shared").isNotNull())).alias("shares_passage")]
    rows = lookup(table.select("doc_id", "digest", "n_bytes", *["wordy"][: len(told)]), staged(known), "digest", "copies", table.count())
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    if keep_first:
        copy = copy & ~F.col("doc_id").cast("long").eqNullSafe(F.col("doc"))
    whole = F.array(F.lit(0), F.col("n_bytes")).cast("array<long>")
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
        *told,
    )
