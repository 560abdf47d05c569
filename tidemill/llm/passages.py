"""Passages of words that another text holds too: runs of a given number of words, whatever blanks stand between them.

Every window of so many words has an anchor: of its runs of 8 words the one with the smallest hash,
the leftmost of equal ones. Equal windows have equal anchors, so windows are compared only within the group
of their anchor. Texts whose anchors no other text has are dropped before any text is read again. Of the
rest, a row is a run of windows with one anchor; equal rows of a task are told there and dealt once, so
a group receives a row a task and different run, however many texts hold it. Runs of an anchor that many texts
have differ at the ends of the passage, so their windows are dealt by their own hashes too.

Cases: words are `[^\\x20\\x09-\\x0D]+`, cut at the ends of a text; a null text has none; texts with fewer words
have no windows. Windows never cross texts. Words, windows and texts are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import staged, tidy
from tidemill.llm.linking import _by_key, _pair_names, _runs

GRAM_WORDS = 8
#: An anchor of so many texts is hot; its windows are dealt to so many groups, a power of two.
HOT_TEXTS, SPLIT = 256, 64
#: Bytes and windows looked at together, bits of an anchor's place in them, bytes of a word that is hashed with others, and runs that a task remembers.
BYTES, WINDOWS, PLACE_BITS, LONG, REMEMBERED = 1 << 17, 1 << 20, 24, 1 << 14, 1 << 19
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
#: A random number a byte, 0 for blanks; a word's hash is their sum, weighted by powers of an odd number from the word's start on.
VALUES = np.where(BLANK, 0, np.random.default_rng(8).integers(1, 1 << 63, 256)).astype(np.uint64)
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of BASE and of its inverse."""
    if not _powers:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            each = np.full(BYTES + LONG, base, np.uint64)
            each[0] = 1
            _powers.append(np.multiply.accumulate(each))
    return _powers


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text's number) of each word of all texts."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    n = int(bounds[-1] - bounds[0])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data, bounds = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]
    blank = BLANK[data]
    border = np.zeros(n + 1, bool)
    border[bounds] = True
    starts = np.flatnonzero(~blank & (border[:-1] | np.concatenate(([True], blank[:-1]))))
    ends = np.flatnonzero(~blank & (border[1:] | np.concatenate((blank[1:], [True])))) + 1
    up, down = powers()
    hashes = np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, n + BYTES, BYTES))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a < b:
            part = data[k * BYTES : (k + 1) * BYTES + LONG]
            sums = np.concatenate((VALUES[part] * up[: len(part)], np.zeros(1, np.uint64)))
            edges = np.column_stack((starts[a:b], np.minimum(ends[a:b], k * BYTES + len(part)))).ravel() - k * BYTES
            hashes[a:b] = np.add.reduceat(sums, edges)[::2] * down[edges[::2]]
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    hashes = (hashes ^ (hashes >> np.uint64(32))) * ODD[1]
    return hashes ^ (hashes >> np.uint64(29)), np.searchsorted(bounds, starts, "right") - 1


def _both(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    h = ((a * ODD[k % 6]) ^ (b + (b >> np.uint64(23)))) * ODD[(k + 1) % 6]
    return h ^ (h >> np.uint64(31))


def windows(texts: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, hash of the anchor, hash) of each window, in order and some at a time."""
    every, of = word_hashes(texts)
    for base in range(0, max(0, len(every) - words + 1), WINDOWS):
        part, text = every[base : base + WINDOWS + words - 1], of[base : base + WINDOWS + words - 1]
        n = len(part) - words + 1
        whole, used, piece, width, grams = None, 0, part, 1, part
        while True:
            if words & width:
                whole = piece[:n] if whole is None else _both(whole, piece[used : used + n], 7 + width.bit_length())
                used += width
            if width * 2 > words:
                break
            piece = _both(piece[:-width], piece[width:], width.bit_length())
            width *= 2
            grams = piece if width == min(GRAM_WORDS, 1 << words.bit_length() - 1) else grams
        span = words - (len(part) - len(grams) + 1) + 1
        least, width = (grams & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(grams), dtype=np.uint64), 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[span - width : span - width + n])
        own = text[:n] == text[words - 1 :]
        yield text[:n][own], grams[(least[own] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)].view(np.int64), whole[own]


def _first(text: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Starts of the runs of windows of one text and anchor."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(gram)), bool), (gram[1:] != gram[:-1]) | (text[1:] != text[:-1]))))


def anchor_lists(texts: pa.Array, new: np.ndarray, words: int) -> tuple[pa.Array, pa.Array]:
    """For each text its different anchors, none where it isn't new, and whether it has a window."""
    found = [(t[at], g[at]) for t, g, _ in windows(texts, words) for at in [_first(t, g)]]
    text, gram = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    wordy = np.zeros(len(texts), bool)
    wordy[text] = True
    text, gram = text[new[text]], gram[new[text]]
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    at = _first(text, gram)
    ends = np.cumsum(np.bincount(text[at], minlength=len(texts)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(gram[at], pa.int64())), pa.array(wordy)


def shared_anchors(table: DataFrame) -> DataFrame:
    """(name, grams, hot) of the texts of table(name, word_grams) with anchors that another text has too; hot are those of many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in _runs(batches):
            names = rows.column(1).to_numpy()
            shared = np.minimum.reduceat(names, starts) != np.maximum.reduceat(names, starts)
            shared, hot = np.repeat(shared, ends - starts), np.repeat(ends - starts >= HOT_TEXTS, ends - starts)
            kept = rows.filter(pa.array(shared))
            yield pa.RecordBatch.from_arrays([kept.column(1), kept.column(0), pa.array(hot[shared])], names=["name", "gram", "hot"])

    each = table.select(F.explode("word_grams").alias("gram"), "name")
    return _by_key(each, "gram").mapInArrow(tidy(run), "name long, gram long, hot boolean").groupBy("name").agg(F.collect_list("gram").alias("grams"), F.collect_list(F.when(F.col("hot"), F.col("gram"))).alias("hot"))


def window_rows(candidates: DataFrame, words: int) -> DataFrame:
    """Of the windows with shared anchors of candidates(name, data, grams, hot), two kinds of rows: runs (gram, name, windows), and names alone
    of texts that hold a run that another text of the task holds too. A run of a hot anchor is cut by its windows' last bits."""

    def pairs(lists: pa.ListArray) -> np.ndarray:
        return _pair_names(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy())


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], int] = {}
        told: set[int] = set()
        for batch in batches:
            names, wanted, hot = batch.column(0).to_numpy(), pairs(batch.column(2)), pairs(batch.column(3))
            out: list[tuple[int | None, int, bytes | None]] = []
            for text, gram, window in windows(batch.column(1), words):
                at = _first(text, gram)
                ends = np.append(at[1:], len(gram))
                pair = _pair_names(text[at], gram[at])
                keep = np.isin(pair, wanted)
                many = np.isin(pair[keep], hot)
                for a, b, g, name, cut in zip(at[keep].tolist(), ends[keep].tolist(), gram[at[keep]].tolist(), names[text[at[keep]]].tolist(), many.tolist(), strict=True):
                    run_of = np.unique(window[a:b]) if b - a > 256 else window[a:b]
                    if cut:
                        last = run_of & np.uint64(SPLIT - 1)
                        kinds = np.unique(last)
                        parts = zip(_pair_names(np.full(len(kinds), g), kinds).tolist(), (run_of[last == k].tobytes() for k in kinds), strict=True)
                    else:
                        parts = ((g, run_of.tobytes()),)
                    for key, own in parts:
                        if (first := seen.setdefault((key, xxhash.xxh3_128_digest(own)), name)) != name:
                            told |= {first, name}
                            continue
                        out.append((key, name, own))
                        if len(seen) > REMEMBERED:
                            seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["gram", "name", "windows"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(told), pa.int64()), pa.array(sorted(told), pa.int64()), pa.nulls(len(told), pa.binary())], names=["gram", "name", "windows"])

    return candidates.select("name", "data", "grams", "hot").mapInArrow(tidy(run), "gram long, name long, windows binary")


def sharing(found: DataFrame) -> DataFrame:
    """The names of texts with a window that another text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in _runs(batches):
            rows = rows.filter(pa.array(np.repeat(ends - starts > 1, ends - starts)))
            if not rows.num_rows:
                continue
            bounds = np.frombuffer(rows.column(2).buffers()[1], np.int32)[rows.column(2).offset : rows.column(2).offset + rows.num_rows + 1]
            sizes = np.diff(bounds) // 8
            each = np.frombuffer(rows.column(2).buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(np.int64)
            each = _pair_names(np.repeat(rows.column(0).to_numpy(), sizes), each)
            order = np.argsort(each)
            each, names = each[order], np.repeat(rows.column(1).to_numpy(), sizes)[order]
            at = np.concatenate(([0], np.flatnonzero(each[1:] != each[:-1]) + 1))
            shared = np.minimum.reduceat(names, at) != np.maximum.reduceat(names, at)
            told = np.unique(names[np.repeat(shared, np.diff(np.append(at, len(each))))])
            yield pa.RecordBatch.from_arrays([pa.array(told)], names=["name"])

    grouped = _by_key(found.where("gram is not null"), "gram").mapInArrow(tidy(run), "name long")
    return grouped.unionByName(found.where("gram is null").select("name")).distinct()


def sharing_texts(table: DataFrame, texts: DataFrame, words: int, broadcast: int) -> DataFrame:
    """(name) of the texts(name, data) that share a window with another; table(name, word_grams) has their anchors, up to `broadcast` names are broadcast."""
    shared = staged(shared_anchors(table))
    names = shared.select(F.col("name").alias("wanted"))
    names = F.broadcast(names) if shared.count() <= broadcast else names
    candidates = texts.join(names, F.col("name") == F.col("wanted"), "left_semi").join(shared, "name")
    return sharing(staged(window_rows(candidates, words)))
