"""Toxicity by a classifier chain.

Categories are predicted in a fixed order by linear models over hashed features of a text: its
distinct words, and the words and word beginnings that it repeats densely. Each model also sees the
probabilities of the categories before it. Categories are expressions over the labels, so any number of labelled ones
can be chained; the given labels hold two, junk (a quality of 0) and then toxic, and no word is named in the code. In training those probabilities are
out-of-fold: each row's come from models that were fitted without it, so that a later model learns
from them what it will meet in use. Words that tell the classes apart are
picked by the standard error of their log odds, and models fitted by Newton's method on a bounded
sample of labelled rows (`max_rows`, the rows of the smallest id hashes) and applied to all rows.

Cases: a null text counts as an empty one and gets the models' intercepts; labels without a
document are left out; a category without both classes in the sample gets its share as a constant;
equal texts get equal results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import bounded_batches, shared_value, tidy

BUCKETS = 1 << 18
#: Rows that the models are fitted on at most, and documents a bucket must occur in to be a feature.
MAX_ROWS, LEAST_DOCS = 6000, 4
FOLDS, STEPS, L2 = 3, 30, 1.0
#: Standard errors by which a word's log odds have to differ between the classes.
LEAST_Z = 3.0
#: Probability from which a document counts as toxic.
THRESHOLD = 0.3
WORD = re.compile(r"[^\W_]+")
#: Lengths of word beginnings; and the count and share of words from which one is dense.
BEGINNINGS, DENSE_COUNT, DENSE_SHARE = (5, 6), 2, 0.008


def bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode()) % BUCKETS


def counted_features(word: str) -> list[str]:
    """What a word counts for: itself and its beginnings."""
    return ["=" + word, *("^" + word[:k] for k in BEGINNINGS if len(word) >= k)]


def is_dense(count: int, n_words: int) -> bool:
    return count >= DENSE_COUNT and count >= DENSE_SHARE * n_words


def buckets_of(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the features of a text."""
    words = WORD.findall((text or "").lower())
    times = Counter(f for w in words for f in counted_features(w))
    found = {bucket(w) for w in words} | {bucket(f) for f, c in times.items() if is_dense(c, len(words))}
    return np.array(sorted(found), dtype=np.int64)


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    intercept: float
    earlier: np.ndarray

    def margin(self, words: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
        return words + self.intercept + (probabilities @ self.earlier if len(self.earlier) else 0.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """Rows of distinct columns, sparse."""

    def __init__(self, rows: list[np.ndarray], n_columns: int):
        self.rows, self.n_columns = rows, n_columns
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.columns = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.of = np.repeat(np.arange(len(rows)), self.sizes)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights[self.columns], len(self.rows))

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, errors[self.of], self.n_columns)

    def take(self, at: np.ndarray) -> Rows:
        return Rows([self.rows[i] for i in at.tolist()], self.n_columns)


def telling(rows: Rows, y: np.ndarray) -> np.ndarray:
    """The columns whose log odds differ between the classes by LEAST_Z standard errors."""
    n1, n0 = y.sum(), len(y) - y.sum()
    c1 = rows.back(y)
    c0 = rows.back(1 - y)
    odds = np.log((c1 + 0.5) / (n1 - c1 + 0.5)) - np.log((c0 + 0.5) / (n0 - c0 + 0.5))
    error = np.sqrt(1 / (c1 + 0.5) + 1 / (n1 - c1 + 0.5) + 1 / (c0 + 0.5) + 1 / (n0 - c0 + 0.5))
    return np.abs(odds) >= LEAST_Z * error


def fit_linear(rows: Rows, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression with an L2 penalty on the telling columns and the earlier probabilities."""
    n, k = len(y), earlier.shape[1]
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Linear(np.zeros(rows.n_columns), start, np.zeros(k))
    use = telling(rows, y)
    inside = use[rows.columns]
    dense = np.zeros((n, int(use.sum()) + k))
    dense[rows.of[inside], (np.cumsum(use) - 1)[rows.columns[inside]]] = 1
    dense[:, dense.shape[1] - k :] = earlier
    w, b = np.zeros(dense.shape[1]), start
    for _ in range(STEPS):  # Newton's method
        p = sigmoid(dense @ w + b)
        h = p * (1 - p)
        x = np.column_stack((dense, np.ones(n)))
        hessian = (x * h[:, None]).T @ x + np.diag([L2] * len(w) + [1e-6])
        step = np.linalg.solve(hessian, np.append(dense.T @ (p - y) + L2 * w, (p - y).sum()))
        w, b = w - step[:-1], b - step[-1]
        if np.abs(step).max() < 1e-3:
            break
    weights = np.zeros(rows.n_columns)
    weights[use] = w[: len(w) - k]
    return Linear(weights, float(b), w[len(w) - k :])


def fit_chain(rows: Rows, labels: np.ndarray) -> list[Linear]:
    """One model a column of labels, in order; earlier categories enter as out-of-fold probabilities."""
    n = len(rows.rows)
    fold = np.arange(n) % FOLDS
    seen = np.zeros((n, 0))
    chain = []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        chain.append(fit_linear(rows, seen, y))
        if k + 1 < labels.shape[1]:
            out = np.zeros(n)
            for f in range(FOLDS if n else 0):
                inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                part = fit_linear(rows.take(inside), seen[inside], y[inside])
                out[outside] = sigmoid(part.margin(rows.take(outside).times(part.weights), seen[outside]))
            seen = np.column_stack((seen, out))
    return chain


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str, text_col: str, max_rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(buckets, labels) of at most max_rows rows; categories are expressions over labels and the text as `text`."""
    bounded_batches(docs.sparkSession)
    chosen = labels.orderBy(F.xxhash64(id_col), id_col).limit(max_rows).dropDuplicates([id_col])
    joined = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    flat = joined.select("text", F.col(id_col).cast("long").alias("id"), *[c.cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())])
    names = [f"y{k}" for k in range(len(categories))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([buckets_of(t.as_py()) for t in batch.column(0)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], names=["id", *names, "buckets"])

    rows = flat.mapInArrow(tidy(run), "id long, " + ", ".join(f"{n} int" for n in names) + ", buckets array<int>").toArrow().sort_by("id").to_pydict()
    y = np.array([[x or 0 for x in rows[n]] for n in names], dtype=np.int64).T.reshape(-1, len(names))
    return [np.array(b or [], dtype=np.int64) for b in rows["buckets"]], y


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, list[Linear]]:
    """(column of each bucket, chain); buckets without weight share column 0."""
    found, y = labelled_sample(docs, labels, categories, id_col, text_col, max_rows)
    times = np.bincount(np.concatenate(found) if found else np.zeros(0, np.int64), minlength=BUCKETS)
    used = np.flatnonzero(times >= LEAST_DOCS)
    column = np.zeros(BUCKETS, np.int32)
    column[used] = np.arange(1, len(used) + 1)
    rows = Rows([c[c > 0].astype(np.int64) for c in (column[b] for b in found)], len(used) + 1)
    chain = fit_chain(rows, y)
    weighty = np.flatnonzero(np.any([m.weights != 0 for m in chain], axis=0))
    narrow = np.zeros(len(used) + 1, np.int32)
    narrow[weighty] = np.arange(1, len(weighty) + 1)
    return narrow[column], [Linear(np.concatenate(([0.0], m.weights[weighty])), m.intercept, m.earlier) for m in chain]


class Columns(dict):
    """For a word: (column of the word, columns of what it counts for), or None if there are none; remembered."""

    def __init__(self, column: np.ndarray):
        super().__init__()
        self.column = column

    def __missing__(self, word: str) -> tuple[int, tuple[int, ...]] | None:
        own = int(self.column[bucket(word)])
        counted = tuple(c for f in counted_features(word) if (c := int(self.column[bucket(f)])))
        value = self[word] = (own, counted) if own or counted else None
        return value

    def of_text(self, text: str | None) -> set[int]:
        words = WORD.findall((text or "").lower())
        hits = [x for x in map(self.__getitem__, words) if x]
        if len(self) > 1 << 19:
            self.clear()
        times = Counter(c for _, counted in hits for c in counted)
        return {own for own, _ in hits if own} | {c for c, n in times.items() if is_dense(n, len(words))}


def predict(docs: DataFrame, column: np.ndarray, chain: list[Linear], names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category>...) of every row."""
    bounded_batches(docs.sparkSession)
    shared = shared_value(docs.sparkSession, (column, chain))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, chain = shared()
        known = Columns(column)
        weights = np.column_stack([m.weights for m in chain])
        for batch in batches:
            sums = np.zeros((batch.num_rows, len(chain)))
            for i, text in enumerate(batch.column(1)):
                if hit := known.of_text(text.as_py()):
                    sums[i] = weights[np.fromiter(hit, np.int64, len(hit))].sum(axis=0)
            seen = np.zeros((batch.num_rows, 0))
            for k, model in enumerate(chain):
                seen = np.column_stack((seen, sigmoid(model.margin(sums[:, k], seen))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(seen[:, k].copy()) for k in range(len(chain)))], names=["doc_id", *(f"p_{n}" for n in names)])

    schema = f"doc_id {kind}, " + ", ".join(f"p_{n} double" for n in names)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(tidy(run), schema)


def toxic_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, p_junk, p_toxic, toxic) of every row."""
    categories = {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    column, chain = train(docs, labels, categories, max_rows=max_rows)
    return predict(docs, column, chain, list(categories)).withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
