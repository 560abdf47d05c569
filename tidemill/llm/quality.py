"""Quality rules by weak supervision.

Each rule votes good or bad on a document, or abstains. Expectation-maximisation estimates, from
the counts of vote patterns over all documents, how often each rule is right about good and about
bad documents; the posterior probability of being good then decides, so one rule alone rejects a
document only if it has shown to be reliable. The driver sees the vote patterns (at most three to
the power of the number of rules), whatever the number of documents.

Cases: a null or empty text has no words and fails the base rule; equal rows get equal results;
the fit on an empty table returns its starting point; other columns pass through or are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import bounded_batches, free_names, staged, tidy

#: ASCII white space and the characters that count as symbols.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
GRAM = 5
#: The share of good documents on which a rule may vote bad. Rules that see different kinds of bad
#: documents seldom vote together; without the bound EM would take the rarer kinds for good ones.
MOST_FALSE_ALARMS = 0.01
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_distinct", "n_bars"]


def repeated_words(words: list[bytes]) -> int:
    """Words in 5-word windows that occur twice or more."""
    n = len(words) - GRAM + 1
    if n < 2:
        return 0
    hashed = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    likely = np.unique(np.concatenate((order[1:][same], order[:-1][same]))).tolist()
    windows = [tuple(words[i : i + GRAM]) for i in likely]
    times = Counter(windows)
    covered = np.zeros(len(words), dtype=bool)
    for i, window in zip(likely, windows, strict=True):
        if times[window] > 1:
            covered[i : i + GRAM] = True
    return int(covered.sum())


def features(text: str | None) -> tuple[int, ...]:
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        text.count("!"),
        len(set(words)),
        words.count(b"|"),
    )


def with_features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, name: str = "f") -> DataFrame:
    """The columns `keep` of docs (all by default) and the features of each text, in a column of that name."""
    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias(free_names(keep, "own_text")[0]))
    kind = pa.struct([(n, pa.int64()) for n in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x.as_py()) for x in batch.column(len(keep))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(FEATURES)
            found = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], names=[*keep, name])

    schema = T.StructType([docs.schema[c] for c in keep]).add(name, T.StructType([T.StructField(n, T.LongType()) for n in FEATURES]))
    return source.mapInArrow(tidy(run), schema)


def rules(name: str = "f") -> dict[str, F.Column]:
    """Votes over the column of features: 1 good, 0 bad, null no vote."""
    f = lambda n: F.col(f"{name}.{n}").cast("double")
    share = lambda a, b: f(a) / F.greatest(f(b), F.lit(1.0))
    vote = lambda bad, good=None: F.when(bad, 0).otherwise(F.when(good, 1) if good is not None else F.lit(None).cast("int"))
    return {
        "symbols": vote(share("n_symbols", "n_words") >= 0.1),
        "bars": vote(share("n_bars", "n_words") >= 0.1),
        "capitals": vote(share("n_upper", "word_chars") >= 0.3),
        "exclamations": vote(share("n_bangs", "n_words") >= 0.1),
        "repeats": vote(share("n_repeat_words", "n_words") >= 0.15),
        "same_lines": vote((share("n_dup_lines", "n_lines") >= 0.35) & (f("n_dup_lines") >= 2)),
        "word_length": vote((share("word_chars", "n_words") < 2.5) | (share("word_chars", "n_words") > 12), share("word_chars", "n_words").between(4, 7)),
        "vocabulary": vote((share("n_distinct", "n_words") < 0.2) & (f("n_words") < 2000), share("n_distinct", "n_words") >= 0.35),
    }


@dataclass(frozen=True)
class Accuracies:
    """Prior of good, and for each rule the probabilities of (bad, good, no) vote on good and on bad documents."""

    prior: float
    on_good: tuple[tuple[float, float, float], ...]
    on_bad: tuple[tuple[float, float, float], ...]

    def posterior(self, votes: list[F.Column]) -> F.Column:
        """The probability of being good, as an expression over the votes."""
        total = F.lit(float(np.log(self.prior) - np.log1p(-self.prior)))
        for vote, g, b in zip(votes, self.on_good, self.on_bad, strict=True):
            bad, good, none = (float(np.log(x / y)) for x, y in zip(g, b, strict=True))
            total = total + F.when(vote == 0, bad).when(vote == 1, good).otherwise(none)
        return 1 / (1 + F.exp(-total))


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], n_rules: int, rounds: int = 200) -> Accuracies:
    """EM over (votes, count) pairs.

    It starts from rules that seldom vote bad on good documents and each see a part of the bad
    ones; pseudo-counts keep every probability inside (0, 1).
    """
    start_good, start_bad = np.array([0.001, 0.6, 0.399]), np.array([0.15, 0.45, 0.4])
    prior, g, b = 0.85, np.tile(start_good, (n_rules, 1)), np.tile(start_bad, (n_rules, 1))
    if patterns:
        votes = np.array([[2 if v is None else v for v in p] for p, _ in patterns])
        n = np.array([c for _, c in patterns], dtype=float)
        shares = np.stack([[n[votes[:, j] == v].sum() for v in range(3)] for j in range(n_rules)]) / n.sum()
        for table, bad in ((g, start_good[0]), (b, start_bad[0])):
            rest = shares[:, 1:] + 1e-3
            table[:] = np.column_stack((np.full(n_rules, bad), (1 - bad) * rest / rest.sum(1, keepdims=True)))
        seen = np.stack([votes == v for v in range(3)], axis=2).astype(float)
        for _ in range(rounds):
            llr = (seen * np.log(g / b)).sum(axis=(1, 2))
            good = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + llr)))
            old = np.concatenate(([prior], g.ravel(), b.ravel()))
            prior = float(((n * good).sum() + 1.7) / (n.sum() + 2))
            g = (seen * (n * good)[:, None, None]).sum(0) + 2 * start_good
            b = (seen * (n * (1 - good))[:, None, None]).sum(0) + 2 * start_bad
            g, b = g / g.sum(1, keepdims=True), b / b.sum(1, keepdims=True)
            most = np.minimum(g[:, 0], MOST_FALSE_ALARMS)
            g = np.column_stack((most, g[:, 1:] * ((1 - most) / g[:, 1:].sum(1))[:, None]))
            if np.allclose(old, np.concatenate(([prior], g.ravel(), b.ravel())), atol=1e-9):
                break
    rows = lambda t: tuple(tuple(map(float, r)) for r in t)
    return Accuracies(prior, rows(g), rows(b))


def fit(featured: DataFrame) -> Accuracies:
    """Accuracies from the vote patterns of all rows of a frame with the column f."""
    named = rules()
    counted = featured.select(*[v.alias(k) for k, v in named.items()]).groupBy(*named).count().collect()
    patterns = [(tuple(r[k] for k in named), r["count"]) for r in counted]
    patterns.sort(key=lambda p: tuple(-1 if v is None else v for v in p[0]))
    return estimate(patterns, len(named))


def base_failed(name: str = "f") -> F.Column:
    words = F.col(f"{name}.n_words")
    return (words < 10) | (100 * F.col(f"{name}.n_repeat_words") > 20 * words)


def is_kept(accuracies: Accuracies, name: str = "f") -> F.Column:
    return ~base_failed(name) & (accuracies.posterior(list(rules(name).values())) >= 0.5)


def judge(featured: DataFrame, accuracies: Accuracies) -> DataFrame:
    """featured with p_good, base_failed and kept."""
    return featured.withColumns({"p_good": accuracies.posterior(list(rules().values())), "base_failed": base_failed(), "kept": is_kept(accuracies)})


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f, p_good, base_failed, kept) of every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    featured = staged(with_features(own, "text", ["doc_id"]))
    return judge(featured, fit(featured))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their columns.

    The texts are read twice rather than joined to their verdicts, which would shuffle them.
    """
    accuracies = fit(with_features(docs, text_col, []))
    (name,) = free_names(docs.columns, "f")
    return with_features(docs, text_col, name=name).where(is_kept(accuracies, name)).drop(name)
