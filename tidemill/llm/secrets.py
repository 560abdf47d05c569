"""Secret scans [native]: three fixed kinds, and windows of high Shannon entropy.

Spans are code points, end exclusive. Their places come from the lengths of what stands between
the matches, since SQL's regular expressions return no positions.

The entropy kind slides a window over each candidate and updates the sum of c * log2(c) by the
counts of the character that leaves and the one that enters, in exact integers. A candidate is a
run of letters and digits, or a run of token characters with separators (+ / _ = -) among them; a
secret behind a separator is thus scored by its own alphabet too. A window has 24 characters, or all of a shorter
candidate of 16 at least. It is hot from an entropy that a window of random characters of the
candidate's alphabet falls below by chance once in some hundreds (`DEVIATIONS` below the mean).
Hot windows merge into spans. A span of one candidate that contains an allow-listed text, or is
part of one, is suppressed; the three fixed kinds never are.

Not scored, since their entropy is that of natural words: letters of a single case or capitalized,
below 24 characters; camel case, and words joined by separators. Digits alone are scored from 24.

Cases: a null text counts as an empty one; a text without matches gives zero counts, the hash of
the empty string and no spans; the cost of a candidate is linear in its length, and that of a
text's matches in their number; equal rows give equal results; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb, log2, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: kind: (pattern, group whose length counts, least length, what a text with such a match must match)
KINDS = {
    "assign": (ASSIGN, 2, 8, ASSIGN.replace("=-]+)", "=-]{8,})")),
    "access": (ACCESS, 0, 16, r"AKIA[A-Z0-9]{12,}"),
    "hex": (HEX, 0, 32, r"[0-9a-f]{32,}"),
}
#: Characters of a window, and of the shortest candidate.
WINDOW, LEAST = 24, 16
#: Standard deviations below the mean entropy of random characters at which a window is hot.
DEVIATIONS = 3.5
RUN = r"[A-Za-z0-9]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: Texts that look like words, which no random token does. None repeats a group, which Java's
#: expressions would do by recursion: letters in camel case; and words of letters joined by separators.
CAMEL = r"^(?!.*(?:[A-Z]{2}|[A-Z][a-z](?:[A-Z]|$)|[A-Z]$))(?![a-z][A-Z])[A-Za-z]*[a-z][A-Z][A-Za-z]*$"
JOINED = r"^(?!.*(?:[a-z][A-Z]|[A-Z]{2}[a-z]))(?=[^+/_=-]*[+/_=-])[A-Za-z+/_=-]*[A-Za-z][A-Za-z+/_=-]*$"
#: Class of a candidate, the first that it matches: (pattern, size of the alphabet, least length); 0: not scored.
CLASSES = {
    "camel": (CAMEL, 0, LEAST),
    "joined": (JOINED, 0, LEAST),
    "digits": (r"^[0-9]+$", 16, WINDOW),
    "hex": (r"^[0-9A-Fa-f]+$", 16, LEAST),
    "word": (r"^(?:[A-Z]?[a-z]+|[A-Z]+)$", 26, WINDOW),
    "base32": (r"^(?:[a-z2-7]+|[A-Z2-7]+)$", 32, LEAST),
    "single": (r"^(?:[a-z0-9]+|[A-Z0-9]+)$", 36, LEAST),
    "letters": (r"^[A-Za-z]+$", 52, LEAST),
    "base62": (r"^[A-Za-z0-9]+$", 62, LEAST),
    "base64": (r"^(?=.*[a-z])(?=.*[A-Z]).*$", 64, LEAST),
    "mixed": (r"^(?=.*[0-9])(?=.*[A-Za-z]).*$", 36, WINDOW),
}
#: Least entropy of a window of `mixed`, whose words and numbers joined by separators reach that of a random token.
MIXED_BITS = 3.9
#: Texts of documentation and alphabets, which are no secrets.
ALLOWED = [
    "example",
    "0123456789abcdef",
    "abcdefghijklmnopqrstuvwxyz",
    "d41d8cd98f00b204e9800998ecf8427e",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
]
CHUNK = 512
#: Characters of a candidate taken at a time, and the fraction of a bit in which sums of c * log2(c) are counted, so that they are exact.
PIECE, UNIT = 256, 1 << 32
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def bound(value: F.Column, f: Callable[[F.Column], F.Column]) -> F.Column:
    """f of a value that is computed once: within f, an expression would be computed at each of its uses."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running_sums(lengths: F.Column) -> F.Column:
    """Inclusive running sums of an array of longs, by chunks, so that no long array is copied at each step."""
    empty = F.array().cast("array<bigint>")

    def run(values):
        start = F.struct(F.lit(0).cast("bigint").alias("s"), empty.alias("o"))
        step = lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["o"], F.array(a["s"] + x)).alias("o"))
        return F.aggregate(values, start, step, lambda a: a["o"])

    def whole(values):
        n = F.ceil(F.size(values) / F.lit(CHUNK)).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(values) > 0, bound(F.transform(chunks, run), moved)).otherwise(empty)

    def moved(sums):
        totals = run(F.transform(sums, lambda c: F.element_at(c, -1)))
        return F.flatten(F.zip_with(sums, F.concat(F.array(F.lit(0).cast("bigint")), totals), lambda c, base: F.transform(F.coalesce(c, empty), lambda v: v + base)))

    return bound(lengths, whole)


def match_ends(text: F.Column, pattern: str) -> tuple[F.Column, F.Column]:
    """(matches, their ends in code points) of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return found, running_sums(bound(gaps, lambda g: F.transform(found, lambda m, k: (F.length(F.get(g, k)) + F.length(m)).cast("bigint"))))


def spans_of(text: F.Column, kind: str, rank: int) -> F.Column:
    pattern, group, least, present = KINDS[kind]
    found, ends = match_ends(text, pattern)
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    spans = F.zip_with(
        F.arrays_zip(found.alias("m"), counted.alias("g")),
        ends,
        lambda x, e: F.struct((e - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.when(F.length(x["g"]) >= least, F.lit(kind)).alias("kind")),
    )
    kept = F.filter(spans, lambda s: s["kind"].isNotNull())
    return F.when(text.rlike(present), kept.cast(SPAN)).otherwise(F.array().cast(SPAN))


def random_entropy(alphabet: int, n: int) -> tuple[float, float]:
    """Mean and standard deviation, in bits, of the entropy of n uniform characters of an alphabet."""
    f = [c * log2(c) if c else 0.0 for c in range(n + 1)]
    one = [comb(n, c) * (alphabet - 1) ** (n - c) / alphabet**n for c in range(n + 1)]
    mean, square = sum(p * x for p, x in zip(one, f)), sum(p * x * x for p, x in zip(one, f))
    cross = sum(comb(n, c) * comb(n - c, d) * (alphabet - 2) ** (n - c - d) / alphabet**n * f[c] * f[d] for c in range(n + 1) for d in range(n + 1 - c))
    variance = alphabet * square + alphabet * (alphabet - 1) * cross - (alphabet * mean) ** 2
    return log2(n) - alphabet * mean / n, sqrt(variance) / n


def least_bits(name: str, n: int) -> float | None:
    """The least entropy of a hot window of n characters in a candidate of a class; None where it isn't scored."""
    _, alphabet, least = CLASSES[name]
    if not alphabet or n < least:
        return None
    if name == "mixed":
        return MIXED_BITS
    mean, deviation = random_entropy(alphabet, n)
    return mean - DEVIATIONS * deviation


def entropy_sums(word: F.Column) -> F.Column:
    """For each character of an ASCII word, the sum of c * log2(c), in UNITs, of the window that ends with it.

    The sum changes by the counts, among the characters between them, of the one that enters and the one that leaves.
    Pieces of PIECE characters, each behind the WINDOW before it, keep the cost of a step apart from the word's length.
    """
    steps = F.array(*[F.lit(round(UNIT * ((c + 1) * log2(c + 1) - (c * log2(c) if c else 0.0)))).cast("bigint") for c in range(WINDOW)])
    pieces = F.regexp_extract_all(word, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    blank = F.lit("\0" * WINDOW)

    def changes(all_pieces, piece, k):
        before = F.when(k == 0, blank).otherwise(F.right(F.get(all_pieces, k - 1), F.lit(WINDOW)))
        return bound(F.concat(before, piece), lambda whole: F.transform(F.sequence(F.lit(0), F.length(piece) - 1), lambda i: change(whole, i)))

    def change(whole, i):
        between = F.substring(whole, i + 2, F.lit(WINDOW - 1))
        entering, leaving = F.substring(whole, i + WINDOW + 1, F.lit(1)), F.substring(whole, i + 1, F.lit(1))
        step = lambda c: F.get(steps, F.lit(WINDOW - 1) - F.octet_length(F.replace(between, c, F.lit(""))))
        return step(entering) - F.when(leaving == F.lit("\0"), F.lit(0).cast("bigint")).otherwise(step(leaving))

    return running_sums(bound(pieces, lambda all_pieces: F.flatten(F.transform(all_pieces, lambda piece, k: changes(all_pieces, piece, k)))))


def hot_windows(word: F.Column, least: F.Column, window: int | F.Column = WINDOW) -> F.Column:
    """Merged spans (start, end) of the windows of `word` whose entropy is at least `least`, as offsets in it."""
    window = F.lit(window)
    most = F.floor((F.log2(window.cast("double")) - least) * window * UNIT + UNIT // 1_000_000)

    def spans(x):
        ends, window = x["ends"], x["window"]
        first = F.filter(ends, lambda e, k: (k == 0) | (e - F.get(ends, k - 1) > window))
        last = F.filter(ends, lambda e, k: (k == F.size(ends) - 1) | (F.get(ends, k + 1) - e > window))
        return F.zip_with(first, last, lambda a, b: F.struct((a - window).alias("start"), b.alias("end")))

    def hot(x):
        flagged = F.transform(x["sums"], lambda s, k: F.when((s <= x["most"]) & (k + 1 >= x["window"]), k + 1))
        return F.struct(F.filter(flagged, lambda e: e.isNotNull()).alias("ends"), x["window"].alias("window"))

    state = F.struct(entropy_sums(word).alias("sums"), most.alias("most"), window.alias("window"))
    return bound(state, lambda x: bound(hot(x), spans))


def candidate_spans(text: F.Column, rank: int, pattern: str, wanted: str, allowed: list[str]) -> F.Column:
    """Hot spans of the matches of pattern that match `wanted` too."""
    found, ends = match_ends(text, pattern)
    bits = {n: F.array(*[F.lit(least_bits(n, k)).cast("double") for k in range(LEAST, WINDOW + 1)]) for n in CLASSES}
    window = lambda m: F.least(F.length(m), F.lit(WINDOW))
    case = F.when(F.lit(False), F.lit(None).cast("double"))

    def least(m):
        out = case
        for name, (p, _, _) in CLASSES.items():
            out = out.when(m.rlike(p), F.element_at(bits[name], window(m) - (LEAST - 1)))
        return F.when(m.rlike(wanted), out)

    candidates = F.filter(
        F.zip_with(found, ends, lambda m, e: F.struct(m.alias("m"), (e - F.length(m)).alias("at"), least(m).alias("least"))),
        lambda c: c["least"].isNotNull(),
    )

    def fine(c, s):
        part = F.lower(F.substring(c["m"], s["start"] + 1, s["end"] - s["start"]))
        return bound(part, lambda p: ~F.greatest(*[F.contains(p, F.lit(a)) | F.contains(F.lit(a), p) for a in allowed]))

    def hot(c):
        return F.transform(
            F.filter(hot_windows(c["m"], c["least"], window(c["m"])), lambda s: fine(c, s)),
            lambda s: F.struct((c["at"] + s["start"]).alias("start"), F.lit(rank).alias("rank"), (c["at"] + s["end"]).alias("end"), F.lit("entropy").alias("kind")),
        ).cast(SPAN)

    return F.when(text.rlike(pattern), F.flatten(F.transform(candidates, hot))).otherwise(F.array().cast(SPAN))


def entropy_spans(text: F.Column, rank: int, allowed: list[str] = ALLOWED) -> F.Column:
    runs = candidate_spans(text, rank, RUN, ".", allowed)
    tokens = candidate_spans(text, rank, TOKEN, "[+/_=-]", allowed)
    return merged(F.array_sort(F.concat(runs, tokens)))


def merged(spans: F.Column) -> F.Column:
    """Sorted spans of one kind, those that overlap or touch made one."""

    def reach(lists):
        """For each span the furthest end up to it."""
        empty = F.array().cast("array<bigint>")
        step = lambda done, s: F.concat(done, F.array(F.greatest(F.get(done, F.size(done) - 1), s["end"])))
        own = F.transform(lists, lambda part: F.aggregate(part, empty, step))
        far = F.aggregate(F.transform(own, lambda o: F.element_at(o, -1)), empty, lambda done, e: F.concat(done, F.array(F.greatest(F.get(done, F.size(done) - 1), e))))
        return bound(far, lambda f: F.flatten(F.transform(own, lambda o, k: F.transform(o, lambda e: F.greatest(e, F.get(f, k - 1))))))

    def joined_up(both):
        all_spans, ends = both["spans"], both["ends"]
        opens = F.filter(F.sequence(F.lit(0), F.size(all_spans) - 1), lambda k: (k == 0) | (F.get(all_spans, k)["start"] > F.get(ends, k - 1)))
        return bound(opens, lambda o: F.transform(o, lambda k, i: one(all_spans, ends, k, F.coalesce(F.get(o, i + 1), F.size(all_spans)) - 1)))

    def one(all_spans, ends, first, last):
        s = F.get(all_spans, first)
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), F.get(ends, last).alias("end"), s["kind"].alias("kind"))

    def whole(x):
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / F.lit(CHUNK)).cast("int") - 1), lambda c: F.slice(x, c * CHUNK + 1, F.lit(CHUNK)))
        state = F.struct(x.alias("spans"), bound(chunks, reach).alias("ends"))
        return F.when(F.size(x) > 0, bound(state, joined_up).cast(SPAN)).otherwise(F.array().cast(SPAN))

    return bound(spans, whole)


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row; spans are (start, rank, end, kind) sorted by start, then kind."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    each = [spans_of(text, kind, rank) for rank, kind in enumerate(KINDS)] + [entropy_spans(text, len(KINDS))]
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def secret_digest(found: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    ranks = F.transform("spans", lambda s: s["rank"])
    counts = [(F.size("spans") - F.size(F.array_remove(ranks, rank))).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
