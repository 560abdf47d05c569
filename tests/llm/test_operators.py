"""Every operator against a plain version, on edge cases and on the small tables."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemill.llm import bpe, decontamination, licenses, line_dedup, linking, ngram_join, passages, quality, secrets, sharding, suffix_dedup, toxicity
from tidemill.llm.catalog import QUERIES
from tidemill.llm.common import lookup

tokenizers = pytest.importorskip("public_tokenizers")
EDGES = [None, "", " ", "\n\n", "a", "é ü 漢字 😀", "x" * 5000, "one two three four five " * 40, "one two three four five " * 40, "Tab\tand\x0bmore\r\nlines\nlines\nlines", "|" * 30, "\x00\x1c\x85"]


def frame(spark, texts, parts=3):
    """Texts as documents, with columns whose names clash with what operators use inside."""
    rows = [(i, t, "x", i, 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, ord int, n int, bucket string").repartition(parts)


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall())


def find(parent, a):
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    return a


def components(items, links):
    parent = {i: i for i in items}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {i: find(parent, i) for i in items}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_returns_all_documents(spark, documents, name):
    got = {r["doc_id"] for r in QUERIES[name](spark, SMALL).select("doc_id").collect()}
    assert got <= set(documents) if name.startswith("op9") else got == set(documents)


@pytest.mark.parametrize(
    "operator",
    [
        lambda d, p: bpe.encode(d, bpe.load_ranks(p), tokenizers.PATTERN), lambda d, p: quality.judge_documents(d), lambda d, p: licenses.scan_licenses(d), lambda d, p: suffix_dedup.dedup_strings(d), lambda d, p: line_dedup.dedup_lines(d),
        lambda d, p: secrets.scan_secrets(d), lambda d, p: sharding.shard_documents(d), lambda d, p: ngram_join.link_documents(d),
    ],
)
def test_empty_tables_and_null_ids(spark, operator):
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert operator(empty, path).count() == 0
    odd = spark.createDataFrame([(None, "some words here"), (None, None), (1, "same"), (1, "same")], "doc_id long, text string")
    assert operator(odd, path).count() == 4


def test_bpe_equals_the_library_and_decodes(spark, documents):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*EDGES, *list(documents.values())[:40]]
    for text in ("ab" * 3000 + "é" * 500, "<|endoftext|>", "a" * 200):
        texts.append(text)
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(frame(spark, texts), ranks, tokenizers.PATTERN, n_slices=5), ranks).collect()}
    for i, text in enumerate(texts):
        assert got[i]["ids"] == library.encode_ordinary(text or ""), repr(text)
        assert bytes(got[i]["decoded"]) == (text or "").encode()
    digest = bpe.digests(bpe.encode(frame(spark, ["a b"]), ranks, tokenizers.PATTERN), ranks).first()
    assert digest["ids_sha256"] == hashlib.sha256(",".join(map(str, library.encode_ordinary("a b"))).encode()).hexdigest()


def test_packed_numbers_round_trip():
    values = np.array([0, 1, 32767, 32768, 70000, 2**31], dtype=np.uint32)
    assert (bpe.unpack(bpe.pack(values)) == values).all()
    assert bpe.unpack_words(bpe.pack_words([b"", b"abc", b"\x00"])) == [b"", b"abc", b"\x00"]


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    times = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if times[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base_columns_and_accuracy(spark, documents):
    texts = [*EDGES, *documents.values()]
    got = {r["doc_id"]: r for r in quality.judge_documents(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        assert tuple(got[i]["f"])[:5] == plain_features(text)
        n, repeats = got[i]["f"]["n_words"], got[i]["f"]["n_repeat_words"]
        assert got[i]["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        assert not (got[i]["kept"] and got[i]["base_failed"])
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SMALL}/labels.parquet'").fetchall())
    judged = {r["doc_id"]: r for r in QUERIES["op3_quality_rules"](spark, SMALL).collect()}
    wrong = [k for k, q in labels.items() if judged[k]["kept"] != bool(q) and not judged[k]["base_failed"]]
    assert len(wrong) <= 0.1 * len(labels)


def test_em_trusts_rules_that_agree():
    patterns = [((0, 0), 100), ((1, None), 900), ((None, None), 500), ((0, None), 5)]
    fitted = quality.estimate(patterns, 2)
    assert fitted.on_bad[0][0] > 0.5 and fitted.on_good[0][0] <= quality.MOST_FALSE_ALARMS
    assert quality.estimate([], 2).prior == 0.85


def test_licenses(spark):
    texts = [
        "Released under the MIT License. Mit   license", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 3.0", "This work is licensed under the GNU General Public License, version 3.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "mit licenses", None, "",
    ]
    got = {r["doc_id"]: r for r in licenses.license_digest(licenses.scan_licenses(frame(spark, texts))).collect()}
    assert [(got[i]["n_base"], got[i]["base_labels"], got[i]["labels"], got[i]["score"]) for i in range(8)] == [
        (2, "mit", "mit", 1.0), (0, "", "cc-by-nc", 1.0), (1, "apache", "apache", 0.5), (1, "gpl", "gpl", 1.0), (0, "", "isc", 1.0), (0, "", "", 0.0), (0, "", "", 0.0), (0, "", "", 0.0),
    ]
    assert (got[0]["first_word"], got[0]["last_word"], got[6]["first_word"]) == (3, 5, None)


def test_template_regions():
    a = licenses.compile_template("x", "one <<beginOptional>>two <<endOptional>>three <<var;name=v;words=2>> end")
    ends = [a.end_of(s.encode().split(), 0) for s in ("one three a end", "one two three a b end", "one three end", "one three a b c end", "one two end")]
    assert ends == [4, 6, None, None, None]


def plain_cut(texts, length, first=False):
    seen, windows = {}, collections.Counter()
    for t in texts:
        windows.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for k, t in enumerate(texts):
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if windows[w] > 1 and (not first or seen.setdefault(w, (k, i)) != (k, i)):
                covered[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum())
        out.append((len(t), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~covered].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("first", "limit"), [(False, 1 << 21), (True, 1 << 21), (False, 100), (True, 100), (True, 3000)])
def test_suffix_dedup(spark, monkeypatch, first, limit):
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", limit)
    monkeypatch.setattr(suffix_dedup, "COUNT_BYTES", limit)
    r = random.Random(5)
    base, period = "".join(r.choice("abcdef \né") for _ in range(2500)), "from " * 500
    texts = [base, base[200:900] + "x" * 50, "y" * 900, "zz" + base[100:520] + "q", period, "w" + period[3:1400], None, "", base[:300], base, "y" * 401, "k" * 399, *["%d%s%d" % (i, base[700:1300], i) for i in range(12)]]
    got = {x["doc_id"]: x for x in suffix_dedup.dedup_strings(frame(spark, texts), keep_first=first).collect()}
    for i, want in enumerate(plain_cut([(t or "").encode() for t in texts], 400, first)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want, i


def test_op5_tells_which_documents_repeat_passages(spark, tmp_path):
    """Passages of over 50 words, in texts of any size: those of 400 bytes tell, those of 399 don't, and n_bytes tells nothing."""
    r = random.Random(7)
    words = lambda n: " ".join("".join(r.choice("abcdefghi") for _ in range(6)) for _ in range(n))
    long, least, short = words(80), words(60)[:400], words(60)[:399]
    texts = [words(n) for n in (300, 20, 60, 150)] + [None, ""]
    texts += [f"{words(n)}{mark}{p}{mark}{words(n)}" for mark, n, p in zip("ABCDEFG", (5, 90, 200, 3, 120, 4, 130), (long, long, long, least, least, short, short), strict=True)]
    texts += [f"{long[:200]}{least}H{words(9)}I{least}", words(200)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in QUERIES["op5_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert all(len(p.split()) > 50 for p in (long, least, short))
    assert [i for i in got if got[i]["repeats"]] == [i for i in got if i in {6, 7, 8, 9, 10, 13}]
    for i, want in enumerate(plain_cut([(t or "").encode() for t in texts], 400)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"], got[i]["repeats"]) == (*want, want[1] > 0), i


def plain_sharing(texts, words):
    """Numbers of the texts with a run of so many words that another text has too."""
    holders = collections.defaultdict(set)
    for k, t in enumerate(texts):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        for i in range(len(w) - words + 1):
            holders[tuple(w[i : i + words])].add(k)
    return sorted({k for held in holders.values() if len(held) > 1 for k in held})


@pytest.mark.parametrize("hot", [256, 3])
def test_op5_tells_which_documents_share_passages(spark, tmp_path, monkeypatch, hot):
    """51 words tell, in whatever bytes, in copies too; 50 words don't, nor what a text only repeats itself."""
    monkeypatch.setattr(passages, "HOT_TEXTS", hot)
    r = random.Random(11)
    words = lambda n, of="abcdefghi": [("".join(r.choice(of) for _ in range(r.randint(1, 7)))) for _ in range(n)]
    least, few, long, huge = words(51), words(50), words(90), ["é" * 9000, "x" * 20000, *words(60)]
    put = lambda p, a, b, by=" ": by.join(["A%d" % a, *words(a), *p, "B%d" % b, *words(b)])
    texts = [put(least, 3, 70), put(least, 200, 4, "\n"), put(least, 0, 0, "\t \r"), put(few, 5, 100), put(few, 80, 6), put(long, 900, 7), put(long[20:80], 9, 9), put(long + words(9) + long, 8, 1)]
    texts += [" ".join(x := words(130)) + " " + " ".join(x), " ".join(few), " ".join(few), " ".join(y := words(60)), " ".join(y), None, None, "", " ".join(least), put(huge, 3, 4), put(huge[:53], 1, 1)]
    texts += ["Of " * 300, "Of " * 51, "of " * 80, " ".join(words(40)), *[put(long[k : k + 53], k, 3) for k in range(12)]]
    assert max(len(" ".join(p).encode()) for p in (least, few)) < 400
    frame(spark, texts, 5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["shares_passage"] for x in QUERIES["op5_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert [i for i in sorted(got) if got[i]] == plain_sharing(texts, 51) == [0, 1, 2, 5, 6, 7, 11, 12, 16, 17, 18, 19, 20, *range(23, 35)]
    for n in (2, 7, 8, 50):
        cut = suffix_dedup.dedup_strings(frame(spark, texts, 4), passage_words=n).collect()
        assert sorted(x["doc_id"] for x in cut if x["shares_passage"]) == plain_sharing(texts, n), n


def test_factors_of_whole_length():
    r = random.Random(3)
    for _ in range(200):
        d, most = np.array([r.choice([0, 1, 256]) for _ in range(r.randint(0, 60))], np.int16), r.choice([1, 2, 3, 5, 8, 40])
        lengths, sources = suffix_dedup.longest_previous_factors(d, most)
        whole, places = suffix_dedup.longest_previous_factors(d, most, whole=True)
        assert whole.tolist() == [most if n == most else 0 for n in lengths.tolist()]
        assert (places == np.where(lengths == most, sources, -1)).all()


def test_longest_previous_factors():
    r = random.Random(1)
    for k in range(60):
        d, most = [r.choice([1, 2]) for _ in range(r.randint(0, 30))], r.choice([3, 40])
        common = lambda i, j: next((k for k in range(len(d) - i + 1) if i + k >= len(d) or d[i + k] != d[j + k]), 0)  # noqa: B023,E731
        lengths, sources = suffix_dedup.longest_previous_factors(np.array(d, np.int16), most)
        assert lengths.tolist() == [min(most, max([0, *(common(i, j) for j in range(i))])) for i in range(len(d))]
        assert all(j == -1 if n == 0 else j < i and common(i, j) >= n for i, (n, j) in enumerate(zip(lengths.tolist(), sources.tolist(), strict=True)))


def plain_line_links(texts):
    lines = {line_dedup.normal_line(x) for t in texts if t for x in t.split("\n")} - {""}
    sets = {x: {x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines}
    ordered = sorted(lines)
    return ordered, [(a, b) for k, a in enumerate(ordered) for b in ordered[:k] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def test_fuzzy_lines(spark):
    r = random.Random(7)
    line = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    base = line()
    near = [base[: 7 * k] + "zzzzzz" + base[7 * k + 6 :] for k in range(25)]
    texts = [base + "\n" + line(), "\n".join(near[:3]), near[5].upper() + "\n\nshort", "Short\n" + line(), None, "", "\n", *near[6:]]
    ordered, links = plain_line_links(texts)
    root, keep = components(ordered, links), {}
    for k, t in enumerate(texts):
        for i, x in enumerate((t or "").split("\n")):
            if p := line_dedup.normal_line(x):
                keep.setdefault(root[p], (k, i))
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        gone = [i for i, x in enumerate((t or "").split("\n")) if (p := line_dedup.normal_line(x)) and keep[root[p]] != (k, i)]
        assert got[k]["removed"] == gone and got[k]["n_removed"] == len(gone), k
    left = {x["doc_id"]: x["text"] for x in line_dedup.remove_lines(frame(spark, texts)).collect()}
    assert left[0] == texts[0] and 1 not in left and left[2] == "\nshort" and left[4] is None and 7 not in left


def test_signature_of_a_short_line_and_bands():
    rows = line_dedup.band_keys(line_dedup.signatures(["ab", "ab", "cd"]))
    assert rows.shape == (3, line_dedup.BANDS) and (rows[0] == rows[1]).all() and not (rows[0] == rows[2]).any()


def plain_sets(texts, size):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return out


@pytest.mark.parametrize("like", [ngram_join.Similarity(), ngram_join.Similarity(5, 8, 10)])
def test_ngram_join(spark, like):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = ["a b", "A  b", "a b c", None, "", " ", "a b c d"]
    for n in (9, 10, 11, 12, 20, 45, 120, 300, 1700):
        base = [r.choice(words) for _ in range(n)]
        for edits in (0, 0, 1, 1, 2, max(1, n // 60), max(1, n // 30), n // 15):
            own = list(base)
            for _ in range(edits):
                own[r.randrange(len(own))] = r.choice(words)
            texts.append(" ".join(own))
    sets = plain_sets(texts, like.words)
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and like.denominator * len(sets[a] & sets[b]) >= like.numerator * len(sets[a] | sets[b])]
    want = components(range(len(texts)), links)
    got = {x["doc_id"]: x for x in ngram_join.link_documents(frame(spark, texts), like).collect()}
    assert {k: got[k]["component_id"] for k in got} == want
    assert all(got[k]["n_shingles"] == len(s) for k, s in enumerate(sets))
    assert {x["doc_id"] for x in ngram_join.keep_one_each(frame(spark, texts), like).collect()} == set(want.values())


@pytest.mark.parametrize("like", [ngram_join.Similarity(), ngram_join.Similarity(5, 8, 10)])
def test_a_passage_of_many_documents_fills_no_bucket(spark, like):
    """300 texts share 30 words and are unlike otherwise; three have a near copy, which is still found."""
    r = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for _ in range(300):
        own = [f"w{r.randrange(100_000)}" for _ in range(r.randrange(60, 400))]
        at = r.randrange(len(own))
        texts.append(own[:at] + passage + own[at:])
    for k in range(3):
        texts.append([*texts[k][:-1], "other"])
    docs = frame(spark, [" ".join(t) for t in texts])
    source = docs.select(F.col("doc_id").alias("id"), "text")
    counted = ngram_join.slot_counts(ngram_join.shingle_table(source, like))
    assert counted.sum() == sum(map(len, plain_sets([" ".join(t) for t in texts], like.words)))
    sizes = linking.buckets(ngram_join.keyed_documents(source, like, counted)).groupBy("bucket").count()
    assert sizes.agg(F.max("count")).first()[0] <= 4
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.link_documents(docs, like).collect()}
    assert got == {k: k - 300 if k >= 300 else k for k in range(303)}


@pytest.mark.parametrize("like", [ngram_join.Similarity(), ngram_join.Similarity(5, 8, 10)])
def test_linked_sets_share_a_bucket_whatever_the_order(like):
    r = np.random.default_rng(5)
    ends = np.array(like.bands(5000))
    for warm in (np.zeros(1 << ngram_join.SLOT_BITS, np.uint8), r.integers(0, 255, 1 << ngram_join.SLOT_BITS).astype(np.uint8)):
        for n in [*range(1, 60), 100, 333, 1200]:
            for _ in range(4):
                pool = np.unique(r.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
                m = int(r.integers(n * like.numerator // like.denominator, n + 1)) or 1
                shared = -(-like.numerator * (n + m) // (like.numerator + like.denominator))
                if shared > m:
                    continue
                a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:shared], pool[n : n + m - shared])))
                assert np.intersect1d(ngram_join.bucket_keys(a, ends, like, warm), ngram_join.bucket_keys(b, ends, like, warm)).size


def test_rtree_bounds_never_miss():
    r = np.random.default_rng(0)
    at = r.integers(0, 9, (300, 32))
    tree = ngram_join.RTree(at)
    for k in range(0, 300, 17):
        near, bound = tree.overlapping(at[k], 8, 10)
        want = {i for i in range(300) if 18 * np.minimum(at[i], at[k]).sum() >= 8 * (at[i].sum() + at[k].sum())}
        assert set(near.tolist()) == want


def test_union_find_on_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    got = dict(map(tuple, linking.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == components(set(got), edges) and len(got) == 61 + 100


def test_secrets_spans_and_entropy(spark, documents):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    r = random.Random(9)
    odd = ["é Password: hunter2hunter2 API_key='abc' token=", "AKIA" + "A1" * 8 + " AKIAshort", "f" * 32 + "é" + "0123456789abcdef" * 2, "secret=" + "ab" * 3000 + " " + "deadbeef" * 4, " ".join("%032x" % r.getrandbits(128) for _ in range(2500))]
    random_token = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(48))
    texts = [*EDGES, *odd, "see " + random_token, "see EXAMPLE" + random_token, "a" * 40 + "1", *list(documents.values())[:60]]
    got = {x["doc_id"]: x for x in secrets.secret_digest(secrets.scan_secrets(frame(spark, texts))).collect()}
    for i, t in enumerate(t or "" for t in texts):
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest(), i
    at = len(EDGES) + len(odd)
    assert "entropy:4:" in got[at]["spans"] and "entropy" not in got[at + 1]["spans"] and "entropy" not in got[at + 2]["spans"]


def test_random_tokens_of_every_alphabet_are_found(spark):
    r = random.Random(5)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = [(lower + digits, 24), (upper + "234567", 24), (upper + "234567", 32), (lower, 24), (lower + upper, 20), (lower + upper + digits, 16), (lower + upper + digits + "+/", 24), (digits + "abcdef", 20)]
    tokens = ["".join(r.choice(a) for _ in range(n)) for a, n in kinds for _ in range(60)]
    words = ["internationalisation", "Content-Disposition", "getUserAccountSettings", "docs/en/some-long-title-of-a-page", "abcdefghijklmnopqrst", "1234567890123456"]
    held = ["docs/example/" + "".join(r.choice(lower + upper + digits) for _ in range(40)) for _ in range(20)]
    got = {x["doc_id"]: x["spans"] for x in secrets.secret_digest(secrets.scan_secrets(frame(spark, ["see " + t for t in tokens + held + words]))).collect()}
    n = len(tokens) + len(held)
    assert sum("entropy" in got[i] for i in range(n)) >= 0.99 * n and all(got[n + i] == "" for i in range(len(words)))


def test_entropy_windows_equal_a_plain_version(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdef0123456789" if k % 2 else "ab1") for _ in range(r.randint(24, 80))) for k in range(30)]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.hot_windows(F.col("w"), F.lit(2.9)).alias("h"))
    for row in df.collect():
        w, spans = row["w"], []
        for i in range(len(w) - 23):
            c = collections.Counter(w[i : i + 24]).values()
            if -sum(x / 24 * np.log2(x / 24) for x in c) >= 2.9 - 1e-9:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 24
                else:
                    spans.append([i, i + 24])
        assert [[s["start"], s["end"]] for s in row["h"]] == spans


def plain_spans(text):
    """All spans of a text, by loops over every window."""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(secrets.HEX, text) if len(m[0]) >= 32]
    hot = []
    for pattern, wanted in ((secrets.RUN, "."), (secrets.TOKEN, "[+/_=-]")):
        for m in re.finditer(pattern, text):
            word = m[0]
            n = min(len(word), 24)
            name = next((k for k, (p, _, _) in secrets.CLASSES.items() if re.search(p, word)), None)
            least = secrets.least_bits(name, n) if name and re.search(wanted, word) else None
            own = []
            for i in range(len(word) - n + 1 if least is not None else 0):
                if np.log2(n) - sum(c * np.log2(c) for c in collections.Counter(word[i : i + n]).values()) / n >= least - 1e-9:
                    own = own[:-1] + [(own[-1][0], i + n)] if own and i <= own[-1][1] else [*own, (i, i + n)]
            hot += [(m.start() + a, m.start() + b) for a, b in own if not any(x in word[a:b].lower() or word[a:b].lower() in x for x in secrets.ALLOWED)]
    one = []
    for a, b in sorted(hot):
        one = one[:-1] + [(one[-1][0], max(b, one[-1][1]))] if one and a <= one[-1][1] else [*one, (a, b)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out + [(a, 3, b, "entropy") for a, b in one]))


def test_all_spans_equal_a_plain_version(spark, documents):
    r = random.Random(12)
    alphabets = ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ab1", "0123456789abcdef", "ABCabc-_/+=xyzXYZ019"]
    token = lambda: "".join(r.choice(r.choice(alphabets)) if r.random() < 0.1 else r.choice(a) for a in [r.choice(alphabets)] for _ in range(r.choice([12, 16, 20, 24, 40, 300, 600])))
    texts = [*EDGES, *documents.values(), *[" ".join(token() + r.choice(["", "example", "é"]) for _ in range(r.randint(1, 30))) for _ in range(80)]]
    got = {x["doc_id"]: x["spans"] for x in secrets.secret_digest(secrets.scan_secrets(frame(spark, texts))).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != plain_spans(t or "")] == []


def test_a_token_of_a_megabyte(spark):
    r = random.Random(1)
    token = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1 << 20))
    words = "-".join(["some", "Word", "HERE"] * 60_000)
    began = time.time()
    got = {x["doc_id"]: x["spans"] for x in secrets.secret_digest(secrets.scan_secrets(frame(spark, ["see " + token, words]))).collect()}
    assert got[1] == "" and got[0].startswith("entropy:4:") and time.time() - began < 60


def test_shards(spark, documents):
    texts = [*EDGES, *documents.values(), *["same text"] * 50]
    got = sharding.shard_documents(frame(spark, texts), 7).collect()
    of = collections.defaultdict(set)
    for x in got:
        t = texts[x["doc_id"]] or ""
        assert (x["size"], x["text_crc32"], x["law"]) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "bytes")
        of[t].add(x["shard"])
    assert all(len(s) == 1 for s in of.values())
    slots = collections.defaultdict(list)
    for x in got:
        slots[x["shard"]].append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(7))


def test_least_capacity_equals_a_plain_search(spark):
    r = random.Random(8)
    atoms = sorted((r.getrandbits(60), r.choice([20, 50, 90, 4000])) for _ in range(3000))
    starts, capacity = sharding.shard_starts(spark.createDataFrame(atoms, "ord long, bytes long"), 11)

    def fits(c):
        n, left = 1, c
        for _, b in atoms:
            if b > c:
                return False
            if b > left:
                n, left = n + 1, c
            left -= b
        return n <= 11

    low = 1
    while not fits(low):
        low += 1 if low > 140000 else 500
    low = next(c for c in range(max(1, low - 500), low + 1) if fits(c))
    assert capacity == low
    sizes = [sum(b for o, b in atoms if a <= o < z) for a, z in zip([0, *starts], [*starts, 1 << 60], strict=True)]
    assert max(sizes) <= capacity


def test_decontamination_finds_leaks_and_spares_others(spark, documents):
    items = duckdb.sql(f"select item_id, text from '{SMALL}/benchmark.parquet' order by 1").fetchall()
    clean = [documents[k] for k in sorted(documents)[:30]]
    long_item = " ".join(f"q{i}" for i in range(200)) + " ? forty two"
    texts = [clean[0] + "\n" + items[0][1] + "\n" + clean[1], items[1][1].upper(), "intro " + long_item, " ".join(long_item.split()[:100]), None, "", *clean]
    bench = spark.createDataFrame([*items, (777, long_item), (778, None), (779, "")], "item_id long, text string")
    got = collections.defaultdict(set)
    for x in decontamination.find_contaminated(frame(spark, texts), bench).collect():
        got[x["doc_id"]].add(x["item_id"])
    plain = {i: " ".join(x.decode() for x in decontamination.words_of(t)) for i, t in [*items, (777, long_item)]}
    for k, t in enumerate(texts):
        words = " " + " ".join(x.decode() for x in decontamination.words_of(t)) + " "
        assert {i for i, p in plain.items() if f" {p} " in words} <= got[k]
    assert not any(got[k] for k in (3, 4, 5))
    assert 777 in got[2]
    kept = {x["doc_id"] for x in decontamination.drop_contaminated(frame(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {k for k in got if got[k]}
    assert decontamination.find_contaminated(frame(spark, texts), bench.limit(0)).count() == 0


def plain_contaminated(texts, items):
    """Every item scored against every passage of every text, without an index: {(text, item): (first word, overlaps)}."""
    words = {i: [w.decode() for w in decontamination.words_of(t)] for i, t in items}
    words = {i: w for i, w in words.items() if w}
    mean = sum(map(len, words.values())) / len(words)
    df = collections.Counter(w for ws in words.values() for w in set(ws))
    found = {}

    def share(part, around):
        n = min(decontamination.GRAM, len(part))
        grams = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)} if n else set()
        return sum(any(tuple(around[j : j + n]) == g for j in range(len(around))) for g in grams) / len(grams) if grams else 1.0

    for k, text in enumerate(texts):
        own = [w.decode() for w in decontamination.words_of(text)]
        for i, item in words.items():
            half = max(decontamination.SHORTEST, 1 << (len(item) - 1).bit_length()) // 2
            weight = {}
            for w, c in collections.Counter(item).items():
                idf = math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5))
                weight[w] = idf * c * (decontamination.K1 + 1) / (c + decontamination.K1 * (1 - decontamination.B + decontamination.B * len(item) / mean))
            question, answer = ([w.decode() for w in p] for p in decontamination.split_item(dict(items)[i]))
            for start in range(0, len(own), half):
                passage = set(own[start : start + 3 * half])
                if sum(x for w, x in weight.items() if w in passage) >= decontamination.THRESHOLD * sum(weight.values()):
                    around = own[max(0, start - half) : start + 4 * half]
                    q, a = share(question, around), share(answer, around)
                    if min(q, a) >= decontamination.OVERLAP and ((k, i) not in found or q + a > sum(found[k, i][1:])):
                        found[k, i] = (start, q, a)
    return found


def test_decontamination_equals_brute_force(spark, documents):
    items = duckdb.sql(f"select item_id, text from '{SMALL}/benchmark.parquet' order by 1").fetchall()
    items += [(9000, items[0][1]), (9001, " ".join(f"q{i}" for i in range(70)) + "? forty two"), (9002, None), (9003, "")]
    r, texts = random.Random(9), [documents[k] for k in sorted(documents)[:60]]
    for k in range(60):  # leaks, some with words lost, changed or moved apart, at any place
        item = r.choice(items[:-2])[1].split()
        kept = [w if r.random() > 0.02 * (k % 10) else f"x{k}" for w in item]
        at = r.randrange(1 + len(kept))
        texts.append(" ".join([texts[k][: r.randrange(400)], *kept[:at], *["filler"] * (k % 3 * 12), *kept[at:], texts[-k - 1][:200]]))
    texts += [None, "", "?"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["first_word"], round(x["question_overlap"], 9), round(x["answer_overlap"], 9)) for x in decontamination.find_contaminated(frame(spark, texts), bench).collect()}
    told = {k: (s, round(q, 9), round(a, 9)) for k, (s, q, a) in plain_contaminated(texts, items).items()}
    assert got == told and len(told) > 30 and len({k for k, _ in told}) < len(texts) - 20


def test_wand_equals_exhaustive_scores(monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 3)
    r = random.Random(6)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 15)))) for i in range(80)]
    frequencies = collections.Counter(w for _, t in items for w in set(decontamination.words_of(t)))
    found = decontamination.build_indexes(items, frequencies, 80, 10.0)
    (index,) = found.classes
    for _ in range(200):
        terms = sorted({found.terms[w] for w in (r.choice(vocabulary).encode() for _ in range(20)) if w in found.terms})
        scores = collections.Counter()
        for t in terms:
            for k, x in zip(*index.postings[t][:2], strict=True):
                scores[k] += x
        for threshold in (0.3, 0.6):
            assert sorted(decontamination.block_max_wand(index, terms, threshold)) == sorted(k for k, s in scores.items() if s >= threshold)


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for k in range(600):
        own = [r.choice(words) for _ in range(r.randint(20, 120))]
        if toxic := k % 5 == 0:
            for _ in range(4):
                own.insert(r.randrange(len(own)), f"vile{r.randrange(10)}")
        if junk := k % 7 == 0:
            own += ["buy now"] * 5
        rows.append((k, " ".join(own), int(toxic), None if k % 50 == 1 else int(not junk)))
    docs = spark.createDataFrame([(k, t) for k, t, *_ in rows] + [(9999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, q) for k, _, y, q in rows if k < 300], "doc_id long, toxic int, quality int")
    got = {x["doc_id"]: x for x in toxicity.toxic_documents(docs, labels).collect()}
    held_out = [(y, got[k]["toxic"]) for k, _, y, _ in rows if k >= 300]
    assert sum(bool(y) == t for y, t in held_out) >= 0.95 * len(held_out) and len(got) == 601
    junk = [(q == 0, got[k]["p_junk"] >= 0.5) for k, _, _, q in rows if k >= 300 and q is not None]
    assert sum(a == b for a, b in junk) >= 0.95 * len(junk)
    assert toxicity.toxic_documents(docs, labels.limit(0)).count() == 601


def test_lookup_of_hot_and_other_keys(spark):
    keys = [1] * 500 + [2] * 300 + list(range(3, 400)) + [None, None, 999]
    rows = spark.createDataFrame(list(enumerate(keys)), "ord long, key long")
    unique = rows.where("key is not null and key <> 999").groupBy("key").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    got = lookup(rows, unique, "key", "n", rows.count()).collect()
    first = {k: keys.index(k) for k in keys}
    assert {(r["ord"], r["key"], r["first"], r["n"]) for r in got} == {(i, k, None if k in (None, 999) else first[k], None if k in (None, 999) else keys.count(k)) for i, k in enumerate(keys)}


def test_results_own_what_they_read(spark):
    first = ngram_join.link_documents(frame(spark, ["a b c d", "a b c d", "x"]))
    cut = line_dedup.remove_lines(quality.keep_good(frame(spark, ["one two three four five six seven eight nine ten eleven"] * 2)))
    line_dedup.dedup_lines(frame(spark, ["y\nz"])).collect()
    assert [r["component_id"] for r in first.orderBy("doc_id").collect()] == [0, 0, 2]
    assert ngram_join.keep_one_each(cut).count() == 1 and cut.count() == 1


def test_stages_take_columns_of_any_name(spark):
    names = ["left", "gone", "f", "own", "cut", "hash", "left_lines", "own_hash", "own_text", "n", "Doc", "__hash"]
    texts = ["one two three four five six seven eight nine ten eleven", None, "", "one two three four five six seven eight nine ten eleven"]
    docs = spark.createDataFrame([(k, t, *range(len(names))) for k, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    for f in (quality.keep_good, line_dedup.remove_lines, ngram_join.keep_one_each):
        assert f(docs).columns == docs.columns and 0 in {r["doc_id"] for r in f(docs).collect()}
        assert f(docs.limit(0)).count() == 0
