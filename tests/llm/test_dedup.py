import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docflow.llm import wordhash
from docflow.llm.exact_dedup import exact_dedup
from docflow.llm.minhash_dedup import BUCKETS, band_keys, estimate, near_duplicates, shingle_sets, sketch
from docflow.llm.substring_dedup import merged, substring_dedup
from tests.llm.conftest import make


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def by_id(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


def test_exact_dedup(docs, rows):
    for size in (16, 4096):
        out = by_id(exact_dedup(docs, size), "doc_id")
        keys = {i: (t or "").encode().lower() for i, t in rows}
        assert len(out) == len(rows)
        for i, key in keys.items():
            own = [j for j, k in keys.items() if k == key]
            assert (out[i]["keep_id"], out[i]["group_size"], out[i]["kept"]) == (max(own), len(own), i == max(own))
            assert out[i]["text_sha256"] == hashlib.sha256(key).hexdigest()


def test_exact_dedup_odd_rows(spark, empty):
    assert exact_dedup(empty).count() == 0
    out = exact_dedup(make(spark, [(None, "x" * 50), (7, "x" * 50), (7, "x" * 50), (None, "y"), (8, None), (9, "")]), 16).collect()
    assert Counter((r["keep_id"], r["group_size"]) for r in out) == {(7, 3): 3, (None, 1): 1, (9, 2): 2}
    assert sum(r["kept"] for r in out) == 4


def near_truth(rows):
    sets = {}
    for i, t in rows:
        w = words(t, True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(docs, rows):
    out = by_id(near_duplicates(docs), "doc_id")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == near_truth(rows)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())


def test_near_duplicates_without_base(spark):
    """A hot group whose members link in chains, and one whose members do not link, without their common base."""
    import random

    rng = random.Random(3)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(60):
        own = list(base)
        for _ in range(1 + k % 5):
            own[rng.randrange(len(own))] = f"e{rng.randrange(40)}"
        rows.append((k, " ".join(own)))
    out = by_id(near_duplicates(make(spark, rows)), "doc_id")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == near_truth(rows)


def test_near_duplicates_odd_rows(spark, empty):
    assert near_duplicates(empty).count() == 0
    out = near_duplicates(make(spark, [(None, "a b c"), (5, "A b  c"), (5, "A b  c"), (5, "other words"), (None, None), (6, "")])).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == {(None, 1, 5): 1, (5, 1, 5): 3, (None, 0, None): 1, (6, 0, 6): 1}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.3, 0.6, 0.9):
        both = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        n = int(4000 * share)
        a, b = np.unique(both), np.unique(np.concatenate([both[:n], rng.integers(0, 2**63, 4000 - n, dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found, _ = estimate(sketch(wordhash.mix(a.copy()) if False else np.unique(wordhash.mix(a)))[None], sketch(np.unique(wordhash.mix(b)))[None])
        errors.append(abs(found[0] - true))
    assert max(errors) < 0.13
    assert len(sketch(np.zeros(0, np.uint64))) == BUCKETS and not len(band_keys(sketch(np.zeros(0, np.uint64))))


def test_bands_find_short_sets():
    """Pairs of few shingles at the threshold share a band as long ones do."""
    rng = np.random.default_rng(2)
    for most, least, rows in ((5, 4, 5), (7, 6, 6), (14, 12, 6)):
        missed = 0
        for _ in range(500):
            a = np.sort(rng.integers(0, 2**64, most, dtype=np.uint64))
            b = np.sort(rng.permutation(a)[:least])
            missed += not (set(band_keys(sketch(a), rows)) & set(band_keys(sketch(b), rows)))
        assert not missed, (most, least)


def removal_truth(rows, width=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_substring_dedup(docs, rows):
    out = by_id(substring_dedup(docs).select("doc_id", "text", "lang", "dedup.*"), "doc_id")
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in out.items()} == removal_truth(rows)
    for i, t in rows:
        spans = [(s["start"], s["end"]) for s in out[i]["removed"]]
        assert sum(e - s for s, e in spans) == out[i]["n_removed"] and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
        if not spans:
            assert out[i]["text"] == t


def test_substring_dedup_odd_rows(spark, empty):
    assert substring_dedup(empty).count() == 0
    text = " ".join(f"w{k}" for k in range(30))
    rows = make(spark, [(None, text), (3, text), (3, text), (3, "x " + text), (4, None)]).withColumn("dedup", F.lit(1)).withColumn("words", F.lit("c")).withColumn("starts", F.lit(2))
    out = Counter((r["doc_id"], r["dedup"]["n_words"], r["dedup"]["n_removed"]) for r in substring_dedup(rows).collect())
    assert out == {(None, 30, 0): 1, (3, 30, 30): 2, (3, 31, 30): 1, (4, 0, 0): 1}


def test_spans_that_touch_are_one():
    span = lambda *xs: [{"start": a, "end": b} for a, b in xs]
    assert merged(span((0, 20), (20, 40), (50, 70), (55, 75))) == [(0, 40), (50, 75)]
    assert merged([]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabAéß\x0b", max_size=30)), max_size=8), st.booleans(), st.sampled_from([3, 8, 1 << 20]))
def test_word_hashes(texts, lower, size):
    old, wordhash.SLICE = wordhash.SLICE, size
    try:
        (one, two), begins = wordhash.word_hashes(pa.array(texts, pa.string()), lower, True)
    finally:
        wordhash.SLICE = old
    own = [words(t, lower) for t in texts]
    assert list(np.diff(begins)) == [len(w) for w in own]
    names = {}
    for w, pair in zip([x for ws in own for x in ws], zip(one, two, strict=True), strict=True):
        assert names.setdefault(w, pair) == pair
    assert len(set(names.values())) == len(names)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \t\nabAéß\x0b", max_size=40), st.sampled_from([1, 3, 8, 1 << 20]))
def test_words_in_pieces(text, size):
    raw, old = text.encode(), wordhash.SLICE
    wordhash.SLICE = size
    try:
        assert b"".join(wordhash.squeezed(memoryview(raw))) == b" ".join(raw.split())
        assert wordhash.named(memoryview(raw)) == (hashlib.sha256(b" ".join(raw.split())).digest(), len(raw.split()))
    finally:
        wordhash.SLICE = old
    begins, ends = wordhash.word_edges(np.frombuffer(raw, np.uint8))
    assert [raw[a:b] for a, b in zip(begins, ends, strict=True)] == raw.split()


def test_a_word_of_64_mb_takes_little_memory():
    import resource

    texts = pa.array(["x" * (64 << 20), "y " + "x" * (64 << 20) + " z"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (one,), begins = wordhash.word_hashes(texts)
    assert list(begins) == [0, 1, 4] and one[0] == one[2]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 << 10  # KB


def test_shingle_sets_of_short_texts():
    a, b, c, d = shingle_sets(pa.array(["a b", "A  b", "a b c", None]))
    assert list(a) == list(b) != list(c) and len(c) == 1 and len(d) == 0
