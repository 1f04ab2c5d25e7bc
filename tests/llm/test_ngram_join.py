import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docflow.llm import ngram_join as N
from docflow.llm.ngram_join import bands, ngram_join, signatures
from docflow.operators.bits import bit_map, in_map
from tests.llm.conftest import make


def truth(rows, threshold=85, width=4):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_ngram_join(docs, rows):
    out = ngram_join(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert found(out) == truth(rows)


@pytest.mark.parametrize("threshold,width", [(60, 2), (95, 4)])
def test_other_thresholds(docs, rows, threshold, width):
    assert found(ngram_join(docs, threshold, width)) == truth(rows, threshold, width)


def test_groups_without_their_base(spark):
    """Hot groups that link in chains, and members that share signatures but do not link."""
    rng = random.Random(3)
    rows = []
    for g, (n, most) in enumerate([(60, 5), (40, 9), (50, 2)]):
        base = [f"g{g}b{k}" for k in range(150)]
        for k in range(n):
            own = list(base)
            for _ in range(1 + k % most):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((1000 * g + k, " ".join(own)))
    # Lengths that end in neighbouring bands, and short texts of all sizes.
    words = [f"x{k}" for k in range(60)]
    rows += [(9000 + n, " ".join(words[:n])) for n in range(1, 60)]
    rows += [(9500 + n, " ".join(["same"] * n)) for n in range(1, 9)]
    rng.shuffle(rows)
    assert found(ngram_join(make(spark, rows))) == truth(rows)


def test_odd_rows(spark, empty):
    assert ngram_join(empty).count() == 0
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (7, text), (7, text), (7, "other words stand here now"), (9, " \n"), (None, None), (3, text + " end")]
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join(make(spark, rows).withColumn("node", F.lit(1)).withColumn("signature", F.lit("x"))).collect()), key=str)
    assert out == sorted([(None, 27, 3), (7, 27, 3), (7, 27, 3), (7, 2, 7), (9, 0, 9), (None, 0, None), (3, 28, 3)], key=str)


def test_bands_cover_neighbours():
    own = bands(100_000)
    assert [b[0] for b in own[1:]] == [b[1] + 1 for b in own[:-1]] and own[-2][1] >= 100_000
    at = lambda n: next(k for k, b in enumerate(own) if n <= b[1])
    for n in (1, 2, 5, 6, 7, 13, 100, 999, 12345):
        assert at(n * 100 // 85) - at(n) <= 1


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**9), st.sampled_from([60, 85, 95]))
def test_sets_at_the_threshold_share_a_signature(n, seed, threshold):
    """As many differences as the threshold allows, in any mixture of lost and new elements."""
    rng = random.Random(seed)
    a = {rng.randrange(2**63) for _ in range(n)}
    b = set(a)
    while True:
        c = set(b)
        if rng.random() < 0.5 and len(c) > 1:
            c.discard(rng.choice(sorted(c)))
        else:
            c.add(rng.randrange(2**63))
        if 100 * len(a & c) < threshold * len(a | c):
            break
        b = c
    one, two = signatures([np.array(sorted(x), np.uint64) for x in (a, b)], threshold)
    assert np.intersect1d(one, two).size


def test_small_sets_with_empty_parts_share_a_signature():
    """Every pair of small sets whose one difference leaves parts empty."""
    rng = np.random.default_rng(2)
    for n in (6, 7, 8, 9, 12):
        for _ in range(400):
            full = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            less = np.delete(full, rng.integers(len(full)))
            if 100 * len(less) >= 85 * len(full):
                one, two = signatures([full, less])
                assert np.intersect1d(one, two).size


def test_unlike_sets_share_none():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(50)]
    own = signatures(sets)
    assert len(np.unique(np.concatenate(own))) == sum(map(len, own))
    assert all(len(s) < 0.5 * 300 for s in own)


def test_whole_sets_are_not_written(docs, rows, monkeypatch):
    """Texts travel to their stars; of sets, only what differs from a star is written, once."""
    written, real = {}, N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, name: written.setdefault(name, real(df, name)))
    monkeypatch.setattr(N, "release", lambda *tables: None)
    assert found(ngram_join(docs)) == truth(rows)
    assert [k for k, df in written.items() if "signatures" in df.columns] == ["op11-signed", "op11-held"]
    assert not any("shingles" in df.columns for df in written.values())
    sizes = written["op11-checked"].select(F.size("extra") + F.col("common") == F.col("n"), F.size("off") == F.least("common", F.col("ns") - F.col("common")))
    assert "fresh" not in written["op11-checked"].columns and all(all(r) for r in sizes.collect())


def test_repeated_signatures_are_in_the_map(spark):
    rng = np.random.default_rng(6)
    own = rng.integers(-(2**63), 2**63, 4000)
    seen = spark.createDataFrame([(own[k : k + 40].tolist(),) for k in [*range(0, 4000, 40), *range(0, 400, 40)]], "signatures array<long>")
    words = bit_map(N._repeated(seen), N.MAP_BITS)
    assert in_map(own[:400], words).all() and in_map(own[400:], words).sum() < 10


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(8)
    for n in (1, 5, 200, 256, 257, 700, 5000):
        full = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        other = np.unique(np.concatenate([full[rng.random(n) < 0.9], rng.integers(0, 2**63, n // 4 + 1, dtype=np.uint64)]))
        one, two = N.sketch(full), N.sketch(other)
        assert len(one) * 64 >= max(512, 2 * n)
        for size in {N.WORDS, min(len(one), len(two))}:
            apart = int(np.bitwise_count((N.folded(one, size) ^ N.folded(two, size)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(full, other)) and (apart - len(np.setxor1d(full, other))) % 2 == 0
    far = [N.sketch(np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))) for _ in range(20)]
    assert all(np.bitwise_count((a ^ b).view(np.uint64)).sum() * 185 > 600 * 15 for a, b in combinations(far, 2))


@pytest.mark.parametrize("block", [1000, 7])
def test_members_that_share_an_edit_make_few_pairs(spark, monkeypatch, block):
    """Near copies with one edit in common and others of their own: nearly all pairs are ruled out by sketches."""
    monkeypatch.setattr(N, "BLOCK", block, raising=False)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 81):
        own = [*base[:70], "shared", *base[71:]]
        for at in rng.sample([x for x in range(150) if x != 70], 5):
            own[at] = f"e{k}at{at}"
        rows.append((k, " ".join(own)))
    rows += [(100, rows[40][1] + " and"), (101, rows[50][1] + " or")]
    asked, real = [], N.materialize

    def counted(df, name):
        out = real(df, name)
        if name == "op11-asked":
            asked.append(out.count())
        return out

    monkeypatch.setattr(N, "materialize", counted)
    assert found(ngram_join(make(spark, rows))) == truth(rows)
    assert sum(asked) < 2 * len(rows)
