import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.llm import sentence_pieces as P
from docflow.llm.packing import differencing, pack, pack_documents
from docflow.llm.sharding import shard_documents
from docflow.llm.token_files import read_tokens, token_checksums, token_folder, write_token_files
from docflow.llm.tokens import encoded, encoder, vocabulary_path
from tests.llm.conftest import make

ODD = ["", " ", "Don't STOP, 123 été!", "a\x1cb\x85c d  x<|endoftext|>y", "İSTANBUL Σας ΣΑΣ é ́x", "　 x", "日本語 ▁ text\n\n", "👍🏽 ok", "x" * 3000]


def ids_of(text):
    return encoder(vocabulary_path()).model.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_memoised_ids_are_the_library_s(rows):
    texts = ODD + [t for _, t in rows]
    for t, ids in zip(texts, encoded(pa.array(texts, pa.string()), vocabulary_path()), strict=True):
        assert list(ids) == ids_of(t)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, rows, encoding):
    folder = token_folder(spark)
    write_token_files(docs, folder, encoding=encoding)
    out = {r["doc_id"]: r for r in token_checksums(read_tokens(spark, folder)).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = ids_of(t)
        assert (out[i]["start"], out[i]["n_tokens"], out[i]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert spark.read.parquet(folder).select("doc_id").count() == len(rows)


def test_token_files_odd_rows(spark, empty):
    folder = token_folder(spark)
    write_token_files(empty, folder)
    assert read_tokens(spark, folder).count() == 0
    folder = token_folder(spark)
    write_token_files(make(spark, [(None, "a b"), (2, "c"), (2, "c"), (1, None)]), folder)
    assert sorted((r["start"], r["doc_id"] or -1) for r in read_tokens(spark, folder).collect()) == [(0, -1), (3, 1), (4, 2), (6, 2)]


def test_packing_covers_every_id_once(spark, docs, rows):
    out = pack_documents(docs, capacity=64, block_tokens=4000).collect()
    truth = {i: ids_of(t) for i, t in rows}
    pieces, sequences = {}, {}
    for r in out:
        ids = truth[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(truth[r["doc_id"]]) and len(ids) == r["length"] > 0 and r["ids_crc32"] == crc(ids)
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in truth.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_odd_rows(spark, empty):
    assert pack_documents(empty).count() == 0
    out = pack_documents(make(spark, [(None, None), (3, ""), (3, "")])).collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in out) == [(-1, 1), (3, 1), (3, 1)]


def test_pack_wastes_little():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.choice([1, 2, rng.randrange(1, 60), rng.randrange(1, 300)]) for _ in range(rng.randrange(0, 40))]
        found = pack(lengths, 32)
        fewest = -(-sum(lengths) // 32)
        assert fewest <= len(found) <= fewest + max(1, fewest // 100) and all(sum(p[2] for p in own) <= 32 for own in found)
        cover = sorted((n, at, at + length) for own in found for n, at, length in own)
        assert [x for n, own in enumerate(lengths) if own for x in (n, 0)] == [x for i, (n, at, _) in enumerate(cover) if not i or cover[i - 1][0] != n for x in (n, at)]
        assert all(a[2] == b[1] for a, b in zip(cover, cover[1:], strict=False) if a[0] == b[0]) and sum(b - a for _, a, b in cover) == sum(lengths)


def test_window_count_rises_until_all_windows_fit():
    whole = 1.0  # rests are not cut
    assert sorted(pack([7, 7, 7], 11, whole)) == [[(0, 0, 7)], [(1, 0, 7)], [(2, 0, 7)]]
    assert len(pack([6] * 10, 11, whole)) == 10
    assert len(pack([5, 6, 4, 7, 3, 8], 11, whole)) == 3 and max(len(own) for own in pack([5, 6, 4, 7, 3, 8], 11, whole)) == 2
    assert len(pack([6] * 10, 11)) == 7  # parts of 3, three to a window


def test_padding_of_ordinary_lengths():
    """Of a block of documents, under one token in a hundred is padding; neighbouring parts are one piece."""
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(6.4, 1.0, 800), 5, 40_000).astype(int).tolist()
    found = pack(lengths)
    assert sum(lengths) > 0.99 * 2048 * len(found) and max(sum(p[2] for p in own) for own in found) <= 2048
    assert sum(map(len, found)) < 2.3 * len(lengths)
    assert not any(a[0] == b[0] and a[1] + a[2] == b[1] for own in found for a, b in zip(own, own[1:], strict=False))


def least_largest(sizes, k):
    best = sum(sizes)
    for owners in product(range(k), repeat=len(sizes)):
        sums = [0] * k
        for s, o in zip(sizes, owners, strict=True):
            sums[o] += s
        best = min(best, max(sums))
    return best


def test_differencing_against_exhaustive_search():
    """Near the best split, and never worse than its known bound of 4/3."""
    rng = random.Random(3)
    ratios = []
    for _ in range(60):
        k = rng.choice([2, 3])
        sizes = [rng.randrange(1, 50) for _ in range(rng.randrange(1, 9))]
        found = differencing(sizes, k)
        assert len(found) == k and sorted(i for own in found for i in own) == list(range(len(sizes)))
        ratios.append(max(sum(sizes[i] for i in own) for own in found) / least_largest(sizes, k))
    assert min(ratios) >= 1 and max(ratios) <= 4 / 3 and np.mean(ratios) < 1.05


def test_differencing_is_even():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 100) for _ in range(300)]
    sums = [sum(sizes[i] for i in own) for own in differencing(sizes, 7)]
    assert sorted(i for own in differencing(sizes, 7) for i in own) == list(range(300)) and max(sums) - min(sums) <= 5


def full_viterbi(coder, chars):
    """The search over all positions at once, for models with log probabilities."""
    best = [(0, -1, ())]
    for j, c in enumerate(chars, 1):
        raw = c.encode()
        top = (best[j - 1][0] + P.BYTE_SCORE * len(raw), j - 1, tuple(coder.byte_ids[b] for b in raw))
        for i in range(max(0, j - coder.longest), j):
            node = coder.root
            for x in chars[i:j]:
                node = node.get(x) if node else None
            if node and "" in node and best[i][0] + node[""][0] > top[0]:
                top = (best[i][0] + node[""][0], i, (node[""][1],))
        best.append(top)
    return coder._path(dict(enumerate(best)), 0, len(chars))


def merged_ids(coder, chars):
    """What merging neighbours one by one makes of ``chars``."""
    parts = list(chars)
    while True:
        ranks = [coder.rank.get(a + b, float("inf")) for a, b in zip(parts, parts[1:], strict=False)]
        if not ranks or min(ranks) == float("inf"):
            break
        at = ranks.index(min(ranks))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    ids = {text: n for n, text in ((n, b.decode().replace(" ", P.SPACE)) for n, b in coder.bytes_of.items() if n not in coder.byte_ids)}
    return [x for p in parts for x in ([ids[p]] if p in ids else [coder.byte_ids[b] for b in p.encode()])]


def test_ids_are_the_library_s(rows):
    """Of a merge-ranked model: the library's ids, whole texts of any kind; the search alone gives the same."""
    import sentencepiece

    path = vocabulary_path(P.MODEL)
    coder, library = P.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert coder.merges
    for text in [*ODD, *(t for _, t in rows if t)]:
        ids = coder.encode(text)
        assert coder.decode(ids) == text
        if "▁" not in text and text:
            assert ids.tolist() == library.encode(text)
            if len(text) < 2000:
                assert ids.tolist() == list(coder.stream("▁" + text.replace(" ", "▁")))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc", max_size=60), st.permutations(["ab", "ba", "aa", "bb"]), st.permutations(["aab", "abb", "bab", "aba", "aaa", "bbb", "cab"]), st.permutations(["abab", "aabb", "baab"]))
def test_search_equals_merging(text, twos, threes, fours):
    """Any ranks behind those of their parts, ties of places and pieces that merging never makes."""
    singles = [("a", 300, -90.0), ("b", 301, -91.0)]
    coder = P.PieceCoder([*singles, *((x, 302 + k, float(-k)) for k, x in enumerate([*twos, *threes, *fours]))], list(range(256)), merges=True)
    assert list(coder.stream(text)) == merged_ids(coder, text)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc", max_size=80), st.lists(st.floats(-9, -0.5), min_size=8, max_size=8))
def test_streaming_viterbi_equals_the_full_search(text, scores):
    pieces = ["a", "b", "ab", "ba", "aab", "abb", "bab", "abab"]
    coder = P.PieceCoder([(x, 300 + k, s) for k, (x, s) in enumerate(zip(pieces, scores, strict=True))], list(range(256)))
    assert list(coder.stream(text)) == full_viterbi(coder, text)


def test_streaming_window_is_bounded():
    """Pieces that overlap for ever: the window still commits where paths meet."""
    coder = P.PieceCoder([("ab", 300, -1.0), ("ba", 301, -1.0), ("a", 302, -3.0), ("b", 303, -3.0)], list(range(256)))
    text = "ab" * 5000
    assert list(coder.stream(text)) == [300] * 5000 == full_viterbi(coder, text)


def test_round_trip(docs, rows, empty):
    import hashlib

    assert P.round_trip(empty).count() == 0
    out = {r["doc_id"]: r for r in P.round_trip(docs).collect()}
    coder = P.load(vocabulary_path(P.MODEL))
    for i, t in rows:
        ids = coder.encode(t or "")
        assert (out[i]["n_tokens"], out[i]["ids_crc32"], out[i]["decoded_sha256"]) == (len(ids), crc(ids), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r["doc_id"]: r["text"] for r in P.decode(P.encode(docs)).collect()} == {i: t or "" for i, t in rows}


def least_capacity(groups, shards):
    def fits(c):
        used, held = 1, 0
        for g in groups:
            if held + g > c:
                used, held = used + 1, 0
            held += g
        return used <= shards

    low, high = max(groups), sum(groups)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def test_sharding(docs, rows):
    import hashlib

    out = {r["doc_id"]: r for r in shard_documents(docs).collect()}
    text = {i: (t or "").encode() for i, t in rows}
    groups = {}
    for i, b in text.items():
        assert (out[i]["size"], out[i]["text_crc32"], out[i]["law"], out[i]["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "bytes", None)
        groups.setdefault(hashlib.sha256(b).digest(), []).append(i)
    assert all(len({out[i]["shard"] for i in own}) == 1 for own in groups.values())
    sizes = {}
    for r in out.values():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert max(sizes.values()) == least_capacity([sum(len(text[i]) + 1 for i in groups[k]) for k in sorted(groups)], 8)
    for k in sizes:
        own = sorted(r["slot"] for r in out.values() if r["shard"] == k)
        assert own == list(range(len(own))) and 0 <= k <= 7


def test_ends_against_a_list(spark):
    """Lookups and the least capacity, with a table too coarse to hold the answers."""
    from docflow.llm import sharding as S

    rng = random.Random(6)
    for _ in range(4):
        sizes = [rng.choice([1, 5, rng.randrange(1, 400)]) for _ in range(rng.randrange(9, 120))]
        places = [0, *np.cumsum(sizes).tolist()]
        frame = spark.createDataFrame([(x,) for x in places[1:]], "end long")
        old, S.FIRST_SPLIT, S.SPLIT = (S.FIRST_SPLIT, S.SPLIT), 5, 3
        try:
            ends = S.Ends(frame, places[-1])
            capacity = S.smallest_capacity(ends, max(sizes), 4)
            assert capacity == least_capacity(sizes, 4)
            for x in rng.sample(range(places[-1]), 3):
                assert ends.floor(x) == max(p for p in places if p <= x) and ends.ceil(x) == min(p for p in places if p >= x)
            cut = S.cuts(ends, capacity, 4)
            assert max(b - a for a, b in zip([0, *cut], [*cut, places[-1]], strict=True)) <= capacity and set(cut) <= set(places)
        finally:
            S.FIRST_SPLIT, S.SPLIT = old


def test_sharding_odd_rows(spark, empty):
    assert shard_documents(empty).count() == 0
    out = shard_documents(make(spark, [(None, "a"), (None, None), (4, "b" * 900), (4, "b" * 900)])).collect()
    assert len(out) == 4 and len({r["shard"] for r in out if r["doc_id"] == 4}) == 1
