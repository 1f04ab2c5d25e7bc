import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docflow.llm import token_alignment as ta
from docflow.llm.token_alignment import align, align_tokens
from tests.llm.conftest import make

ODD = [(200, "a  b \n c\td"), (201, " lead and trail "), (202, "x▁y"), (203, " no​break café 漢字 \U0001f600!"), (204, "it's <s> <|endoftext|> <0x41> 's"), (205, "\x00\x1c end"), (206, "word " * 3000), (207, "x" * 5000), (None, "null id"), (208, "twice"), (208, "twice")]


def encoders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def truth(rows):
    """Groups and links by walking over both token lists, one byte end at a time."""
    a, b = encoders()
    level = ta.byte_level()
    docs, holds, out = [], Counter(), []
    for i, text in rows:
        links, groups = [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            spell_a = [bytes(level[c] for c in a.id_to_token(k)) for k in ids_a]
            spell_b = [bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
            if b"".join(spell_a) == (" " + text).encode() == b"".join(spell_b):
                at_a, at_b = np.cumsum([len(x) for x in spell_a]).tolist(), np.cumsum([len(x) for x in spell_b]).tolist()
                p = q = 0
                open_a, open_b = [], []
                while p < len(ids_a):
                    links.append((ids_a[p], ids_b[q]))
                    open_a += [] if open_a and open_a[-1] == p else [p]
                    open_b += [] if open_b and open_b[-1] == q else [q]
                    end_a, end_b = at_a[p], at_b[q]
                    if end_a == end_b:
                        groups.append(",".join(str(ids_a[k]) for k in open_a) + "|" + ",".join(str(ids_b[k]) for k in open_b))
                        open_a, open_b = [], []
                    p, q = p + (end_a <= end_b), q + (end_b <= end_a)
                docs.append((i, len(ids_a), len(ids_b), groups, links))
                holds.update(set(links))
                continue
        docs.append((i, 0, 0, [], []))
    best = defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    for i, n_a, n_b, groups, links in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(groups), len(links), sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links), digest))
    return Counter(out)


@pytest.mark.parametrize("frequent", [ta.FREQUENT, 50, 0])
def test_align_tokens(spark, rows, frequent):
    """Against a walk over both token lists; pairs looked up, shuffled, or both."""
    rows = rows + ODD
    got = align_tokens(make(spark, rows).withColumn("pair", F.lit(1)).withColumn("row", F.lit("x")), frequent=frequent)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == columns
    assert Counter(tuple(r) for r in got.collect()) == truth(rows)


def test_align_tokens_of_nothing(spark, empty):
    assert align_tokens(empty).count() == 0
    zero = align_tokens(make(spark, [(1, None), (2, ""), (3, "▁")])).collect()
    assert sorted(tuple(r) for r in zero) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]


def test_parts_give_the_ids_of_whole_texts(rows):
    paths = [str(public_tokenizers.path(x)) for x in (ta.VOCABULARY_A, ta.VOCABULARY_B)]
    coder, (a, b) = ta.Coders(*paths), encoders()
    texts = [t for _, t in rows + ODD if t]
    for text, found in zip(texts, coder.spelled(texts), strict=True):
        assert found.a.tolist() == a.encode(" " + text, add_special_tokens=False).ids
        assert found.b.tolist() == b.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.randoms()), min_size=1, max_size=5))
def test_links_of_random_cuts(cases):
    """Each link is a pair of overlapping ranges; there are no others."""
    sizes_a, sizes_b, totals = [], [], []
    for sizes, rng in cases:
        left, other = sum(sizes), []
        while left:
            other.append(rng.randint(1, left))
            left -= other[-1]
        sizes_a += sizes
        sizes_b += other
        totals.append(sum(sizes))
    found = align(np.array(sizes_a), np.array(sizes_b), np.array(totals))
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    want = {(i, j) for i in range(len(sizes_a)) for j in range(len(sizes_b)) if max(ends_a[i] - sizes_a[i], ends_b[j] - sizes_b[j]) < min(ends_a[i], ends_b[j])}
    assert sorted(zip(found.a.tolist(), found.b.tolist(), strict=True)) == sorted(want)
    assert found.ends_group.sum() == len(set(ends_a.tolist()) & set(ends_b.tolist()))
    assert found.documents[-1] == len(found.a)
