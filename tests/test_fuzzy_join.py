import random

import pytest
from pyspark.sql import functions as F

from docflow.functions import fuzzy as Z
from docflow.operators.fuzzy_join import fuzzy_join, order_join, viewed

PASSAGES = "item_id long, text string, diffs int, cased boolean, first_n int, last_n int"


def holds(passage, diffs, body):
    """Every window of the passage's length, cut at the ends."""
    m = len(passage)
    windows = (body[max(s, 0) : s + m] for s in range(1 - m, len(body)))
    return any(2 * Z.lcs_length(passage, w) * m >= (m - diffs) * (m + len(w)) for w in windows if w)


def changed(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "#"
        elif kind == 1:
            out.insert(at, "@")
        elif len(out) > 2:
            del out[at]
    return "".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocab = ["the", "of", "Été", "café", "a,", "**bold**", "“quote”", "x_y", "\n", "straße", "漢字"] + [f"w{k}" for k in range(40)]
    made = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 90))) for _ in range(25)]
    return [(k, t) for k, t in enumerate(made)] + [(100, None), (101, ""), (102, "  "), (103, "ab"), (104, "word " * 2000)]


@pytest.fixture(scope="module")
def passages(texts):
    rng = random.Random(12)
    rows = []
    for k in range(60):
        _, source = texts[rng.randrange(25)]
        at = rng.randrange(max(len(source) - 20, 1))
        own = source[at : at + rng.randrange(5, 60)]
        diffs = rng.randrange(5)
        n = rng.randrange(diffs + 2)
        first, last = rng.choice([(None, None), (None, None), (80, None), (None, 60), (30, 40), (0, 0)])
        rows.append((k, changed(rng, own, n) if own and n else own, diffs, rng.choice([True, False, None]), first, last))
    odd = [(200, None, 1), (201, "", 0), (202, " \n ", 1), (203, "abc", 5), (204, "the", None), (205, "the", -1), (206, "of", 0), (207, "word", 0), (None, "w1 w", 0), (208, "w2 w", 0), (208, "w3 w", 0)]
    return rows + [(i, t, d, False, None, None) for i, t, d in odd]


def test_presence(spark, texts, passages):
    docs = spark.createDataFrame(texts + [(7, "another text of one key, w2 w"), (None, "no key has w3 w")], "doc_id long, text string").repartition(3)
    docs = docs.withColumn("needle", F.lit(1)).withColumn("passage", F.lit("x"))
    got = {tuple(r) for r in fuzzy_join(spark.createDataFrame(passages, PASSAGES), "item_id", docs, "doc_id").collect()}
    want = set()
    for i, text, diffs, cased, first, last in passages:
        passage = viewed(text, bool(cased), None, None)
        if diffs is None or diffs < 0 or not passage.strip() or len(passage) // (2 * diffs + 1) == 0:
            continue
        for j, body in [(r["doc_id"], r["text"]) for r in docs.collect()]:
            if body is not None and holds(passage, diffs, viewed(body, bool(cased), first, last)):
                want.add((i, j))
    assert got == want and len({i for i, _ in want}) > 30 and any(d[2] > 1 and (d[0], 0) not in want for d in passages if d[2])


def test_order(spark, texts):
    rng = random.Random(13)
    rows = []
    for k in range(40):
        source = Z.normalize(texts[rng.randrange(25)][1])
        cut = rng.randrange(len(source))
        a, b = source[max(cut - 25, 0) : cut], source[cut : cut + 25]
        diffs = rng.randrange(3)
        a, b = (changed(rng, x, rng.randrange(diffs + 2)) if x else x for x in (a, b))
        rows.append((k, a, b, diffs) if rng.random() < 0.7 else (k, b, a, diffs))
    rows += [(100, None, "of", 0), (101, "", "of", 0), (102, "ab", "the", 2), (103, "the", "of", 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {tuple(r) for r in order_join(spark.createDataFrame(rows, "item_id long, before string, after string, diffs int"), "item_id", docs, "doc_id").collect()}
    want = set()
    for i, before, after, diffs in rows:
        if before is None or diffs > len(before) // 2 or diffs > len(after) // 2:
            continue
        before, after = Z.normalize(before), Z.normalize(after)
        if not before.strip() or not after.strip() or min(len(before), len(after)) // (diffs + 1) == 0:
            continue
        for j, text in texts:
            body = viewed(text, True, None, None) if text is not None else ""
            x, y = Z.near_matches(before, body, diffs), Z.near_matches(after, body, diffs)
            if x and y and min(m[0] for m in x) < max(m[0] for m in y):
                want.add((i, j))
    assert got == want and len(want) > 10


def test_nothing(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], PASSAGES)
    assert fuzzy_join(none, "item_id", docs, "doc_id").count() == 0
    assert fuzzy_join(spark.createDataFrame([(1, "text", 0, None, None, None)], PASSAGES), "item_id", docs.limit(0), "doc_id").count() == 0
