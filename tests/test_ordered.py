import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docflow.operators import packs as K
from docflow.operators.graph import components
from docflow.operators.ordered import numbered
from docflow.operators.presence import passages_in
from docflow.operators.spans import around, box_groups, overlapping
from docflow.plans import extensions as E


def rows(n=400, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(30)]), rng.choice([None, *range(50)]), k) for k in range(n)]


def table(spark, data):
    return spark.createDataFrame(data, "g string, o long, s long, k long").repartition(7)


def test_numbered(spark):
    data = rows()
    got = numbered(table(spark, data).withColumn("row_", F.lit(1)), ["g"], ["o"], "s", ["k", "s"]).collect()
    assert len(got) == len(data) and {r["k"] for r in got} == set(range(len(data)))
    for g in ("a", "b", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["row"])
        assert [r["row"] for r in own] == list(range(len(own))) and {r["rows"] for r in own} == {len(own)}
        keys = [-1 if r["o"] is None else r["o"] for r in own]
        assert keys == sorted(keys)
        total, before = 0, None
        for r in own:
            assert r["before"] == total and (r["previous"] and tuple(r["previous"])) == before
            total, before = total + (r["s"] or 0), (r["k"], r["s"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=120), st.integers(1, 9), st.integers(0, 40))
def test_passages_compose(costs, width, held):
    limit = 40
    blocks = [np.array(costs[k : k + width]) for k in range(0, len(costs), width)]
    one = K.passage(blocks[0], limit)
    for b in blocks[1:]:
        one = one.then(K.passage(b, limit), limit)
    now, closed = held, 0
    for cost in costs:
        if now and now + cost > limit:
            now, closed = 0, closed + 1
        now += cost
    left, more = one.leave(np.array([held]), limit)
    assert (int(left[0]), int(more[0])) == (now, closed)


@pytest.mark.parametrize("block,fan", [(1 << 16, 64), (5, 2), (1, 3)])
def test_bins(spark, monkeypatch, block, fan):
    """Blocks and levels of any size give the bins of a walk over all rows; no row is lost or doubled."""
    monkeypatch.setattr(K, "BLOCK_ROWS", block)
    monkeypatch.setattr(K, "FAN", fan)
    data = rows(150 if block < 9 else 400, 2)
    got = K.bin_rows(table(spark, data), "g", "o", "s", 100, 10).collect()
    assert sorted(r["k"] for r in got) == list(range(len(data)))
    for g in ("a", "b", None):
        own = [r for r in got if r["g"] == g]
        sums = {}
        for r in own:
            sums[r["bin"]] = sums.get(r["bin"], 0) + (r["s"] or 0) + 10
        assert sorted(sums) == list(range(len(sums))) and max(sums.values()) <= 100
        order = sorted(own, key=lambda r: (r["bin"], -1 if r["o"] is None else r["o"]))
        keys = [-1 if r["o"] is None else r["o"] for r in order]
        assert keys == sorted(keys)
        least = {}
        for r in own:
            least.setdefault(r["bin"], []).append((r["s"] or 0) + 10)
        assert all(sums[b] + max(least[b + 1]) > 100 for b in sums if b + 1 in sums)


def test_bins_refuse_what_fits_nowhere(spark):
    with pytest.raises(Exception, match="exceeds the bin size"):
        K.bin_rows(table(spark, [("a", 1, 95, 1)]), "g", "o", "s", 100, 10).collect()
    assert K.bin_rows(table(spark, []), "g", "o", "s", 100).count() == 0


def test_evaluate_keeps_every_pair(spark):
    pairs = spark.createDataFrame([("x", "a b", "a b"), ("x", "a c", "a b"), (None, "q", "q"), ("y", None, "z")], "rel string, pred string, target string")
    out = E.evaluate(pairs, ["formula", "reading_order", "text_edit"]).collect()
    assert sorted(str(r["rel"]) for r in out) == ["None", "average", "x", "x", "y"] and out[0]["rel"] == "average"
    assert sorted(r["text_edit"] for r in out if r["rel"] == "x") == [0.0, pytest.approx(1 / 3, abs=1e-4)]


def test_passages_in(spark):
    texts = ["the cat sat on the mat", "THE CAT", "", None, "a", "cat sat on the mat and the dog ran away", "été"]
    asked = [(1, "cat sat on the mat"), (2, ""), (3, None), (4, "a"), (5, "AT SAT"), (6, "the dog ran away home"), (7, "É"), (1, "cat sat on the mat"), (None, "the dog")]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, "a second text of one key")], "d long, text string").repartition(3)
    got = {tuple(r) for r in passages_in(spark.createDataFrame(asked, "i long, text string"), "i", docs, "d").collect()}
    assert got == {(i, d) for i, p in asked if p for d, x in [*enumerate(texts), (0, "a second text of one key")] if x and p.lower() in x.lower()}


def test_overlaps_and_surroundings(spark):
    rng = random.Random(4)
    spans = lambda n, most, key: [(rng.choice(key), a := rng.randrange(3000), a + rng.choice([0, 1, 5, most]), k) for k in range(n)]
    left, right = spans(60, 40, "xy") + [("x", 0, 4000, 99), ("y", None, 3, 98)], spans(60, 900, "xyz")
    frame = lambda data: spark.createDataFrame(data, "key string, start long, end long, n long")
    got = [(r["n"], r["r_n"]) for r in overlapping(frame(left), frame(right), "key", 64).collect()]
    want = [(a[3], b[3]) for a in left for b in right if a[0] == b[0] and a[1] is not None and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2]]
    assert sorted(got) == sorted(want) and len(want) > 30
    units = [(k, i, 10 * i, 10 * i + 10) for k in "xy" for i in range(20)]
    gaps = spark.createDataFrame([("x", 0, 1), ("x", 95, 105), ("y", 0, 200), ("y", 199, 200)], "key string, start long, end long")
    out = {tuple(r) for r in around(gaps, spark.createDataFrame(units, "key string, i long, start long, end long"), "key", 2, 16).collect()}
    assert out == {("x", 0, 1, 0, 2, 0, 30), ("x", 95, 105, 7, 12, 70, 130), ("y", 0, 200, 0, 19, 0, 200), ("y", 199, 200, 17, 19, 170, 200)}


def test_components_and_box_groups(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 99), (99, 98), (98, 105), (7, 7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 98 for k in (98, 99, 100, 105)}}
    rng = random.Random(6)
    boxes = []
    for page in (1, 2):
        for k in range(60):
            x, y = rng.uniform(-50, 50), rng.uniform(0, 50)
            boxes.append((page, k, x, y, x + rng.uniform(0, 6), y + rng.uniform(0, 6)))
    boxes += [(1, 900, None, 0.0, 1.0, 1.0), (1, 901, 5.0, 0.0, 1.0, 1.0), (2, 902, -60.0, 20.0, 60.0, 21.0)]
    out = box_groups(spark.createDataFrame(boxes, "page long, k long, x0 double, y0 double, x1 double, y1 double"), "page", "k", 0.7, (9.0, 4.0)).collect()
    assert len(out) == len(boxes)
    parent = {(p, k): (p, k) for p, k, *_ in boxes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [b for b in boxes if b[2] is not None and b[2] <= b[4]]
    for a, b in combinations(good, 2):
        if a[0] == b[0] and max(a[2], b[2]) - min(a[4], b[4]) <= 0.7 and max(a[3], b[3]) - min(a[5], b[5]) <= 0.7:
            x, y = find(a[:2]), find(b[:2])
            parent[max(x, y)] = min(x, y)
    assert {(r["page"], r["k"]): (r["page"], r["group"]) for r in out} == {k: find(k) for k in parent}
