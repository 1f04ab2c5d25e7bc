"""What a query does at size: what is made once stays made once, and memory does not follow the data."""

import random
import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docflow.functions import fuzzy as Z
from docflow.functions import latex as L
from docflow.functions import layout as Y
from docflow.operators import compare as C
from docflow.operators import filters as P
from docflow.operators import language as N
from docflow.operators import packs as K
from docflow.operators import spans as B
from docflow.sources import bundles as U


def test_replicates_hold_a_byte_a_game():
    """A bootstrapped rating of 400,000 games takes no list of them."""

    class Captured(Exception):
        pass

    class Session:
        def range(self, n):
            return self

        def mapInPandas(self, run, layout):  # noqa: N802
            raise Captured(run)

    pairs = [("a", "b", 150_000, 50_000), ("a", "c", 80_000, 20_000), ("b", "c", 50_000, 50_000)]
    with pytest.raises(Captured) as held:
        C.bootstrap_elo(pairs, Session(), 1)
    tracemalloc.start()
    out = list(held.value.args[0](iter([pd.DataFrame({"id": [3]})])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(out[0]["method"]) <= {"a", "b", "c"} and out[0]["rating"].mean() == pytest.approx(1500)
    assert peak < 16_000_000


def test_columns_of_elements_are_written_like_lists(spark):
    rows = [(k, [((7 * k * j) % 13 * 10.0, j * 10.0, f"w{j}") for j in range(k)]) for k in range(12)] + [(12, None)]
    df = spark.createDataFrame(rows, "k long, e array<struct<x double, y double, text string>>")
    got = {r["k"]: r["out"] for r in df.select("k", L.linearize_column(F.col("e"), 40, F.col("k")).alias("out")).collect()}
    assert got == {k: L.linearize([{"x": x, "y": y, "text": t} for x, y, t in e or []], 40, k) for k, e in rows}


def test_pairs_of_a_group_are_compared_once(spark):
    rows = spark.createDataFrame([(g, k, "kitten sitting mitten"[k : k + 9 + g]) for g in range(3) for k in range(5)], "g int, k int, x string")
    means = C.pair_means(rows, "g", "k", "x")
    assert "< k2" in means._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["g"], r["k"]): r["mean"] for r in means.collect()}
    text = {(r["g"], r["k"]): r["x"] for r in rows.collect()}
    far = lambda a, b: Z.edit_distance(a, b) / max(len(a), len(b))
    assert got == {(g, k): pytest.approx(sum(far(x, text[g, o]) for o in range(5) if o != k) / 4, abs=1e-8) for (g, k), x in text.items()}


def test_runs_are_found_once_a_text(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    runs = spark.range(1).select(K.gap_runs(F.split(F.col("id").cast("string"), "1"), "-", 2).alias("r"))
    assert plan(runs).count("split(") == 1
    asked = entry.queries()["win_08_short_word_runs"](spark, "/root/testdata/sf0.001")
    assert plan(asked).count("split(") == 1


def test_symbols_lie_in_the_range_that_is_tested_first(spark):
    rows = spark.createDataFrame([(s, f"a {s} b", f"a <table>{s}</table> b") for s in [*P.MATH_SYMBOLS, "x", "\u2261"]], "s string, t string, u string")
    got = {r["s"]: (r["out"], r["inside"]) for r in rows.select("s", P.has_math_symbols(F.col("t")).alias("out"), P.has_math_symbols(F.col("u")).alias("inside")).collect()}
    assert got == {s: (s in P.MATH_SYMBOLS, False) for s in got}
    assert "2200" in rows.select(P.has_math_symbols(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_languages_looked_up_and_joined_agree(spark, monkeypatch):
    """Where the profile is held and where it is joined; the profile is counted once, from words."""
    rows = [(k, ("de", "en", None)[k % 3], t) for k, t in enumerate(["der Hund und die Katze", "the dog and the cat", "und the  _a_", "Ein Haus, ein Baum!", "a house-a tree", "\U00010428\U00010428 \u00c4\u00d6", "", None, "...", "x"] * 2)]
    docs = spark.createDataFrame(rows, "id long, lang string, text string")
    table, names = N.profiles(docs)
    assert names == ["de", "en"] and "split(" not in table._jdf.queryExecution().optimizedPlan().toString()
    out = lambda: sorted(map(tuple, N.detect(docs, "id", table, names, keep=("lang",)).collect()))
    held = out()
    monkeypatch.setattr(N, "HELD_SCORES", 0)
    assert held == out() and len(held) == len(rows) and {r[3] for r in held} == {"de", "en", "unknown"}


def test_small_pages_are_grouped_like_large_ones(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(p if p < 7 else None, k, *(lambda x, y: (x, y, x + rng.random() * 9 - 1, y + rng.random() * 3))(rng.random() * 40, rng.random() * 9)) for p in range(8) for k in range(12)] + [(1, 99, None, 0.0, 1.0, 1.0)]
    boxes = spark.createDataFrame(rows, "p int, k int, x0 double, y0 double, x1 double, y1 double")
    out = lambda: sorted(map(str, B.box_groups(boxes, "p", "k", 0.5, (16.0, 1.0)).collect()))
    held = out()
    assert "Join" not in B.box_groups(boxes, "p", "k", 0.5, (16.0, 1.0))._jdf.queryExecution().optimizedPlan().toString()
    for most in (0, 11):
        monkeypatch.setattr(B, "ROW_BOXES", most)
        assert out() == held and len(held) == len(rows)


def test_equal_formulas_need_no_search(monkeypatch):
    spans = [{"text": "ab", "x": 3.0 * k, "y": 7.0 * (k % 3), "w": 4.0, "h": 4.0} for k in range(6)]
    near = Y._nearest(Y._symbols(spans), 5)
    slow = lambda s, x, y, dx, dy: min((((ox - x) * dx + (oy - y) * dy, k) for k, (_, ox, oy) in enumerate(s) if (ox - x) * dx + (oy - y) * dy > 0 and (abs(oy - y) if dx else abs(ox - x)) <= 5), default=(0, None))[1]
    assert near == [[slow(Y._symbols(spans), x, y, *side) for side in Y.SIDES] for _, x, y in Y._symbols(spans)]
    monkeypatch.setattr(Y, "_nearest", None)
    assert Y.same_layout(spans, list(spans)) and Y.same_layout([], [])


def test_bundles_forget_what_they_have_passed(tmp_path):
    """A tar file of many members is written and read without a list of them."""
    writer = U.BundleWriter(str(tmp_path), U.LIMIT, False)
    n, names = 20_000, [f"{k:08d}" for k in range(20_000)]
    batches = (pa.RecordBatch.from_pydict({"bundle": ["b"] * 1000, "name": names[lo : lo + 1000], "content": [b"x"] * 1000}) for lo in range(0, n, 1000))
    tracemalloc.start()
    message = writer.write(batches)
    wrote = tracemalloc.get_traced_memory()[1]
    writer.commit([message])
    reader = U.BundleReader(str(tmp_path))
    (part,) = reader.partitions()
    tracemalloc.reset_peak()
    start = tracemalloc.get_traced_memory()[0]
    assert sum(1 for _ in reader.read(part)) == n
    read = tracemalloc.get_traced_memory()[1] - start
    tracemalloc.stop()
    print("peak MB written, read:", wrote / 1e6, read / 1e6)
    assert wrote < 6_000_000 and read < 3_000_000
