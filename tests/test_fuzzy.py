"""Fuzzy matching, presence and repeats against plain definitions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.functions import fuzzy as Z
from docflow.functions import html as H
from docflow.operators.filters import trailing_repeats
from docflow.operators.presence import passages_in
from docflow.plans import extensions as E


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def pairs(count=150):
    rng = random.Random(1)
    for _ in range(count):
        n = rng.choice([1, 3, 10, 63, 64, 65, 130])
        a = "".join(rng.choice("abcde é") for _ in range(n))
        b = "".join(rng.choice("abcdef ") for _ in range(rng.randrange(0, 160)))
        if rng.random() < 0.5:
            b = b[:50] + a[: n // 2] + "x" + a[n // 2 + 1 :] + b[50:]
        yield a, b


def test_distances_and_ratios():
    for a, b in pairs():
        assert Z.edit_distance(a, b) == levenshtein(a, b)
        assert Z.lcs_length(a, b) == subsequence(a, b)


def test_partial_ratio_looks_at_every_window():
    for a, b in pairs(60):
        query, text = sorted((a, b), key=len)
        n = len(query)
        best = max((Z.ratio(query, text[max(s, 0) : s + n]) for s in range(1 - n, len(text))), default=0.0)
        assert Z.partial_ratio(a, b) == pytest.approx(best if query else 0.0)
    assert Z.partial_ratio("", "") == 1 and Z.partial_ratio("", "a") == 0
    text = "x" * 120_000 + "the needle is herf" + "y" * 80_000
    assert Z.partial_ratio("the needle is here", text) == pytest.approx(34 / 36)


def test_near_matches_and_best_substring():
    for a, b in pairs(60):
        pattern = a[:9]
        for s, e, d in Z.near_matches(pattern, b, 2):
            assert levenshtein(pattern, b[s:e]) == d <= 2
        least = min(levenshtein(pattern, b[s:e]) for s in range(len(b) + 1) for e in range(s, min(len(b), s + 2 * len(pattern)) + 1))
        assert bool(Z.near_matches(pattern, b, 2)) == (least <= 2 and any(levenshtein(pattern, b[s:e]) <= 2 for s in range(len(b)) for e in range(s + 1, min(len(b), s + 12) + 1)))
        s, e, similarity = Z.best_substring(pattern, b)
        assert similarity == pytest.approx(max(0.0, 1 - least / len(pattern))) and levenshtein(pattern, b[s:e]) == least
    assert Z.near_matches("", "abc", 2) == []


def test_alignment_halves_to_the_same_score():
    for a, b in pairs(60):
        scores = []
        for cells in (1 << 22, 40):
            old, Z._CELLS = Z._CELLS, cells
            try:
                x, y = Z.align(list(a), list(b))
            finally:
                Z._CELLS = old
            assert [c for c in x if c != "▁"] == list(a) and [c for c in y if c != "▁"] == list(b)
            scores.append(sum(1 if p == q else -1 for p, q in zip(x, y, strict=True)))
        assert scores[0] == scores[1]


def repeats(text, sizes=5):
    text, out = re.sub(r"\s+", " ", text), []
    for n in range(1, sizes + 1):
        count, at = 0, len(text) - n
        while at >= 0 and text[at : at + n] == text[-n:]:
            count, at = count + 1, at - n
        out.append(count)
    return out


def test_trailing_repeats(spark):
    texts = ["", "a", "ab\n", "abab", "xabab  \n", "aaa\n\n", "a\u00a0 \u2003", "abcabcabc", "a b a b ", " ", "end " * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", trailing_repeats(F.col("t")).alias("r"))
    assert {r["k"]: r["r"] for r in rows.collect()} == {k: repeats(t) for k, t in enumerate(texts)}


def test_passages_in(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) for _ in range(n))
    docs = [(k, text(60)) for k in range(30)] + [(30, None), (31, ""), (32, "x" + "AB cd " * 40 + "y")]
    items = [(k, docs[k][1][3 : 3 + size]) for k, size in enumerate([100, 60, 40, 20, 9, 5, 2, 1])] + [(8, "b cd ab cd ab c"), (9, "nowhere at all to be found in these"), (10, None)]
    found = passages_in(spark.createDataFrame(items, "item int, text string"), "item", spark.createDataFrame(docs, "doc int, text string"), "doc")
    truth = {(i, d) for i, p in items for d, t in docs if p is not None and t is not None and p.lower() in t.lower()}
    out = [tuple(r) for r in found.collect()]
    assert len(out) == len(set(out)) and set(out) == truth


PAGE = """<html lang="pt-BR"><head><title>t</title></head><body><header>{head}</header><p>Water is H<sub>2</sub>O, x<sup>i</sup> and a<sub>k</sub>.</p>
<img src="i.png"/>{images}<table><tr><td>{cell}</td></tr></table><div class="page-footer">page 7</div><footer>{head}</footer></body></html>"""


def test_page_metadata():
    page = lambda head="", images="", cell="c": PAGE.format(head=head, images=images, cell=cell)
    block = '<div class="image fig"><p>caption</p></div>'
    assert H.metadata(page()) == {"primary_language": "pt", "is_table": False, "is_diagram": False}
    assert not H.metadata(page(head="h" * 900, cell="c" * 30))["is_table"]
    assert H.metadata(page(head="h" * 900, cell="c" * 300))["is_table"]  # header and footer do not count
    assert H.metadata(page(images=block))["is_diagram"] and not H.metadata(page(images="<img/>" * 9))["is_diagram"]
    assert not H.metadata(page(head=block))["is_diagram"]
    assert H.metadata(None) == {"primary_language": "en", "is_table": False, "is_diagram": False}
    assert H.metadata('<html lang="zh-Hans"><body>x</body></html>')["primary_language"] == "zh-Hans"


def test_page_markdown():
    text = H.to_markdown(PAGE.format(head="Running head", images='<div class="image"><p>caption</p></div>', cell="c<sup>2</sup>"))
    assert "Water is H₂O, xⁱ and aₖ." in text and "![Image Placeholder](page.png)" in text and "c²" in text
    assert "Running head" not in text and "page 7" not in text and "caption" not in text
    assert H.to_page("<body></body>").endswith("---") and H.to_markdown("<p>---</p><p>x</p><p>---</p>") == "x"


def test_box_scores():
    assert E.box_scores([[0, 0, 2, 2], [10, 0, 2, 2]], [[0, 0, 2, 2], [10, 0, 2, 1], [50, 0, 1, 1]]) == {"iou": pytest.approx(0.5), "pairs": 2.0}
    assert E.box_scores([], []) == {"iou": None, "pairs": 0.0}


def test_update_stream_keeps_keys_of_earlier_batches(spark, tmp_path):
    from docflow.streaming import metrics as M

    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int").coalesce(1).write.parquet(folder)
    run = lambda: {tuple(r) for r in M.run_available(spark.readStream.schema("k string, v int").option("maxFilesPerTrigger", 1).parquet(folder).groupBy("k").agg(F.sum("v").alias("n")), str(tmp_path / "out"), str(tmp_path / "state"), "update", ["k"]).collect()}
    assert run() == {("a", 1), ("b", 1)}
    spark.createDataFrame([("a", 5)], "k string, v int").coalesce(1).write.mode("append").parquet(folder)
    assert run() == {("a", 6), ("b", 1)}
    with pytest.raises(ValueError, match="keys"):
        M.run_available(spark.readStream.schema("k string").parquet(folder), "x", "y", "update")


def test_bootstrap_interval_holds_the_mean(spark):
    from docflow.operators.compare import bootstrap_interval

    rows = [(g, float(k % 4 == 0), k) for g in ("a", "b") for k in range(400)] + [("a", None, 0)]
    out = bootstrap_interval(spark.createDataFrame(rows, "g string, s double, k int"), "g", "s", 500).first()
    assert 0.2 < out["low"] < 0.25 < out["high"] < 0.3


def test_bins_restart_by_group_and_refuse_large_items(spark):
    from docflow.operators.packs import bin_rows

    rows = [(g, k, 40) for g in ("a", None, "b") for k in range(5)]
    df = spark.createDataFrame(rows, "g string, k int, s int")
    out = sorted((r["g"] or "", r["k"], r["bin"]) for r in bin_rows(df, "g", "k", "s", 100, 10).collect())
    assert out == [(g, k, k // 2) for g in ("", "a", "b") for k in range(5)]  # a null group is a group
    with pytest.raises(Exception, match="exceeds the bin size"):
        bin_rows(df, "g", "k", "s", 40, 10).collect()


def test_pieces_decide_like_the_whole_table(monkeypatch):
    """Windows and matches around exact pieces are those of the whole text, of which only stretches are read."""
    rng, letters = random.Random(3), "abcd "
    for k in range(3000):
        text = "".join(rng.choice(letters[: 2 + k % 4]) for _ in range(rng.randint(1, 90)))
        at = rng.randrange(len(text))
        query = list(text[at : at + rng.randint(8, 40)])
        for _ in range(rng.randint(0, 3)):
            query.insert(rng.randrange(len(query)), rng.choice("ab#"))
            del query[rng.randrange(len(query))]
        query, most = "".join(query), rng.randint(0, 3)
        assert Z.holds(query, text, most) == (Z.partial_ratio(query, text) >= 1 - most / len(query) - 1e-12)
        assert not most or Z.near_matches(query, text, most) == Z._near(query, text, most)
    read: list[int] = []
    ends = Z._ends
    monkeypatch.setattr(Z, "_ends", lambda pattern, text: (read.append(len(text)), ends(pattern, text))[1])
    text = "x" * 50_000 + "the quick brown fox" + "y" * 50_000
    assert Z.near_matches("the quick brawn fox", text, 2) == [(50_000, 50_019, 1)] and sum(read) < 500


def test_closest_compares_only_what_can_win(monkeypatch):
    import difflib

    rng = random.Random(6)
    texts = [" ".join(rng.choice(["red", "fox", "Fox", "runs", "a", "hill"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    base, other = texts[:30], texts[20:]
    want = [max(((Z.sequence_ratio(s, o), -k) for k, o in enumerate(other)), default=(0, 0)) for s in base]
    calls: list[int] = []
    ratio = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: (calls.append(1), ratio(self))[1])
    assert Z.closest(base, other, 0.5) == [(-k, r) if r > 0.5 else None for r, k in want]
    assert len(calls) < len(base) * len(other) / 2 and Z.closest(base, [], 0.5) == [None] * 30


def test_substitutions_are_aligned_without_a_table(monkeypatch):
    draw, path = random.Random(5), Z._path
    taken = 0
    for _ in range(3000):
        a = [draw.choice("abcd") for _ in range(draw.randrange(1, 9))]
        b = [draw.choice("abcde") if draw.random() < 0.4 else x for x in a]
        kinds = {w: k for k, w in enumerate("abcde")}
        x, y = (np.array([kinds[w] for w in s], np.int64) for s in (a, b))
        if Z._straight(x, y, 1, -1, -1):
            taken += 1
            assert path(x, y, 1, -1, -1) == [(1, 1)] * len(a)
    assert taken > 300

    def none(*_):
        raise AssertionError("a table was made")

    monkeypatch.setattr(Z, "_path", none)
    words = [f"w{draw.randrange(2000)}" if draw.random() < 0.9 else "the" for _ in range(20000)]
    gold = " ".join(words)
    assert Z.document_similarity(gold, gold.replace("the", "tha")) == sum(w != "the" for w in words) / len(words)


def test_replacements_tell_the_distance():
    import random

    from docflow.functions import fuzzy

    rng = random.Random(4)
    known = 0
    for _ in range(400):
        a = "".join(rng.choice("abcde") for _ in range(rng.randrange(12)))
        b = rng.choice([a.replace("a", "3"), a[1:] + a[:1], "".join(rng.choice("abcde") for _ in range(rng.randrange(12)))])
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *row[1:]] if not b else row
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        found = fuzzy.replacements(a, b)
        known += found is not None
        assert found in (None, row[-1]) and fuzzy.edit_distance(a, b) == row[-1]
    assert known > 100
    assert fuzzy.normalized_distance(None, "a") is None and fuzzy.normalized_distance("", "") == 0


def test_python_metrics_are_one_call(spark):
    from docflow.plans import extensions as E

    pairs = spark.createDataFrame([("a", "# T\nthr33 words", "# T\nthree words"), ("b", None, "x"), (None, "", "")], "rel string, pred string, target string")
    plans, real = [], E.written
    E.written = lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, name))[1]
    try:
        rows = {r["rel"]: r for r in E.evaluate(pairs, ["formula", "reading_order", "text_edit"]).collect()}
    finally:
        E.written = real
    assert plans[0].count("ArrowEvalPython") == 1
    assert rows["a"]["text_edit"] == round(2 / 13, 4) and rows["a"]["reading_order_ned"] == round(2 / 15, 4)
    assert rows["b"]["text_edit"] is None and rows["b"]["reading_order"] is None and rows[None]["text_edit_sim"] == 1


def test_first_and_last_places_are_found_alone(monkeypatch):
    """The start of the first or last match is known without those between; short stretches follow few cells and agree with the table."""
    draw = random.Random(7)
    for kinds in ("ab", "abcdef "):
        for _ in range(300):
            pattern, text = "".join(draw.choices(kinds, k=draw.randrange(1, 14))), "".join(draw.choices(kinds, k=draw.randrange(60)))
            for most in (0, 1, 2):
                assert not most or Z._near_held(pattern, text, most) == Z._near(pattern, text, most)
                starts = [m[0] for m in Z.near_matches(pattern, text, most)]
                assert (Z.near_start(pattern, text, most), Z.near_start(pattern, text, most, last=True)) == (min(starts, default=None), max(starts, default=None))
    text = "".join(f"the quick brown fox {k:03d} {'-' * 60}" for k in range(50))
    read: list[str] = []
    monkeypatch.setattr(Z, "_near_held", lambda pattern, part, most, own=Z._near_held: read.append(part) or own(pattern, part, most))
    assert Z.near_start("quick brawn fox", text, 1) == 4 and Z.near_start("quick brawn fox", text, 1, last=True) == text.rindex("quick") and len(read) == 2
