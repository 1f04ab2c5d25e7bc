import itertools
import random

import pytest
from pyspark.sql import functions as F

from docflow.functions.layout import SIDES, merge_boxes, same_formula, same_layout
from docflow.sources import files, sinks, store
from docflow.streaming.batches import advance


def test_backoff():
    waits, calls = [], []

    def fails_twice():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("try again")
        return "read"

    assert files.with_backoff(fails_twice, sleep=waits.append) == "read" and waits == [1, 2]
    with pytest.raises(RuntimeError, match="8 attempts"):
        files.with_backoff(lambda: 1 / 0, sleep=waits.append)
    waits.clear()

    def forbidden():
        raise PermissionError

    with pytest.raises(PermissionError):
        files.with_backoff(forbidden, sleep=waits.append)
    assert waits == []


def test_files_and_ranges(spark, tmp_path):
    page = b"%PDF-1.4 /Type /Pages /Type /Page\n/Type/Page>>"
    rows = spark.createDataFrame([("a.pdf", bytearray(page)), ("b.png", bytearray(b"\x89PNG\r\n\x1a\nxx"))], "n string, b binary")
    for _ in range(2):  # a task that runs again leaves the same files
        assert store.write_files(rows, f"file:{tmp_path}/in", "n", "b") == 2
    assert sorted(p.name for p in (tmp_path / "in").iterdir() if not p.name.startswith(".")) == ["a.pdf", "b.png"]
    got = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in files.read_range(spark, f"{tmp_path}/in/*", 1, 4).collect()}
    assert got == {"a.pdf": b"PDF", "b.png": b"PNG"}
    whole = files.read_range(spark, f"{tmp_path}/in/*")
    assert whole.where("path like '%pdf'").select(files.pdf_pages(F.col("content"))).first()[0] == 2


def test_work_store(spark, tmp_path):
    work = store.WorkStore(spark, str(tmp_path / "w"))
    assert work.pending().count() == work.done().count() == 0  # nothing was written yet
    paths = {"h1": ["a,b.pdf", 'c"d.pdf'], "h2": ["e.pdf"], "h3": ["f.pdf"]}
    assert work.save_index(spark.createDataFrame(list(paths.items()), "work_hash string, paths array<string>")) == 3
    assert {r["work_hash"]: r["paths"] for r in work.index().collect()} == paths
    some = lambda *h: spark.createDataFrame([(x,) for x in h], "work_hash string")
    work.lock(some("h1", "h2"))
    work.mark_done(some("h1"))
    assert [r[0] for r in work.locked().collect()] == ["h2"] and [r[0] for r in work.done().collect()] == ["h1"]
    assert [r["work_hash"] for r in work.pending().collect()] == ["h3"]
    assert {r["work_hash"] for r in work.pending(seconds=-1).collect()} == {"h2", "h3"}  # stale locks do not hold


def test_tarballs_round_trip(spark, tmp_path):
    rows = [("g", f"{k:02}.txt", bytearray(bytes([65 + k]) * 3000)) for k in range(9)] + [("h", "x.txt", bytearray())]
    records = spark.createDataFrame(rows, "chunk string, name string, content binary").repartition(3)
    manifest = {tuple(r) for r in sinks.write_tarballs(records, str(tmp_path / "t"), 20_000).select("chunk", "arcname").collect()}
    held = {(r["chunk"], r["name"]): r["size"] for r in sinks.read_tarballs(spark, str(tmp_path / "t")).collect()}
    assert set(held) == manifest and sorted(n for _, n in held) == sorted(r[1] for r in rows)
    assert held[("h_00000.tar.gz", "x.txt")] == 0 and len({c for c, _ in held}) == 4
    before = {p.name: p.read_bytes() for p in (tmp_path / "t/tar").glob("*.gz")}
    sinks.write_tarballs(records.repartition(2), str(tmp_path / "u"), 20_000)
    assert before == {p.name: p.read_bytes() for p in (tmp_path / "u/tar").glob("*.gz")}


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2.0), ("b", 2, None)], "name string, n int, x double")
    sinks.write_report(rows, str(tmp_path / "csv"), "name")
    first = sorted((tmp_path / "csv").glob("*.csv"))[0].read_text().split("\n")
    assert first[:2] == ["name,n,x", "average,1.5,2.0"]
    sinks.write_html_rows(spark.createDataFrame([("<b>&", None)], "a string, b string"), str(tmp_path / "html"))
    assert spark.read.text(str(tmp_path / "html")).first()[0] == "<tr><td>&lt;b&gt;&amp;</td><td></td></tr>"


def test_batches_end(spark):
    state = spark.createDataFrame([("d", str(k), 10, "init") for k in range(5)] + [("e", "0", None, "init")], "folder string, file string, size long, state string")
    none = spark.createDataFrame([], "folder string, file string, status string, success boolean")
    state = advance(state, none, 25)
    assert {(r["folder"], r["file"]): r["state"] for r in state.collect()} == {("d", "0"): "processing", ("d", "1"): "processing", ("d", "2"): "processing", ("d", "3"): "init", ("d", "4"): "init", ("e", "0"): "processing"}
    reports = spark.createDataFrame([("d", "0", "completed", True), ("d", "1", "completed", False), ("d", "2", "expired", None), ("d", "3", "completed", True), ("e", "0", "in_progress", None)], none.schema)
    state = advance(state, reports, 25)
    assert [r["state"] for r in state.orderBy("folder", "file").collect()] == ["completed", "errored_out", "errored_out", "init", "init", "processing"]
    assert advance(state, none, 25).where("folder = 'd' and state = 'processing'").count() == 2


def test_box_groups_equal_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        boxes = [[x, y, x + rng.randint(1, 6), y + rng.randint(1, 6)] for x, y in ((rng.randint(0, 30), rng.randint(0, 30)) for _ in range(rng.randint(0, 12)))]
        near = lambda a, b: max(a[0], b[0]) - min(a[2], b[2]) <= 0.5 and max(a[1], b[1]) - min(a[3], b[3]) <= 0.5
        groups = [{k} for k in range(len(boxes))]
        for i in range(len(boxes)):
            joined = [g for g in groups if any(near(boxes[i], boxes[j]) for j in g)]
            groups = [g for g in groups if g not in joined] + [set().union(*joined, {i})]
        hulls = [[min(boxes[k][0] for k in g), min(boxes[k][1] for k in g), max(boxes[k][2] for k in g), max(boxes[k][3] for k in g)] for g in groups]
        assert sorted(merge_boxes(boxes)) == sorted(hulls)


def _brute(reference, other):
    """Any injection that keeps texts and, by the stated rule, neighbours."""

    def near(spans, i):
        x, y = spans[i]["x"] + spans[i]["w"] / 2, spans[i]["y"] + spans[i]["h"] / 2
        for dx, dy in SIDES:
            best = None
            for k, s in enumerate(spans):
                ox, oy = s["x"] + s["w"] / 2 - x, s["y"] + s["h"] / 2 - y
                along, off = (ox * dx, abs(oy)) if dx else (oy * dy, abs(ox))
                if along > 0 and off <= 5 and (best is None or along < best[0]):
                    best = (along, k)
            yield best and best[1]

    a, b = [list(near(other, i)) for i in range(len(other))], [list(near(reference, i)) for i in range(len(reference))]
    for f in itertools.permutations(range(len(reference)), len(other)):
        if all(other[i]["text"] == reference[f[i]]["text"] and all(h is None or (q is not None and (f[h] == q if h < i else reference[q]["text"] == other[h]["text"])) for h, q in zip(a[i], b[f[i]], strict=True)) for i in range(len(other))):
            return True
    return False


def test_layout_equals_brute_force():
    rng, seen = random.Random(7), set()
    for _ in range(400):
        spans = [{"text": rng.choice("ab"), "x": 8.0 * rng.randint(0, 3), "y": 8.0 * rng.randint(0, 2), "w": 4.0, "h": 4.0} for _ in range(rng.randint(0, 5))]
        other = [dict(s) for s in spans if rng.random() < 0.9]
        rng.shuffle(other)
        if other and rng.random() < 0.4:
            other[0]["x"] += 8
        assert same_layout(spans, other) == _brute(spans, other)
        seen.add(same_layout(spans, other))
    assert seen == {True, False}
    wide = [{"text": "ab" * 300, "x": 0.0, "y": 0.0, "w": 6000.0, "h": 5.0}]
    assert same_layout(wide, [{"text": "ab", "x": 0.0, "y": 0.0, "w": 20.0, "h": 5.0}]) and not same_layout([], wide)


def test_formulas_agree_by_markup():
    one = {"mathml": "<math><semantics><mi>x</mi><annotation>x</annotation></semantics></math>", "spans": []}
    other = {"mathml": "<math><semantics> <mi>x</mi> <mi>y</mi><annotation>xy</annotation></semantics></math>", "spans": [{"text": "q", "x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0}]}
    assert same_formula(one, other) and not same_formula(other | {"mathml": "<math>z</math>", "spans": []}, other)


def test_read_files_by_tasks(spark, tmp_path):
    """Folders are listed by tasks: no list of files, and no reader of Spark's a file; hidden and empty files are left out."""
    names = {f"a{k % 3}/b{k % 2}/{k}.md": f"text {k}" for k in range(40)} | {"top.md": "Ä", "a0/b0/x y%20.md": "z"}
    other = {"a0/none.md": "", "a0/_own.md": "x", ".hid/q.md": "x", "_tmp/q.md": "x", "a0/n.txt": "x", "a0/k=1/_s=1.md": "kept"}
    for name, text in (names | other).items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    got = sinks.read_markdown_tree(spark, f"file:{tmp_path}/t/")
    assert sorted(map(tuple, got.collect())) == sorted((names | {"a0/k=1/_s=1.md": "kept"}).items())
    assert "binaryFile" not in got._jdf.queryExecution().executedPlan().toString()
