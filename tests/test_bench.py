import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docflow.operators import bench
from docflow.operators.bench import report, run_tests

PAGE = "The quick **brown** fox\n\n| a | b |\n|---|---|\n| 1 | 22 |\n\nand $x^2$ then \\(y\\) jumps over the lazy dog."
CASES = [
    ("present", {"text": "quick brown fox"}, True), ("present", {"text": "quikc brown fox", "max_diffs": 2}, True), ("present", {"text": "quikc brown fox"}, False), ("present", {"text": "QUICK", "case_sensitive": False}, True), ("present", {"text": "QUICK", "case_sensitive": True}, False),
    ("present", {"text": "lazy dog", "first_n": 20}, False), ("present", {"text": "lazy dog", "last_n": 12}, True), ("present", {"text": "Thelazy", "first_n": 3, "last_n": 9}, True), ("present", {"text": " "}, False), ("present", {}, False),
    ("absent", {"text": "elephant"}, True), ("absent", {"text": "lazy dog"}, False), ("order", {"before": "quick", "after": "lazy"}, True), ("order", {"before": "lazy", "after": "quick"}, False), ("order", {"before": "qvick", "after": "lazy", "max_diffs": 1}, True),
    ("order", {"before": "none here", "after": "lazy"}, False), ("order", {"before": "ab", "after": "lazy", "max_diffs": 2}, False), ("table", {"cell": "22", "up": "b", "left": "1"}, True), ("table", {"cell": "22", "up": "a"}, False), ("table", {"cell": ""}, False),
    ("math", {"math": "x^2"}, True), ("math", {"math": "y"}, True), ("math", {"math": "z"}, False), ("math", {"math": "x^2", "ignore_dollar_delimited": True}, False), ("math", {"math": "y", "ignore_dollar_delimited": True}, True), ("math", {}, False),
    ("baseline", {}, True), ("baseline", {"max_length": 5}, False), ("baseline", {"max_length": 500}, True), ("strange", {}, False), (None, {}, False),
]
KIND = "pdf string, page int, id string, category string, type string, text string, max_diffs int, case_sensitive boolean, first_n int, last_n int, before string, after string, cell string, up string, left string, math string, ignore_dollar_delimited boolean, max_length int"
OUT = "candidate string, pdf string, page int, repeat int, md string"


@pytest.fixture(scope="module")
def tests(spark):
    names = [x.split()[0] for x in KIND.split(", ")]
    rows = [tuple({"pdf": "p", "page": 1, "id": f"t{k}", "type": kind, **fields}.get(n) for n in names) for k, (kind, fields, _) in enumerate(CASES)]
    return spark.createDataFrame(rows + [tuple({"pdf": None, "page": 1, "id": "lost", "type": "baseline"}.get(n) for n in names)], KIND)


def test_every_type(spark, tests):
    outputs = spark.createDataFrame([("one", "p", 1, 1, PAGE), ("none", "p", 1, 1, None), ("other", "q", 1, 1, PAGE)], OUT)
    got = run_tests(tests, outputs).collect()
    one = {r["id"]: r for r in got if r["candidate"] == "one"}
    assert {i: r["passed"] for i, r in one.items()} == {f"t{k}": want for k, (_, _, want) in enumerate(CASES)}
    assert all(bool(r["explanation"]) != r["passed"] for r in got) and {r["candidate"] for r in got} == {"one", "none"}
    none = {r["id"]: r["passed"] for r in got if r["candidate"] == "none"}
    assert none["t10"] and not none["t0"] and not none["t26"] and none["t27"]


def test_report(spark):
    """Repeats are averaged, categories weigh alike, pages without output fail, intervals hold the rate."""
    tests = spark.createDataFrame([("p", k, f"t{k}", "present" if k % 4 else "order", "word", "word", "two") for k in range(40)], "pdf string, page int, id string, type string, text string, before string, after string")
    md = lambda k, r: "a word here, two" if (k + r) % 3 else "nothing"
    outputs = spark.createDataFrame([("x", "p", k, r, md(k, r)) for k in range(30) for r in (1, 2)] + [("y", "p", k, 1, "word two") for k in range(40)], OUT)
    results = run_tests(tests, outputs)
    rows = {(r["candidate"], r["category"]): r for r in report(tests, results, outputs.unionByName(spark.createDataFrame([("z", "q", 0, 1, "")], OUT)), 400).collect()}
    score = {k: sum(md(k, r) != "nothing" for r in (1, 2)) / 2 if k < 30 else 0 for k in range(40)}
    by = {c: [score[k] for k in range(40) if (k % 4 > 0) == (c == "present")] for c in ("present", "order")}
    for c, own in by.items():
        assert rows["x", c]["rate"] == pytest.approx(sum(own) / len(own)) and rows["x", c]["tests"] == len(own) and rows["y", c]["rate"] == 1 and rows["z", c]["rate"] == 0
    x = rows["x", "overall"]
    assert x["rate"] == pytest.approx(sum(sum(v) / len(v) for v in by.values()) / 2) and x["low"] < x["rate"] < x["high"] and x["high"] - x["low"] < 0.45
    assert tuple(rows["y", "overall"])[3:] == (1, 1, 1) and tuple(rows["z", "overall"])[3:] == (0, 0, 0)
    again = report(tests.repartition(7), results.repartition(5), outputs.select("candidate"), 400).where("category = 'overall' AND candidate = 'x'").first()
    assert again["low"] == pytest.approx(x["low"]) and again["high"] == pytest.approx(x["high"])


def test_results_are_made_once(spark, tmp_path):
    """Rates and intervals read the scores from one table."""
    tests = spark.createDataFrame([("p", k, f"t{k}", "present", "word") for k in range(20)], "pdf string, page int, id string, type string, text string")
    log = str(tmp_path / "log")

    def made(batches):
        for batch in batches:
            with open(log, "a") as f:
                f.write("x" * batch.num_rows)
            yield batch

    results = spark.createDataFrame([("x", "present", f"t{k}", k % 2 == 0, "") for k in range(20)], "candidate string, category string, id string, passed boolean, explanation string").mapInArrow(made, "candidate string, category string, id string, passed boolean, explanation string")
    out = report(tests, results, spark.createDataFrame([("x",)], "candidate string"), 50)
    assert {r["rate"] for r in out.collect()} == {0.5}
    with open(log) as f:
        assert len(f.read()) == 20


def test_alike_outputs_of_a_page_are_judged_once(monkeypatch):
    """Outputs of a page that are the same are read once, whatever batches they come in."""
    kind = pa.list_(pa.struct([("id", pa.string()), *[(k, {"int": pa.int32(), "boolean": pa.bool_()}.get(v, pa.string())) for k, v in bench.FIELDS.items()]]))
    test = lambda key: [{k: {"id": key, "category": "present", "type": "present", "text": "word"}.get(k) for k in ("id", *bench.FIELDS)}]
    read: list[str] = []
    monkeypatch.setattr(bench.Z, "normalize", lambda text, own=bench.Z.normalize: read.append(text) or own(text))
    rows = [("a", "a word", "1"), ("b", "none", "1"), ("c", "a word", "1"), ("a", "a word", "2"), ("b", "a word", "2")]
    batches = [pa.RecordBatch.from_arrays([pa.array([c]), pa.array([md]), pa.array([test(key)], kind)], ["candidate", "md", "tests"]) for c, md, key in rows]
    got = [tuple(r.values())[:4] for b in bench._textual(False)(iter(batches)) for r in b.to_pylist()]
    assert got == [(c, "present", key, "word" in md) for c, md, key in rows]
    assert [t for t in read if t != "word"] == ["a word", "none", "a word"]


def test_weights_are_drawn_once(spark, monkeypatch):
    """A test's weights serve the tests' own sum and the scores of all candidates, in one pass over one table."""
    rows = spark.createDataFrame([("p", k, f"t{k}", "present", "word") for k in range(50)], "pdf string, page int, id string, type string, text string")
    made: list[str] = []
    monkeypatch.setattr(bench, "written", lambda df, name, own=bench.written: made.append(name) or own(df, name))
    outputs = spark.createDataFrame([(c, "p", k, 1, "a word" if c == "x" or k % 2 else "") for c in "xy" for k in range(50)], OUT)
    got = {(r["candidate"], r["category"]): r for r in report(rows, run_tests(rows, outputs), outputs.select("candidate"), 100).collect()}
    assert made == ["bench-scores", "bench-draws"] and got["x", "overall"]["low"] == 1 and got["y", "present"]["rate"] == 0.5 and got["y", "present"]["tests"] == 50
