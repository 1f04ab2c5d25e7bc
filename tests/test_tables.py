import io
import tarfile

import pytest
from pyspark.sql import functions as F

from docflow.operators import compare as C
from docflow.operators import documents as D
from docflow.operators import packs as K
from docflow.operators import sampling as S
from docflow.sources import files, sinks


def test_assembly_reproduces_pages(spark):
    rows = [("a", 1, "one"), ("a", 2, None), ("a", 3, "three"), ("b", 1, None), ("c", 1, "x"), ("c", 2, "")]
    for parts in (1, 8):
        pages = spark.createDataFrame(rows, "k string, page int, text string").repartition(parts)
        docs = {r["k"]: r for r in D.assemble(pages, "k").collect()}
        assert set(docs) == {"a", "c"} and docs["a"]["text"] == "one\nthree" and docs["c"]["text"] == "x\n"
        assert [tuple(s) for s in docs["a"]["spans"]] == [(0, 4, 1), (4, 4, 2), (4, 9, 3)]
        back = D.explode_pages(D.assemble(pages, "k")).where("k = 'a'").orderBy("page").collect()
        assert "".join(r["page_text"] for r in back) == "one\nthree"


def test_bins(spark):
    rows = spark.createDataFrame([("g", k, s) for k, s in enumerate([5, 5, 3, 9, 1])], "g string, k int, s int")
    assert [r["bin"] for r in K.bin_rows(rows, "g", "k", "s", 10, 0).orderBy("k").collect()] == [0, 0, 1, 2, 2]
    with pytest.raises(Exception, match="exceeds"):
        K.bin_rows(rows, "g", "k", "s", 8, 0).collect()


def test_gaps_and_spans(spark):
    run = lambda items: spark.range(1).select(K.gap_runs(F.array(*map(F.lit, items)), "-", 2).alias("x")).first()["x"]
    assert [tuple(r) for r in run(list("a--b-c---"))] == [(1, 3), (6, 9)]
    spans = spark.createDataFrame([("g", 1, 3), ("g", 3, 5), ("g", 7, 8), ("g", 2, 4)], "g string, a int, b int")
    assert sorted((r["a"], r["b"]) for r in K.merge_spans(spans, "g", "a", "b").collect()) == [(1, 5), (7, 8)]


def test_spans_without_ends_merge_as_in_sql(spark):
    # What the SQL of win_09_merge_spans makes of nulls, which stand last, and of ends ahead of their starts.
    spans = spark.createDataFrame([("g", 1, None), ("g", 1, 3), ("g", 2, None), ("h", 4, None), ("h", 4, None), ("i", 5, 2), ("i", 5, 2), ("i", None, 9), ("i", None, 9), ("i", None, None)], "g string, a int, b int")
    merged = [(r["g"], r["a"], r["b"]) for r in K.merge_spans(spans, "g", "a", "b").collect()]
    assert sorted(merged, key=str) == sorted([("g", 1, 3), ("h", 4, None), ("h", 4, None), ("i", 5, 2), ("i", 5, 2), ("i", None, 9), ("i", None, 9), ("i", None, None)], key=str)


def test_sampling_is_repeatable(spark):
    rows = spark.range(100).withColumn("g", F.col("id") % 4)
    pick = lambda df: sorted(r["id"] for r in S.sample_n(df, "id", 10, "3").collect())
    assert pick(rows) == pick(rows.repartition(7)) and len(pick(rows)) == 10
    assert S.sample_groups(rows, "g", 0.25).select("g").distinct().count() == 1
    weights = S.bootstrap_weights(rows, "id", 50).groupBy("replicate").agg(F.sum("weight").alias("n")).agg(F.avg("n")).first()[0]
    assert 90 < weights < 110


def test_bootstrap_and_permutation(spark):
    rows = spark.createDataFrame([("a", float(k % 2)) for k in range(40)] + [("b", 1.0)] * 10, "c string, s double")
    low, high = C.bootstrap_interval(rows, "c", "s", 300).first()
    assert 0.6 < low < 0.75 < high < 0.9
    assert C.permutation_test([1.0] * 20, [0.0] * 20, spark, 200).first()["p"] < 0.05
    assert C.permutation_test([1.0, 0.0] * 10, [0.0, 1.0] * 10, spark, 200).first()["p"] > 0.9


def test_permutation_query_takes_all_rows(spark, tmp_path):
    """Over 500 failures a candidate, and categories of unlike sizes."""
    import __spark_entry__ as entry

    kinds = [("a", "x", 900, 1800), ("a", "y", 700, 100), ("b", "x", 300, 400), ("b", "y", 2600, 200), ("c", "x", 5, 5), ("a", "z", 40, 20)]
    rows = [(name, kind, 60000.0 if k < good else 10.0) for name, kind, bad, good in kinds for k in range(bad + good)]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    out = entry.queries()["agg_37_permutation"](spark, str(tmp_path)).first()
    wanted = (1800 / 2700 + 100 / 800 + 20 / 60) / 3 - (400 / 700 + 200 / 2800) / 2
    assert out["difference"] == pytest.approx(wanted) and out["p"] < 0.2


def test_stratified_permutation_against_shuffles(spark):
    import numpy as np

    a, b = {"x": [1.0] * 14 + [0.0] * 10, "y": [1.0] * 5 + [0.5] * 7}, {"x": [1.0] * 8 + [0.0] * 12, "y": [1.0] * 4 + [0.5] * 9}
    rows = [(n, k, v) for n, side in (("a", a), ("b", b)) for k, vs in side.items() for v in vs]
    out = C.stratified_permutation(spark.createDataFrame(rows, "n string, k string, s double"), "a", "b", "n", "k", "s", 4000).first()
    rng, seen, hits = np.random.default_rng(1), np.mean([np.mean(a[k]) - np.mean(b[k]) for k in a]), 0
    for _ in range(4000):
        mixed = {k: rng.permutation(a[k] + b[k]) for k in a}
        hits += abs(np.mean([m[: len(a[k])].mean() - m[len(a[k]) :].mean() for k, m in mixed.items()])) >= abs(seen) - 1e-12
    assert out["difference"] == pytest.approx(seen) and abs(out["p"] - hits / 4000) < 0.04


def test_elo():
    ratings = C.elo_arena([("a", "b", 10, 0)])
    assert ratings["a"] > 1500 > ratings["b"] and sum(ratings.values()) == pytest.approx(3000)


def test_files_round_trip(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id": "1", "text": "x"}\n\nnot json\n{"id": "2", "text": null}\n')
    assert sorted(r["id"] for r in files.read_jsonl(spark, str(folder), "id string, text string").collect()) == ["1", "2"]
    (folder / "i.csv.zstd").write_bytes(sinks.zstd_lines(iter(['h1,"a,b",c', "h2,d"])))
    index = {r["key"]: r["items"] for r in files.ragged_csv(files.read_zstd_lines(spark, f"{folder}/*.zstd")).collect()}
    assert index == {"h1": ["a,b", "c"], "h2": ["d"]}
    with pytest.raises(ValueError, match="2 times"):
        files.assert_unique(spark.createDataFrame([(1,), (1,)], "id int"), "id")
    assert files.attributes_folder("s3://b/x/documents", "pii") == "s3://b/x/attributes/pii"


def test_tarballs(spark):
    rows = spark.createDataFrame([("c", f"{k}.txt", bytearray(b"x" * 100)) for k in range(5)], "chunk string, name string, content binary")
    out = sinks.tarballs(rows, 2300).collect()
    names = [n for r in out for n in tarfile.open(fileobj=io.BytesIO(bytes(r["tar"]))).getnames()]
    assert sorted(names) == [f"{k}.txt" for k in range(5)] and len(out) == 3
    assert "<td>0.txt</td>" in sinks.html_report(rows.select("name"))
