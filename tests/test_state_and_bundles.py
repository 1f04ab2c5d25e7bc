import datetime
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docflow.functions import udtf
from docflow.sources import bundles as N
from docflow.streaming.metrics import run_available
from docflow.streaming.state import rocksdb, runs

EVENTS = "k string, ts timestamp, e string"


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


def test_runs_go_on_after_a_restart(spark, tmp_path):
    """Counts, clear events and time-outs over three starts of one stream; state stays between them."""
    parts = [
        [("a", at(0), "x"), ("a", at(5), "x"), ("b", at(6), "x"), (None, at(6), "x"), ("a", None, "x")],
        [("a", at(9), "x"), ("a", at(10), "stop"), ("a", at(11), "x"), ("b", at(40), "x"), ("c", at(41), "stop")],
        [("d", at(200), "x"), ("a", at(201), None)],
    ]
    seen = []
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/p={k}")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in/p=*")
        with rocksdb(spark):
            out = run_available(runs(stream, "k", "ts", "e", "stop", 15 * 60_000, "1 minute"), f"{tmp_path}/out", f"{tmp_path}/state")
        seen.append({(r["key"], r["ended"], r["first"].minute + 60 * r["first"].hour, r["n"]) for r in out.collect()})
    first = {("a", "clear", 0, 3), ("b", "silence", 6, 1), ("a", "silence", 11, 1)}
    assert seen[0] == set() and seen[1] == first and seen[2] == first | {("b", "silence", 40, 1)}
    assert "rocksdb" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").lower()


def files(folder):
    return sorted(p.relative_to(folder).as_posix() for p in Path(folder).rglob("*") if p.is_file())


@pytest.fixture
def rows(spark):
    N.register(spark)
    data = [(f"b{k % 3}", f"f{k:02}", None if k == 7 else bytes([k]) * (k * 40)) for k in range(20)]
    return spark.createDataFrame(data, N.SCHEMA).repartition(4, "bundle").sortWithinPartitions("bundle", "name")


def test_bundles_round_trip(spark, rows, tmp_path):
    folder = f"{tmp_path}/x"
    for _ in range(2):
        rows.write.format(N.FORMAT).mode("append").option("limit", 500).save(folder)
    back = spark.read.format(N.FORMAT).load(folder)
    want = sorted((r["bundle"], r["name"], bytes(r["content"] or b"")) for r in rows.collect())
    assert sorted((r["bundle"], r["name"], bytes(r["content"])) for r in back.collect()) == sorted(want * 2)
    shown = N.manifest(spark, folder).collect()
    assert len(shown) > 6 and {r["file"] for r in shown} == {f for f in files(folder) if f.endswith(".tar")}
    rows.where("bundle = 'b1'").write.format(N.FORMAT).mode("overwrite").save(folder)
    assert {r["bundle"] for r in N.manifest(spark, folder).collect()} == {"b1"} and sum(f.endswith(".tar") for f in files(folder)) == 1


def test_a_failed_job_leaves_nothing(spark, rows, tmp_path):
    folder = f"{tmp_path}/x"
    rows.where("bundle = 'b0'").write.format(N.FORMAT).mode("append").save(folder)
    before = files(folder)

    broken = rows.withColumn("content", F.when(F.col("name") == "f19", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format(N.FORMAT).mode("append").save(folder)
    assert files(folder) == before
    with pytest.raises(Exception, match="without a bundle or a name"):
        rows.withColumn("name", F.lit(None).cast("string")).write.format(N.FORMAT).mode("append").save(folder)
    assert files(folder) == before


def test_a_task_that_runs_twice_writes_once(tmp_path):
    """What a lost attempt wrote is in no manifest and goes with the commit."""
    import pyarrow as pa

    writer = N.BundleWriter(f"{tmp_path}/x", N.LIMIT, False)
    batch = pa.RecordBatch.from_pylist([{"bundle": "b", "name": "f", "content": b"1"}])
    writer.write(iter([batch]))  # this attempt's message is lost
    writer.commit([writer.write(iter([batch])), None])
    manifest = [f for f in files(tmp_path / "x") if f.startswith("manifest/")]
    named = [json.loads(x)["file"] for f in manifest for x in (tmp_path / "x" / f).read_text().splitlines()]
    assert len(named) == 1 and sorted(files(tmp_path / "x")) == sorted(manifest + named)


def test_word_ngrams_in_sql(spark):
    udtf.register(spark)
    spark.createDataFrame([(1, "a b c"), (2, None), (2, "x y z"), (None, "p q")], "id int, text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT * FROM word_ngrams(TABLE(SELECT id, text FROM texts), 2)")
    assert got.schema["key"].dataType.simpleString() == "int"
    assert sorted(map(str, ((r["key"], r["place"], r["ngram"]) for r in got.collect()))) == sorted(map(str, [(1, 0, "a b"), (1, 1, "b c"), (2, 0, "x y z"), (None, 0, "p q")]))
    with pytest.raises(Exception, match="number of words"):
        spark.sql("SELECT * FROM word_ngrams(TABLE(SELECT id, text FROM texts), 0)").collect()


def test_word_ngrams_are_counted_where_they_are_found(spark):
    udtf.register(spark)
    rows = [(1, "a b c a b"), (2, None), (2, "x y z"), (2, "x y  x y ä"), (3, "one"), (None, "p q"), (4, ""), (4, "p\tq\nr")]
    spark.createDataFrame(rows, "id int, text string").createOrReplaceTempView("counted_texts")
    table = "(TABLE(SELECT id, text FROM counted_texts), 2)"
    counted = spark.sql(f"SELECT key, sum(n), sum(distinct_n) + count(DISTINCT ngram), max(last) FROM word_ngram_counts{table} GROUP BY key").collect()
    single = spark.sql(f"SELECT key, count(*), count(DISTINCT ngram), max(ngram) FROM word_ngrams{table} GROUP BY key").collect()
    assert sorted(map(str, map(tuple, counted))) == sorted(map(str, map(tuple, single))) and len(counted) == 4
    # A key with one text is one row.
    assert spark.sql(f"SELECT * FROM word_ngram_counts{table} WHERE key = 1").count() == 1
    with pytest.raises(Exception, match="number of words"):
        spark.sql("SELECT * FROM word_ngram_counts(TABLE(SELECT id, text FROM counted_texts), 0)").collect()
