import random
from itertools import combinations

import corpus_pipeline as C
from docflow.llm import queries
from tests.llm.conftest import make


def test_pipeline_stages_follow_each_other(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [rows.count()]
    for k, (_, stage) in enumerate(C.STAGES):
        rows = stage(spark, rows, folder)
        if k < 4:
            assert rows.columns == docs.columns
            rows.write.parquet(f"{folder}/{k}")
            rows = spark.read.parquet(f"{folder}/{k}")
            counts.append(rows.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] == counts[3]
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert {r["doc_id"] for r in rows.collect()} == {r["doc_id"] for r in spark.read.parquet(f"{folder}/3").collect()}
    total = lambda df: sum(x[2] for x in key(df))
    assert total(rows) == total(C.run(spark, folder))


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_near_stage_against_brute_force(spark):
    """Pairs between 0.80 and 0.85 fall too; pairs below 0.80 stay."""
    rng = random.Random(8)
    rows = []
    for k in range(40):
        base = [f"b{k}x{j}" for j in range(100 + k)]
        for copy in range(3):
            own = list(base)
            for at in range(2 + 4 * copy, 2 + 4 * copy + (k % 3 + 1) * 30 * (copy > 0), 30):
                own[at] = f"e{rng.randrange(10**9)}"
            rows.append((3 * k + copy, " ".join(own)))
    shingles = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    group, seen = {i: i for i in shingles}, []
    for a, b in combinations(shingles, 2):
        both = len(shingles[a] & shingles[b])
        share = both / (len(shingles[a]) + len(shingles[b]) - both)
        seen.append(share)
        if share >= 0.8:
            x, y = group[a], group[b]
            group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    assert sum(0.8 <= s < 0.85 for s in seen) > 10 and sum(0.7 < s < 0.8 for s in seen) > 10
    kept = {r["doc_id"] for r in C.near(spark, make(spark, rows), "").collect()}
    assert kept == {i for i, g in group.items() if i == g}


def test_rows_without_ids_of_their_own(spark):
    """Null and repeated ids, repeated rows and clashing names: each row has its own verdict."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    one, two, three = text(60), text(70), text(80)
    rows = make(spark, [(None, one), (None, two), (None, "junk"), (7, three), (7, three), (7, "a " * 90), (8, two)])
    for name in ("kept_id", "dedup", "kept", "words", "row", "label"):
        rows = rows.withColumn(name, F.lit(name))
    for stage in (C.quality, C.exact, C.near, C.substrings):
        rows = spark.createDataFrame(stage(spark, rows, "").collect(), rows.schema)
        assert rows.columns[-6:] == ["kept_id", "dedup", "kept", "words", "row", "label"]
    assert sorted(r["text"] for r in rows.collect()) == sorted([one, two, three])
    assert {r["kept"] for r in rows.collect()} == {"kept"}


def test_empty_pipeline(spark, empty):
    for _, stage in C.STAGES[:4]:
        assert stage(spark, empty, "").columns == empty.columns and stage(spark, empty, "").count() == 0
