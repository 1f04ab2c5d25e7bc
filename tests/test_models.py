import math
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docflow.functions import text as X
from docflow.operators import coherency as H
from docflow.operators import filters as P
from docflow.operators import language as L
from docflow.operators import variants as V

DATA = Path("/root/testdata/sf0.001")


def test_profiles_and_scores_by_hand(spark):
    rows = [(0, "en", "the cat"), (1, "en", "the hat"), (2, "fr", "le chat"), (3, None, "x"), (4, "fr", None)]
    table, names = L.profiles(spark.createDataFrame(rows, "id long, lang string, text string"))
    grams = {"en": Counter(), "fr": Counter()}
    for _, lang, text in rows:
        if lang and text:
            for w in text.split():
                grams[lang].update(("_" + w + "_")[k : k + 3] for k in range(len(w)))
    union = set(grams["en"]) | set(grams["fr"])
    want = {g: [math.log((grams[n][g] + 1) / (sum(grams[n].values()) + len(union))) for n in ("en", "fr")] for g in union}
    assert names == ["en", "fr"] and {r["gram"]: [pytest.approx(r["s0"]), pytest.approx(r["s1"])] for r in table.collect()} == want
    got = {r["id"]: r for r in L.detect(spark.createDataFrame([(1, "the the the the the"), (2, "zzz"), (3, None), (4, "The")], "id long, text string"), "id", table, names).collect()}
    assert got[1]["language"] == "en" and got[1]["grams"] == 15 and got[4]["language"] == got[2]["language"] == got[3]["language"] == "unknown" and got[3]["grams"] == 0
    none, no = L.profiles(spark.createDataFrame([], "id long, lang string, text string"))
    assert no == [] and [r["language"] for r in L.detect(spark.createDataFrame([(1, "the")], "id long, text string"), "id", none, no).collect()] == ["unknown"]


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")
def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = L.detect(docs.where(held), "doc_id", *L.profiles(docs.where(~held))).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars >= 200 and language != 'unknown'").collect()
    assert len(found) > 20 and sum(r["language"] == r["lang"] for r in found) >= 0.95 * len(found)


def test_coherency(spark):
    texts = [(1, "a b c a b c"), (2, "a b"), (3, "c"), (4, None), (5, "z a y")]
    docs = spark.createDataFrame(texts, "id long, text string")
    got = {r["id"]: r for r in H.coherency(docs, ["id"], H.bigram_model(docs.where("id < 5")), chunk=2).collect()}
    words = Counter(w for i, t in texts if t and i < 5 for w in t.split())
    pairs = Counter(p for i, t in texts if t and i < 5 for p in zip(t.split(), t.split()[1:]))
    total, rarest = sum(words.values()), math.log(0.4 * min(words.values()) / sum(words.values()))
    score = lambda a, b: math.log(pairs[a, b] / words[a]) if pairs[a, b] > 1 else math.log(0.4 * words[b] / total) if b in words else rarest
    for i, t in texts:
        own = [score(*p) for p in zip((t or "").split(), (t or "").split()[1:])]
        if not own:
            assert i not in got
            continue
        means = [sum(own[k : k + 2]) / len(own[k : k + 2]) for k in range(0, len(own), 2)]
        assert got[i]["coherency"] == pytest.approx(sum(means) / len(means)) and got[i]["worst"] == pytest.approx(min(means)) and got[i]["worst_chunk"] == means.index(min(means))
    ways = spark.createDataFrame([(1, "x", "b a c b"), (1, "y", "a b c a b"), (2, "x", "q"), (3, "u", "a b"), (3, "t", "a b")], "id long, way string, text string")
    assert {(r["id"], r["way"]) for r in H.most_coherent(ways, "id", "way", H.bigram_model(docs)).collect()} == {(1, "y"), (3, "t")}


def test_coherency_in_blocks(spark, monkeypatch):
    rows = [(k % 7, f"a b c w{k % 5} a b") for k in range(40)] + [(None, "a b"), (None, "c a b"), (9, ""), (8, "q")]
    docs = spark.createDataFrame(rows, "id long, text string")
    score = lambda: {r["id"]: r for r in H.coherency(docs, ["id"], H.bigram_model(docs), chunk=3).collect()}
    whole = score()
    monkeypatch.setattr(H, "BLOCK", 16)  # many blocks, counts in many stretches
    monkeypatch.setattr(H, "COUNTED", 4)
    parted = score()
    assert set(parted) == {*range(7), None} == set(whole)
    for k, r in parted.items():
        assert (r["chunks"], r["worst_chunk"]) == (whole[k]["chunks"], whole[k]["worst_chunk"]) and r["coherency"] == pytest.approx(whole[k]["coherency"]) and r["worst"] == pytest.approx(whole[k]["worst"])
    # A row for each distinct word or pair is shuffled, none for each time it stands in a text.
    plan = H.coherency(docs, ["id"], H.bigram_model(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


CASES = [
    ('{"a": [[0,1,false],[1,2,true]]}', "a:any", True), ('{"a": [[0,1,true],[1,2,null]]}', "a:all", True), ('{"a": [[0,1,null]]}', "a:all", False), ("{}", "a:any", False), ("{}", "not a:any", True),
    ('{"a": [[0,1,0.2],[1,2,0.5]]}', "a:avg>0.3", True), ('{"a": [[0,1,true]]}', "a:avg==1", True), ('{"a": [[0,1,"0.5"],[1,2,true]]}', "a:avg==0.75", True), ('{"a": [[0,1,"low"],[1,2,5]]}', "a:avg>0", False),
    ('{"a": [[0,1,"0"]]}', "a:any", True), ('{"a": [[0,1,0]]}', "a:any", False), ('{"a": [[0,1,""]]}', "a:any", False), ('{"a": [[0,1,[]],[0,1,{}]]}', "a:any", False), ('{"a": [[0,1,[0]],[0,1,{"b": 0}]]}', "a:all", True),
    ('{"a": [[0,1]]}', "a:any", False), ('{"a": [[0,1],[0,1,1,9]]}', "a:all", True), ('{"a": 5}', "a:any", False), ("no json", "a:any", False), (None, "not a:any", True), ('{"a b": [[0,1,1]]}', "a:any", False),
    ('{"a": [[0,1,false]], "b": [[0,1,true]]}', "(a:any or b:any) and not c:all", True),
]


@pytest.mark.parametrize("rule", sorted({c[1] for c in CASES}))
def test_variant_rules(spark, rule):
    cases = [(k, x, want) for k, (x, r, want) in enumerate(CASES) if r == rule]
    rows = spark.createDataFrame([(k, x) for k, x, _ in cases], "k long, x string").select("k", V.compile_rule(rule, F.col("x")).alias("out")).collect()
    assert {r["k"]: r["out"] for r in rows} == {k: want for k, _, want in cases}


def test_value_kinds(spark):
    docs = spark.createDataFrame([('{"a": [[0,1,1],[0,1,2.5]], "b": [[0,1,"x"]]}',), ('{"a": [[0,1,3]], "b": [[0,1,null]]}',), (None,)], "x string")
    got = {r["attribute"]: (r["schema"], r["entries"]) for r in V.value_kinds(docs, "x", ["a", "b"]).collect()}
    assert got["a"][1] == 3 and got["a"][0].startswith(("DECIMAL", "DOUBLE")) and got["b"] == ("STRING", 2)


TABLES = [
    ("no table at all <p>", True), ("<table><tr></td></table>", False), ("<table><tr><td>1</td></tr></table>", True), ("<table><tr><td>1</table>", True), ("<TABLE class='a'><tr><td>x<br/></td></tr></Table>", True),
    ("<table><tr>", False), ("<table></table></table>", False), ("<table><tr></tr></tr></table>", False), ("<table><td>a<br>b</td></table>", True), ("<table></b></table>", False), ("<table <table></table>", True), (None, None),
]


def test_tables_close(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(TABLES)], "k long, t string").select("k", P.balanced_html_tables(F.col("t")).alias("ok")).collect()
    assert {r["k"]: r["ok"] for r in rows} == {k: ok for k, (_, ok) in enumerate(TABLES)}


def test_formula_passes(spark):
    text = r"\(a $b$\) $$c$$ \[d \(e\)\] $f$ $ g$"
    one = lambda c: spark.createDataFrame([(text,)], "t string").select(c(F.col("t")).alias("x")).first()["x"]
    assert one(X.harvest_equations) == ["a $b$", "e", "d", "c", "f", "g"]
    kinds = [tuple(x) for x in spark.createDataFrame([(r"\begin{align*}x\end{align*} \begin{displaymath} y \end{displaymath} $z$ \(w\)",)], "t string").select(X.tex_equations(F.col("t")).alias("x")).first()["x"]]
    assert kinds == [("align*", "x"), ("displaymath", "y"), ("inline", "z"), ("inline", "w")]
