import json

from pyspark.sql import functions as F

from docflow.operators import harvest as H
from docflow.plans import extensions as E
from docflow.sources import sinks as W


def one(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_outputs_by_name(spark):
    got = H.outputs_by_name(one(spark, "a/b_pg3_repeat12.md", "x_pg1_repeat1.txt", "y_pg_repeat1.md", "c_pg1_pg2_repeat1.md", None).withColumnRenamed("value", "path")).collect()
    assert {(r["pdf"], r["page"], r["repeat"]) for r in got} == {("b", 3, 12), ("c_pg1", 2, 1)}


def test_votes_and_ratings(spark):
    html = '<div class="entry gold eval" data-entry-id="a/1" data-left-metadata="L 1"\n data-right-metadata="R"><p></p></div> <div class="entry" data-entry-id="b" data-left-metadata="x" data-right-metadata="y">'
    got = H.votes_with_metadata(one(spark, html, None, "none").withColumnRenamed("value", "html"), one(spark, '{"a_1": "left", "zz": "right"}', "no json", None).withColumnRenamed("value", "store")).collect()
    assert [(r["entry_id"], r["classes"], r["left_metadata"], r["right_metadata"], r["vote"]) for r in got] == [("a_1", "gold eval", "L 1", "R", "left")]
    text = "Ratings\nname 1813.0 ± 84.9 [1605.9, 1930.0]\nbad 12 ± 1.0 [1.0, 2.0]\nother   12.5±1.0 [ 1.0, 2.0]\nlast 1.5 ± 2.5 [0.5,9.5]"
    assert [tuple(r) for r in H.ratings(one(spark, text, None)).collect()] == [("name", 1813.0, 84.9, 1605.9, 1930.0), ("last", 1.5, 2.5, 0.5, 9.5)]


def test_blind_sides(spark):
    rows = spark.createDataFrame([(k, f"g{k}", f"e{k}") for k in range(400)], "k long, g string, e string")
    got = H.blind_sides(rows, "k", "g", "e").collect()
    assert all((r["left"], r["right"]) == ((r["g"], r["e"]) if r["gold_side"] == "left" else (r["e"], r["g"])) for r in got)
    assert 150 < sum(r["gold_side"] == "left" for r in got) < 250
    assert sorted(map(tuple, got)) == sorted(map(tuple, H.blind_sides(rows.repartition(7), "k", "g", "e").collect()))


def test_archive_pages(spark):
    def record(status="Unrestricted", machine=False, kind="Image (JPG)", object_id="9", page=None, url="u", said="text", kind_of="Transcription", tags=True):
        target = {"naId": "5", "objectId": object_id} | ({"pageNum": page} if page else {})
        return json.dumps({"record": {"accessRestriction": {"status": status}, "digitalObjects": [{"objectId": "9", "objectType": kind, "objectUrl": url}]}, **({"record_tag": [{"aiMachineGenerated": machine}]} if tags else {}), "record_transcription": [{"target": target, "contributionType": kind_of, "contribution": said}]})

    good = [record(), record(page=3, tags=False), record(kind="tiff")]
    bad = [record(status="Restricted"), record(machine=True), record(kind="Audio"), record(object_id="8"), record(url=""), record(said=None), record(kind_of="Comment"), "no json", "{}", None]
    assert sorted(r["name"] for r in H.archive_pages(one(spark, *good, *bad)).collect()) == ["5-9-page-1", "5-9-page-1", "5-9-page-3"]


def test_shared_urls(spark):
    a = spark.createDataFrame([("HTTP://Ex.org/A/?q=1", "f1"), ("https://ex.org/A", "f2"), ("http://b.org", "f1"), (None, "f"), ("", "f")], "url string, file string")
    b = spark.createDataFrame([("ex.org/A#x", "o1"), ("http://ex.org/a", "o2"), ("b.org/", "o3"), ("b.org", "o3")], "url string, file string")
    assert {(r["url"], tuple(r["files"]), tuple(r["origins"])) for r in H.shared_urls(a, b).collect()} == {("ex.org/A", ("f1", "f2"), ("o1",)), ("b.org", ("f1",), ("o3",))}


def test_markdown_tree_and_summaries(spark, tmp_path):
    rows = spark.createDataFrame([("a/b/x.pdf", "Ä\nline"), ("a/y.tar.gz", ""), ("z", None)], "path string, page string")
    assert W.write_markdown_tree(rows, f"{tmp_path}/t", "path", "page") == 3
    assert sorted(p.relative_to(tmp_path / "t").as_posix() for p in (tmp_path / "t").rglob("*.md")) == ["a/b/x.md", "a/y.tar.md", "z.md"]
    assert {tuple(r) for r in W.read_markdown_tree(spark, f"{tmp_path}/t").collect()} == {("a/b/x.md", "Ä\nline")}  # empty files are not listed
    W.write_summaries(spark.createDataFrame([(f"h{k}", k % 5) for k in range(30)], "h string, n long"), f"{tmp_path}/s", "h", "n", 6, 4)
    read = {k: spark.read.option("header", True).csv(f"{tmp_path}/s/{k}").collect() for k in ("map", "top", "sample")}
    assert [len(read[k]) for k in ("map", "top", "sample")] == [30, 6, 4] and {r["n"] for r in read["top"]} == {"4"}


def test_text_records(spark):
    page = "# Title\n\nSome words here\n\n- one\n- two\n"
    pairs = spark.createDataFrame([("same", page, page), ("same", page, page.replace("Title", "Quite another")), (None, "", page), ("none", None, " "), ("plain", "just text", "just text")], "rel string, pred string, target string")
    got = E.text_records(pairs).collect()
    assert sorted(str(r["rel"]) for r in got) == ["None", "plain", "same", "same"]
    best, worse = sorted((r for r in got if r["rel"] == "same"), key=lambda r: r["text_edit"])
    assert (best["heading_structure_f1"], best["list_f1"], best["text_edit"], best["contents_sim"], best["has_heading_gt"], best["has_list_gt"]) == (1, 1, 0, 1, True, True)
    assert worse["heading_structure_f1"] == 0 and worse["list_f1"] == 1 and 0 < worse["text_edit"] < 1
    plain = next(r for r in got if r["rel"] == "plain")
    assert not plain["has_heading_gt"] and plain["text_edit_sim"] == 1
    assert E.f1_report(E.text_records(pairs)).columns == ["rel", "heading_structure_p", "heading_structure_r", "heading_structure_f1", "level_p", "level_r", "level_f1", "list_p", "list_r", "list_f1"]
