"""Queries for whole pipelines and for the smaller helpers around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions import fuzzy as Z
from docflow.functions import layout as L
from docflow.functions import text as X
from docflow.operators import bench as N
from docflow.operators import compare as C
from docflow.operators import documents as D
from docflow.operators import packs as K
from docflow.operators import rules as R
from docflow.operators import sampling as S
from docflow.plans import extensions as E
from docflow.operators.ordered import numbered
from docflow.operators.presence import passages_in, shared_runs
from docflow.operators.spans import around, box_groups, pieces
from docflow.plans.registry import Tables, query
from docflow.plans.table_queries import NGRAM, VOTES_SQL, votes
from docflow.plans.text_queries import attributed

c = F.col


def n():
    return F.count(F.lit(1))


# ---- pipelines --------------------------------------------------------------------------------------


def _page_results(t: Tables) -> DataFrame:
    """Replies of a stand-in model to page requests: it fails for every seventh page, and at first for every third."""

    def client():
        def ask(text: str, temperature: float) -> str | None:
            key = int(text.split(":")[0])
            if key % 7 == 0 or (key % 3 == 0 and temperature < 0.2):
                return None
            return text.split(":", 1)[1]

        return ask

    pages = t.conversations.select("conv_id", "turn", "text", (c("conv_id") + c("turn")).alias("key"))
    return E.call_model(pages, F.concat_ws(":", c("key").cast("string"), F.coalesce("text", F.lit(""))), client)


@query("pip_01_udf_05_09_10_page_pipeline", "WITH p AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN NULL ELSE coalesce(text, '') END AS x, (conv_id + turn) % 7 = 0 AS f FROM conversations), m AS (SELECT *, CASE WHEN x IS NULL THEN '' WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN x ELSE x || chr(10) END AS part FROM p) SELECT conv_id, sha1(string_agg(part, '' ORDER BY turn)) AS id, count(*) AS pages, count(*) FILTER (f) AS fallback FROM m GROUP BY 1 HAVING length(string_agg(part, '' ORDER BY turn)) > 0 AND count(*) FILTER (f) <= 0.5 * count(*)")
def _(t):
    docs = D.assemble(_page_results(t), "conv_id", "turn", "reply", {"fallback": F.count_if("is_fallback")})
    return docs.where(c("fallback") <= 0.5 * c("pages")).select("conv_id", F.sha1("text").alias("id"), "pages", "fallback")


@query("pip_02_plan_work", "WITH n AS (SELECT source || '/' || doc_id AS path, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), g AS (SELECT path, lang, floor((row_number() OVER (PARTITION BY lang ORDER BY path) - 1) / 10) AS k FROM n) SELECT sha1(string_agg(path, '' ORDER BY path)) AS work_hash, count(*) AS paths FROM g GROUP BY lang, k")
def _(t):
    new = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select("lang", F.concat("source", F.lit("/"), c("doc_id").cast("string")).alias("path"))
    groups = K.chunks(new, "path", 10, "lang").groupBy("lang", "chunk").agg(F.collect_list("path").alias("p"))
    return groups.select(X.group_hash(c("p")).alias("work_hash"), F.size("p").cast("long").alias("paths"))


@query("pip_03_workspace_report", "SELECT count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS tokens, count(*) FILTER (n_chars > 5000) AS long_docs FROM documents")
def _(t):
    rows = t.documents.withColumn("one", F.lit(1)).withColumn("zero", F.lit(0))
    return D.workspace_statistics(rows, "n_chars", "one", "zero", n(), 5000).select("docs", "tokens", "long_docs")


BENCH = "WITH hit AS (SELECT DISTINCT b.item_id, d.source FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))), y AS (SELECT c.source AS candidate, b.item_id % 4 AS category, avg((h.item_id IS NOT NULL)::INT) AS r FROM (SELECT DISTINCT source FROM documents) c CROSS JOIN benchmark b LEFT JOIN hit h ON h.source = c.source AND h.item_id = b.item_id GROUP BY ALL)"


@query("pip_04_udf_04_benchmark", BENCH + " SELECT candidate, CAST(category AS VARCHAR) AS category, round(r, 6) AS rate FROM y UNION ALL SELECT candidate, 'overall', round(avg(r), 6) FROM y GROUP BY 1")
def _(t):
    # Every candidate (a source) takes every test: does one of its documents hold the whole passage?
    # Tests that a candidate passes are counted and divided by the number of tests; none is written out to fail.
    category = (c("item_id") % 4).cast("string").alias("category")
    sizes = t.benchmark.groupBy(category).agg(F.count_distinct("item_id").alias("tests"))
    categories = sizes.agg(F.collect_list(F.struct("category", "tests")).alias("sizes"))  # one row: the benchmark's categories
    asked = t.documents.select(c("source").alias("candidate")).distinct().join(categories).select("candidate", F.inline("sizes"))
    hits = passages_in(t.benchmark, "item_id", t.documents, "doc_id").join(t.documents.select("doc_id", c("source").alias("candidate")), "doc_id")
    passed = hits.groupBy("candidate", category).agg(F.count_distinct("item_id").alias("passed"))
    rates = asked.join(passed, ["candidate", "category"], "left").select("candidate", "category", (F.coalesce("passed", F.lit(0)) / c("tests")).alias("rate"))
    overall = rates.groupBy("candidate").agg(F.avg("rate").alias("rate")).select("candidate", F.lit("overall").alias("category"), "rate")
    return rates.unionByName(overall).select("candidate", "category", F.round("rate", 6).alias("rate"))


@query("pip_04_udf_04_all_tests")
def _(t):
    # Every page has a test of each type; one candidate gives pages back as they are, one with slips, one lacks a third of them.
    d, pdf = c("doc_id"), c("doc_id").cast("string")
    parts = [F.lit("# Page "), pdf, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n| a | b |\n|---|---|\n| 1 | "), pdf, F.lit(" |\n\n$x_"), pdf, F.lit("$\n")]
    pages = t.documents.select("doc_id", "text", F.concat(*parts).alias("md"))
    test = lambda kind, **fields: F.struct(F.lit(kind).alias("type"), *[(fields[k] if k in fields else F.lit(None)).cast(v).alias(k) for k, v in N.FIELDS.items() if k not in ("type", "category")])
    slip = F.regexp_replace(F.substring("text", 30, 60), "^(.{9}).", "$1#")
    kinds = [
        test("present", text=slip, max_diffs=F.lit(2)), test("absent", text=F.lit("this sentence stands on none of the pages")), test("order", before=F.substring("text", 10, 30), after=F.substring("text", -30, 30), max_diffs=F.lit(1)),
        test("table", cell=pdf, up=F.lit("b")), test("math", math=F.concat(F.lit("x_"), pdf)), test("baseline", max_repeats=F.lit(30)),
    ]
    tests = pages.select(pdf.alias("pdf"), F.lit(1).alias("page"), F.explode(F.array(*kinds)).alias("x")).select("pdf", "page", F.concat_ws("_", "pdf", "x.type").alias("id"), "x.*")
    given = ((F.lit("as_it_is"), c("md")), (F.lit("slips"), F.regexp_replace("md", "th", "tn")), (F.when(d % 3 != 0, "lacks"), c("md")))
    made = F.array(*[F.struct(name.alias("candidate"), md.alias("md")) for name, md in given])
    outputs = pages.select(pdf.alias("pdf"), F.lit(1).alias("page"), F.inline(made)).where("candidate IS NOT NULL")
    out = N.report(tests, N.run_tests(tests, outputs, explain=False), outputs.select("candidate"), 200)
    return out.select("candidate", "category", "tests", *[F.round(x, 6).alias(x) for x in ("rate", "low", "high")])


@query("pip_05_udf_01_02_07_ext_35_38_41_evaluation")
def _(t):
    target = F.concat(F.lit("# T\n"), c("text"), F.lit(" $x^2$\n## U\n- one\n- two\n![a](b.png)<!-- bbox: 1, 2, 30, 4 -->\n<table><tr><td>1</td><td>"), "role", F.lit("</td></tr></table>\n```py\nx = 1\n```"))
    rel = F.concat(c("conv_id").cast("string"), F.lit("/"), c("turn").cast("string"))
    pairs = t.conversations.select(rel.alias("rel"), target.alias("target"), F.regexp_replace(target, "e", "3").alias("pred"))
    return E.evaluate(pairs, sorted(E.METRICS.names()))


@query("pip_06_rul_02_03_05_06_rule_variants", "SELECT doc_id, coalesce(quality = 1, false) AND NOT coalesce(toxic = 1, false) AS v1, NOT coalesce(quality = 1, false) OR coalesce(toxic = 1, false) AS v2 FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    a = c("attributes")
    return attributed(t).select("doc_id", R.compile_rule("quality:all and not toxic:avg>0.5", a).alias("v1"), R.compile_rule("not (quality:avg>=1) or toxic:all", a).alias("v2"))


@query("pip_07_flt_03_25_str_49_ext_50_51_tagging", "SELECT doc_id, 'stub_spam' AS name, n_chars AS end, doc_id % 3 = 0 AS value FROM documents")
def _(t):
    rows = E.call_model(t.documents.select("doc_id", "n_chars"), c("doc_id"), lambda: lambda text, heat: "true" if int(text) % 3 == 0 else "false")
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), c("n_chars").alias("end"), (c("reply") == "true").alias("value")))
    tagged = rows.select("doc_id", F.transform_keys(F.create_map(F.lit("spam"), span), lambda k, v: F.concat(F.lit("stub_"), k)).alias("a"))
    return tagged.select("doc_id", F.explode("a").alias("name", "s")).select("doc_id", "name", F.get("s", F.lit(0))["end"].alias("end"), F.get("s", F.lit(0))["value"].alias("value"))


@query("pip_08_decontamination", NGRAM + ", hit AS (SELECT DISTINCT doc_id FROM gn JOIN bn USING (k)) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)")
def _(t):
    hit = shared_runs(t.documents, "doc_id", t.benchmark).select("doc_id").distinct()
    return t.documents.select("doc_id").join(hit, "doc_id", "left_anti")


@query("pip_09_ext_20_21_22_repackage", "SELECT source || '/' || doc_id AS id, 'http://e.x/' || doc_id AS url, lang AS primary_language FROM documents WHERE n_chars > 0")
def _(t):
    key = F.concat("source", F.lit("/"), c("doc_id").cast("string"))
    urls = t.documents.select(key.alias("id"), F.concat(F.lit("http://e.x/"), c("doc_id").cast("string")).alias("url"), F.lit(1).alias("pos"))
    latest = urls.groupBy("id").agg(F.max_by("url", "pos").alias("url"))
    return t.documents.where("n_chars > 0").select(key.alias("id"), c("lang").alias("primary_language")).join(latest, "id", "left").select("id", "url", "primary_language")


@query("pip_10_snk_10_summary", r"SELECT regexp_extract(url, '^\w+://([^/?#]*)', 1) AS host, count(*) AS n, min(page_id) AS example FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 1000")
def _(t):
    return t.pages.groupBy(X.url_host(c("url")).alias("host")).agg(n().alias("n"), F.min("page_id").alias("example")).orderBy(F.desc("n"), "host").limit(1000)


@query("pip_11_alignment_report")
def _(t):
    rows = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("gold"), F.coalesce(F.regexp_replace("text", "the", "tha"), F.lit("")).alias("pred"))
    scored = rows.select("doc_id", F.length("gold").alias("size"), Z.row_udf(Z.document_similarity, T.DoubleType())(gold=c("gold"), pred=c("pred")).alias("a"))
    return scored.agg(F.round(F.sum("a") / n(), 6).alias("by_page"), F.round(F.sum(c("a") * c("size")) / F.sum("size"), 6).alias("by_char"))


@query("pip_12_ext_31_33_head_to_head", VOTES_SQL)
def _(t):
    return votes(t)


@query("pip_14_15_udf_03_curation_chain", "SELECT doc_id, '<|bbox_start|> ' || lang AS text FROM documents WHERE doc_id % 4 = 0 AND length(source) > 3")
def _(t):
    return E.chain(
        t.documents.select("doc_id", F.concat(F.lit("<!-- bbox: "), "lang").alias("text"), "source", ((c("doc_id") % 4) * 90).alias("rotation")),
        lambda d: d.where("rotation = 0"),
        lambda d: d.where(F.length("source") > 3),
        lambda d: d.select("doc_id", X.bbox_tokens(c("text")).alias("text")),
    )


@query("udf_06_reward_functions", "SELECT conv_id, turn, (role = 'user')::INT + 0.5 AS reward FROM conversations")
def _(t):
    if "role" not in E.REWARDS.names():
        E.REWARDS.add("role", "one for users")(lambda role: (role == "user").cast("int") + F.lit(0.5))
    return t.conversations.select("conv_id", "turn", E.REWARDS.get("role")(c("role")).alias("reward"))


CHAINED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
CHAINED = r"regexp_replace(regexp_replace(" + CHAINED + r", '={3,}', '===', 'g'), '-{3,}', '---', 'g')"


@query("pip_14_15_udf_03_text_chain", f"SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, {CHAINED} AS x FROM documents WHERE lang <> 'fr') WHERE length(x) >= 200")
def _(t):
    # Steps over whole texts: keep, clean, clean, drop what is short then.
    return E.chain(
        t.documents.select("doc_id", "lang", "text"),
        lambda d: d.where("lang != 'fr'"),
        lambda d: d.withColumn("text", X.normalize_whitespace(c("text"))),
        lambda d: d.withColumn("text", X.collapse_repeated_symbols(c("text"))),
        lambda d: d.where(F.length("text") >= 200),
        lambda d: d.select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest")),
    )


@query("arr_04_ext_42_document_record", "SELECT doc_id, len(string_split(text, chr(10))) AS lines, length(text) AS chars FROM documents")
def _(t):
    return t.documents.select("doc_id", F.struct(F.size(F.split("text", "\n")).cast("long").alias("lines"), F.length("text").cast("long").alias("chars")).alias("r")).select("doc_id", "r.*")


@query("arr_04_ext_42_text_records")
def _(t):
    # A turn with headings and a list, against itself with slips; the heading and list report is some of its columns.
    page = lambda head, x: F.concat(F.lit("# "), head, F.lit("\n\n"), x, F.lit("\n\n- "), "role", F.lit("\n- end\n"))
    rel = F.concat_ws("/", "conv_id", "turn")
    pairs = t.conversations.select(rel.alias("rel"), page(F.lit("Title"), F.regexp_replace("text", " the ", " tne ")).alias("pred"), page(F.when(c("turn") % 2 == 0, "Title").otherwise("Another"), c("text")).alias("target"))
    return E.text_records(pairs)


@query("prj_18_column_order", "SELECT doc_id, lang, n_chars, source FROM documents")
def _(t):
    preferred = ["doc_id", "lang", "missing"]
    rows = t.documents.drop("text")
    return rows.select([x for x in preferred if x in rows.columns] + sorted(x for x in rows.columns if x not in preferred))


@query("flt_12_math_renders", "SELECT doc_id, doc_id % 6 <> 0 AS renders FROM documents")
def _(t):
    # Distinct equations are looked up in a cache of render errors; a page fails if one of its equations does.
    rows = t.documents.select("doc_id", F.explode(X.harvest_equations(F.concat(F.lit("$x_"), (c("doc_id") % 6).cast("string"), F.lit("$")))).alias("eq"))
    errors = t.spark.createDataFrame([("x_0", "undefined")], "eq string, error string")
    bad = rows.join(errors, "eq", "left_semi").select("doc_id", F.lit(True).alias("bad")).distinct()
    return t.documents.select("doc_id").join(bad, "doc_id", "left").select("doc_id", c("bad").isNull().alias("renders"))


BOXES = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_discount) AS k, l_quantity AS x0, 10 * l_discount AS y0, l_quantity + 8 AS x1, 10 * l_discount + 0.3 AS y1 FROM lineitem"


@query("joi_22_box_components", f"WITH RECURSIVE b AS ({BOXES}), e AS (SELECT a.l_orderkey, a.k, o.k AS k2 FROM b a JOIN b o USING (l_orderkey) WHERE greatest(a.x0, o.x0) - least(a.x1, o.x1) <= 0.5 AND greatest(a.y0, o.y0) - least(a.y1, o.y1) <= 0.5), r AS (SELECT l_orderkey, k, k2 FROM e UNION SELECT r.l_orderkey, r.k, e.k2 FROM r JOIN e ON e.l_orderkey = r.l_orderkey AND e.k = r.k2), m AS (SELECT l_orderkey, k, min(k2) AS root FROM r GROUP BY ALL) SELECT l_orderkey, count(DISTINCT root) AS merged FROM m GROUP BY 1")
def _(t):
    # An order is a page, its lines are boxes.
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_discount", "l_partkey", "l_suppkey", "l_linenumber"))
    boxes = t.lineitem.select("l_orderkey", place.alias("k"), c("l_quantity").alias("x0"), (10 * c("l_discount")).alias("y0"), (c("l_quantity") + 8).alias("x1"), (10 * c("l_discount") + 0.3).alias("y1"))
    groups = box_groups(boxes, "l_orderkey", "k", 0.5, (16.0, 1.0))
    return groups.groupBy("l_orderkey").agg(F.count_distinct("group").alias("merged"))


@query("geo_05_equation_layout")
def _(t):
    # An order's lines are symbols; the other formula shows the status of a returned line in place of its flag.
    span = lambda text: F.struct(text.alias("text"), (4 * c("l_quantity")).alias("x"), (60 * c("l_discount")).alias("y"), F.lit(4.0).alias("w"), F.lit(4.0).alias("h"))
    shown = F.when((c("l_returnflag") == "R") & (c("l_tax") > 0.06), c("l_linestatus")).otherwise(c("l_returnflag"))
    both = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(span(c("l_returnflag")).alias("r"), span(shown).alias("o")))).alias("s"))
    out = Z.row_udf(L.same_layout, T.BooleanType())(reference=F.transform("s", lambda x: x["r"]), other=F.transform("s", lambda x: x["o"]))
    return both.select("l_orderkey", out.alias("same"))


@query("stm_09_growing_repeats", "SELECT doc_id, CAST(doc_id % 20 + 1 AS INTEGER) AS repeats FROM documents")
def _(t):
    from docflow.operators.filters import trailing_repeats

    text = F.concat(F.lit("x"), F.repeat(F.lit("ab"), (c("doc_id") % 20 + 1).cast("int")))
    return t.documents.select("doc_id", F.get(trailing_repeats(text, 2), F.lit(1)).alias("repeats"))


# ---- helpers ----------------------------------------------------------------------------------------


@query("ext_01_layout_predicate", "SELECT doc_id, doc_id % 3 > 1 OR doc_id % 5 = 0 AS full_page FROM documents")
def _(t):
    columns = (c("doc_id") % 3).cast("string")
    flag = F.when(c("doc_id") % 5 == 0, "Yes").otherwise("no")
    return t.documents.select("doc_id", ((columns.try_cast("int") > 1) | F.coalesce(D.coerce_bool(flag), F.lit(False))).alias("full_page"))


@query("ext_02_05_order_pairs")
def _(t):
    said = F.filter(X.sentences(c("text")), lambda s: F.length(s) >= 10)
    rows = t.documents.select("doc_id", F.posexplode(said).alias("pos", "s"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5(F.concat_ws(":", c("doc_id").cast("string"), c("pos").cast("string"))), "pos"))
    picked = rows.withColumn("r", rank).where("r <= 10").withColumn("pair", F.floor((c("r") - 1) / 2))
    pairs = picked.groupBy("doc_id", "pair").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("p")).where(F.size("p") == 2)
    before, after = F.get("p", F.lit(0))["s"], F.get("p", F.lit(1))["s"]
    return pairs.select("doc_id", "pair", before.alias("before"), after.alias("after"), F.round(0.05 * F.greatest(F.length(before), F.length(after))).cast("int").alias("max_diffs"))


@query("ext_03_04_cell_relations", "SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter([CASE WHEN l_linenumber > 1 THEN 'up' END, CASE WHEN l_linenumber < 7 THEN 'down' END], lambda x: x IS NOT NULL), ',') AS relations FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(D.flag_names({"up": c("l_linenumber") > 1, "down": c("l_linenumber") < 7}), ",").alias("relations"))


@query("ext_06_biased_page", "SELECT doc_id, CASE WHEN substr(md5('9:' || doc_id), 1, 1) < '8' THEN 1 ELSE doc_id % 9 + 1 END AS page FROM documents")
def _(t):
    return t.documents.select("doc_id", F.when(F.substring(S.order_key(c("doc_id"), "9"), 1, 1) < "8", 1).otherwise(c("doc_id") % 9 + 1).alias("page"))


@query("ext_07_08_09_10_11_57_verified_rows", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0")
def _(t):
    checked = E.call_model(t.documents.select("doc_id"), c("doc_id"), lambda: lambda text, heat: "keep" if int(text) % 2 == 0 else "drop")
    return checked.where("reply = 'keep'").select("doc_id")


@query("ext_13_delete_rejected", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    return t.documents.select("doc_id").join(t.labels.where("toxic = 1"), "doc_id", "left_anti")


@query("ext_16_blank_entries", "SELECT source, count(*) AS entries, count(*) FILTER (length(trim(text)) < 100) AS blank FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(n().alias("entries"), F.count_if(F.length(F.trim("text")) < 100).alias("blank"))


@query("ext_17_29_43_48_path_parts", "SELECT doc_id, source AS folder, 'out/' || source || '/p' || doc_id || '.json' AS mirrored, doc_id AS number FROM documents")
def _(t):
    path = F.concat(F.lit("s3://b/pdfs/"), "source", F.lit("/p"), c("doc_id").cast("string"), F.lit(".pdf"))
    numbers = F.regexp_extract_all(F.regexp_extract(path, r"([^/]+)\.pdf$", 1), F.lit(r"\d+"), F.lit(0))
    number = F.when(F.size(numbers) == 1, F.get(numbers, F.lit(0)).cast("long"))
    mirrored = F.regexp_replace(F.regexp_replace(path, r"^s3://b/pdfs/", "out/"), r"\.pdf$", ".json")
    return t.documents.select("doc_id", F.regexp_extract(path, r"pdfs/([^/]+)/", 1).alias("folder"), mirrored.alias("mirrored"), number.alias("number"))


@query("ext_19_first_unchecked", "SELECT source FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL ORDER BY source LIMIT 1")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left").where("quality IS NULL").orderBy("source").limit(1).select("source")


@query("ext_23_seeded_shuffle", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def _(t):
    return S.sample_n(t.documents.select("doc_id"), "doc_id", 50, "42")


@query("ext_24_25_record_gate", "SELECT conv_id || '-' || turn || '-page-' || (turn + 1) AS name FROM conversations WHERE conv_id % 3 <> 0 AND role = 'user'")
def _(t):
    objects = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("o")).where("conv_id % 3 != 0")
    rows = objects.select("conv_id", F.explode("o").alias("x")).where("x.role = 'user'")
    return rows.select(F.format_string("%d-%d-page-%d", c("conv_id"), c("x.turn"), c("x.turn") + 1).alias("name"))


@query("ext_26_27_28_requests", "SELECT doc_id, source || chr(10) || lang AS prompt FROM documents WHERE n_chars > 100")
def _(t):
    raw = F.concat(F.lit("RAW_TEXT_START\n"), "source", F.lit("\n"), "lang", F.lit("\nRAW_TEXT_END"))
    return t.documents.where("n_chars > 100").select("doc_id", X.raw_text_section(raw).alias("prompt"))


@query("ext_34_56_token_spans", "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations")
def _(t):
    return D.running_offsets(t.conversations, "conv_id", "turn", F.length("text").cast("long")).select("conv_id", "turn", "start")


GAP, SENTENCE = r"[^\p{L}\s]{3,}", r"[^.!?\n]*[.!?\n]|[^.!?\n]+$"
STRETCH, GAP_SQL = r"[^\p{L}\s]+|[\p{L}\s]+", "regexp_extract_all(text, '{}')"
SPANS_SQL = "SELECT doc_id, i - 1 AS i, CAST(coalesce(list_sum(list_transform(ps[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, ps[i] AS p FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, {} AS ps FROM documents))"


@query("ext_34_win_10_gap_sentences", f"WITH s AS ({SPANS_SQL.format(GAP_SQL.format(SENTENCE))}), st AS (SELECT *, a + length(p) AS b, max(i) OVER (PARTITION BY doc_id) AS most FROM s), g AS (SELECT doc_id, a, a + length(p) AS b FROM ({SPANS_SQL.format(GAP_SQL.format(STRETCH))}) WHERE regexp_full_match(p, '[^\\p{{L}}\\s]{{3,}}')), j AS (SELECT g.doc_id, g.a, g.b, min(st.i) AS lo, max(st.i) AS hi, any_value(most) AS most FROM g JOIN st ON st.doc_id = g.doc_id AND st.a < g.b AND g.a < st.b GROUP BY ALL), k AS (SELECT doc_id, a, b, greatest(lo - 1, 0) AS lo, least(hi + 1, most) AS hi FROM j) SELECT k.doc_id, k.a AS gap_start, k.b AS gap_end, x.a AS start, y.b AS \"end\" FROM k JOIN st x ON x.doc_id = k.doc_id AND x.i = k.lo JOIN st y ON y.doc_id = k.doc_id AND y.i = k.hi")
def _(t):
    # Gaps are runs of three and more signs and digits; each with the sentences that it touches and one more on either side.
    gaps = pieces(t.documents, "doc_id", "text", STRETCH).where(c("piece").rlike(f"^{GAP}$")).select("doc_id", "start", "end")
    found = around(gaps, pieces(t.documents, "doc_id", "text", SENTENCE), "doc_id", 1)
    return found.select("doc_id", c("start").alias("gap_start"), c("end").alias("gap_end"), c("from").alias("start"), c("to").alias("end"))


@query("ext_36_37_rule_pivot", "SELECT 'quality:any' AS leaf, count(l.doc_id) AS entries, count(*) FILTER (l.quality = 1) AS matched FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT 'toxic:any', count(l.doc_id), count(*) FILTER (l.toxic = 1) FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    stats = R.leaf_statistics(attributed(t), "quality:any and not toxic:any")
    tidy = stats.unpivot("leaf", ["entries", "matched"], "stat", "value")
    return tidy.groupBy("leaf").pivot("stat", ["entries", "matched"]).agg(F.first("value"))


@query("ext_39_40_table_reports")
def _(t):
    from docflow.functions import tables as G

    html = F.concat(F.lit("<table><tr><td>"), "lang", F.lit("</td><td>"), "source", F.lit("</td></tr></table>"))
    rows = t.documents.select(F.array(html).alias("pred"), F.when(c("doc_id") % 2 == 0, F.array(F.replace(html, c("lang"), F.lit("zz")))).otherwise(F.array().cast("array<string>")).alias("target"))
    score = Z.row_udf(lambda pred, target: G.table_f1(pred, target), T.StructType([T.StructField(k, T.DoubleType()) for k in ("p", "r", "f1", "avg_sim")]))
    scored = rows.where(F.size("target") > 0).select(score(pred=c("pred"), target=c("target")).alias("s"))
    return scored.agg(*[F.round(F.avg(f"s.{k}"), 4).alias(k) for k in ("p", "r", "f1", "avg_sim")])


@query("ext_44_image_references", r"SELECT page_id, len(regexp_extract_all(html, '<img[^>]*src=')) AS images FROM pages")
def _(t):
    both = F.concat(F.regexp_extract_all("html", F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), F.regexp_extract_all("html", F.lit(r"<img[^>]*src="), F.lit(0)))
    return t.pages.select("page_id", F.size(F.filter(both, lambda x: x.startswith("<img"))).cast("long").alias("images"))


@query("ext_45_54_55_output_grid", "SELECT source || '_pg' || p || '_repeat' || r || '.md' AS name FROM (SELECT DISTINCT source FROM documents), range(1, 3) a(p), range(1, 4) b(r) WHERE NOT (p = 1 AND r = 1)")
def _(t):
    grid = t.documents.select("source").distinct().select("source", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("p")).select("source", "p", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("r"))
    names = grid.select(F.concat("source", F.lit("_pg"), c("p").cast("string"), F.lit("_repeat"), c("r").cast("string"), F.lit(".md")).alias("name"))
    done = t.documents.select(F.concat("source", F.lit("_pg1_repeat1.md")).alias("name")).distinct()
    return names.join(done, "name", "left_anti")


@query("ext_46_52_changed_files", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0")
def _(t):
    old = t.documents.select("doc_id", F.md5(F.when(c("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(c("text"))).alias("h"))
    new = t.documents.select("doc_id", F.md5("text").alias("h2"))
    return new.join(old, "doc_id").where("h != h2").select("doc_id")


@query("ext_47_sample_rates", "SELECT event_id, round((value - lag(value) OVER w) / nullif(event_id - lag(event_id) OVER w, 0), 6) AS rate FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)")
def _(t):
    rows = numbered(t.events.select("event_id", "event_type", "value"), ["event_type"], ["event_id"], previous=["value", "event_id"])
    rate = (c("value") - c("previous.value")) / F.nullif(c("event_id") - c("previous.event_id"), F.lit(0))
    return rows.select("event_id", F.round(rate, 6).alias("rate"))


@query("ext_49_annotation_detail", "SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS bucket, doc_id FROM labels")
def _(t):
    return t.labels.select(D.first_true({"toxic": c("toxic") == 1}, "clean").alias("bucket"), "doc_id")
