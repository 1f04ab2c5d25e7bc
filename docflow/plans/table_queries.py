"""Queries for documents, joins, aggregates, windows, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import text as X
from docflow.operators import compare as C
from docflow.operators import documents as D
from docflow.operators import harvest as V
from docflow.operators import packs as K
from docflow.operators import sampling as S
from docflow.operators.ordered import numbered
from docflow.operators.presence import passages_in, shared_runs
from docflow.plans.registry import Tables, query

c = F.col


def one():
    return F.count(F.lit(1))


# ---- documents and pages ----------------------------------------------------------------------------


def _pages(t: Tables) -> DataFrame:
    """Conversation turns as pages; every seventh turn has no text."""
    text = F.when((c("conv_id") + c("turn")) % 7 == 0, None).otherwise(c("text"))
    return t.conversations.select("conv_id", c("turn").alias("page"), text.alias("text"), F.length("text").cast("long").alias("tokens"))


PAGES = "WITH p AS (SELECT conv_id, turn AS page, CASE WHEN (conv_id + turn) % 7 = 0 THEN NULL ELSE text END AS text, length(text) AS tokens FROM conversations), m AS (SELECT *, CASE WHEN text IS NULL THEN '' WHEN page = max(page) OVER (PARTITION BY conv_id) THEN text ELSE text || chr(10) END AS part FROM p)"
ASSEMBLED = PAGES + ", d AS (SELECT conv_id, string_agg(part, '' ORDER BY page) AS text, count(*) AS pages, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY conv_id HAVING length(string_agg(part, '' ORDER BY page)) > 0)"


def _assembled(t: Tables) -> DataFrame:
    return D.assemble(_pages(t), "conv_id", totals={"tokens": F.sum("tokens")})


@query("agg_01_assemble_documents", ASSEMBLED + " SELECT conv_id, text FROM d")
def _(t):
    return _assembled(t).select("conv_id", "text")


@query("agg_02_page_spans", PAGES + ", o AS (SELECT conv_id, page, length(part) AS n, sum(length(part)) OVER (PARTITION BY conv_id ORDER BY page) AS e FROM m), k AS (SELECT conv_id FROM m GROUP BY conv_id HAVING sum(length(part)) > 0) SELECT conv_id, page, CAST(e - n AS BIGINT) AS start, CAST(e AS BIGINT) AS end FROM o WHERE conv_id IN (SELECT conv_id FROM k)")
def _(t):
    return _assembled(t).select("conv_id", F.inline("spans")).select("conv_id", "page", "start", "end")


@query("agg_03_document_totals", ASSEMBLED + " SELECT conv_id, pages, tokens FROM d")
def _(t):
    return _assembled(t).select("conv_id", "pages", "tokens")


@query("agg_04_empty_documents_dropped", ASSEMBLED + " SELECT count(*) AS n FROM d")
def _(t):
    return _assembled(t).agg(one().alias("n"))


@query("agg_05_workspace_statistics", ASSEMBLED + " SELECT count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(pages % 2) AS BIGINT) AS fallback, count(*) FILTER (tokens > 500) AS long_docs, CAST(coalesce(sum(tokens) FILTER (tokens > 500), 0) AS BIGINT) AS long_tokens, 1000 - count(*) AS skipped, round(sum(tokens) / greatest(count(*), 1), 4) AS tokens_each, round(sum(pages) / greatest(count(*), 1), 4) AS pages_each FROM d")
def _(t):
    docs = _assembled(t).withColumn("fallback", c("pages") % 2)
    return D.workspace_statistics(docs, "tokens", "pages", "fallback", F.lit(1000), 500)


@query("prj_01_explode_pages", PAGES + " SELECT conv_id, page, part AS page_text FROM m WHERE conv_id IN (SELECT conv_id FROM m GROUP BY conv_id HAVING sum(length(part)) > 0)")
def _(t):
    return D.explode_pages(_assembled(t)).select("conv_id", "page", "page_text")


@query("win_01_running_offsets", "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end FROM conversations")
def _(t):
    return D.running_offsets(t.conversations, "conv_id", "turn", F.length("text").cast("long")).select("conv_id", "turn", "start", "end")


@query("prj_02_array_alignment", "SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN ['en', 'de', lang][doc_id % 5 + 1] ELSE 'none' END AS value FROM documents")
def _(t):
    values = F.array(F.lit("en"), F.lit("de"), c("lang"))
    return t.documents.select("doc_id", D.aligned(values, (c("doc_id") % 5).cast("int"), F.lit("none")).alias("value"))


@query("prj_03_first_page", "SELECT doc_id, trim(string_split(text, chr(10))[1]) AS first_page FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def _(t):
    spans = F.array(F.struct(F.lit(0).alias("start"), F.length(F.get(F.split("text", "\n"), F.lit(0))).alias("end")))
    rows = t.documents.where(c("text").isNotNull() & c("source").isNotNull()).withColumn("s", F.get(spans, F.lit(0)))
    return rows.select("doc_id", F.trim(F.substring(c("text"), c("s.start") + 1, c("s.end") - c("s.start"))).alias("first_page"))


@query("prj_04_05_reshape", "SELECT doc_id AS id, 'docs/' || source AS path, n_chars AS size FROM documents WHERE lang = 'en' AND n_chars IS NOT NULL")
def _(t):
    return t.documents.where((c("lang") == "en") & c("n_chars").isNotNull()).select(c("doc_id").alias("id"), F.concat(F.lit("docs/"), "source").alias("path"), c("n_chars").alias("size"))


@query("prj_06_07_page_identity", "SELECT page_id, regexp_replace(url, '^\\w+://', '') AS doc, CAST(page_id % 9 AS INTEGER) AS number FROM pages")
def _(t):
    path = F.concat(F.lit("root/"), F.regexp_replace("url", r"^\w+://", ""), F.lit("-"), (c("page_id") % 9).cast("string"), F.lit(".md"))
    doc = F.regexp_replace(F.regexp_replace(path, r"^root/", ""), r"\.md$", "")
    number = F.coalesce(F.lit(None).cast("int"), F.regexp_extract(doc, r"-(\d+)$", 1).try_cast("int"))
    return t.pages.select("page_id", F.regexp_replace(doc, r"-\d+$", "").alias("doc"), number.alias("number"))


@query("prj_08_response_defaults", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS primary_language, true AS is_rotation_valid, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 90 END AS INTEGER) AS rotation_correction, false AS is_table, doc_id % 2 = 0 AS is_diagram, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS natural_text FROM documents")
def _(t):
    d = c("doc_id")
    r = D.default_response(F.when(d % 3 == 0, "true").otherwise(c("lang")), F.lit(None).cast("boolean"), F.when(d % 4 != 0, 90), F.lit(None).cast("boolean"), d % 2 == 0, F.when(d % 5 == 0, " ").otherwise(c("source")))
    return t.documents.select("doc_id", r.alias("r")).select("doc_id", "r.*")


@query("prj_09_lenient_scalars", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag, CAST(CASE WHEN doc_id % 5 < 4 THEN (doc_id % 5) * 90 ELSE 0 END AS INTEGER) AS rotation FROM documents")
def _(t):
    d = c("doc_id")
    raw = F.get(F.array(*map(F.lit, [" Yes", "0", "TRUE ", "n", "maybe", ""])), (d % 6).cast("int"))
    turn = F.get(F.array(*map(F.lit, ["0", "90", "180", "270", "45"])), (d % 5).cast("int"))
    return t.documents.select("doc_id", D.coerce_bool(raw).alias("flag"), D.coerce_rotation(turn).alias("rotation"))


@query("prj_10_extras", "SELECT doc_id, '{\"source\":\"' || source || '\"}' AS extras FROM documents")
def _(t):
    m = F.create_map(F.lit("id"), c("doc_id").cast("string"), F.lit("lang"), c("lang"), F.lit("source"), c("source"))
    return t.documents.select("doc_id", F.to_json(F.map_filter(m, lambda k, v: ~k.isin("id", "lang"))).alias("extras"))


@query("prj_11_page_tests", "SELECT b.item_id, 'doc_pg' || (b.item_id % 3 + 1) || '.pdf' AS pdf, 1 AS page FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = b.item_id * 2)")
def _(t):
    keep = t.documents.select((c("doc_id") / 2).alias("half")).where("half = floor(half)")
    rows = t.benchmark.join(keep, c("item_id") == c("half"), "left_semi")
    return rows.select("item_id", F.concat(F.lit("doc_pg"), (c("item_id") % 3 + 1).cast("string"), F.lit(".pdf")).alias("pdf"), F.lit(1).alias("page"))


@query("prj_12_13_attribute_spans", "SELECT doc_id, 'model_quality' AS name, 0 AS start, least(n_chars, 100) AS split, n_chars AS end FROM documents")
def _(t):
    n = F.least(c("n_chars"), F.lit(100))
    spans = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end"), F.lit(True).alias("value")), F.struct(n.alias("start"), c("n_chars").alias("end"), F.lit(None).cast("boolean").alias("value")))
    attributes = F.transform_keys(F.create_map(F.lit("quality"), spans), lambda k, v: F.concat(F.lit("model_"), k))
    rows = t.documents.select("doc_id", F.explode(attributes).alias("name", "spans"))
    return rows.select("doc_id", "name", F.get("spans", F.lit(0))["start"].cast("int").alias("start"), F.get("spans", F.lit(0))["end"].alias("split"), F.get("spans", F.lit(1))["end"].alias("end"))


@query("prj_14_15_pii_flag", "SELECT d.doc_id, CASE WHEN lang = 'fr' THEN false ELSE coalesce(toxic = 1, false) OR (coalesce(quality = 1, false) AND d.doc_id % 2 = 0) END AS pii FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.select("doc_id", D.pii_flag(c("lang") == "fr", c("toxic") == 1, c("quality") == 1, c("doc_id") % 2 == 0).alias("pii"))


@query("prj_16_17_flag_names", "SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'name' END, CASE WHEN doc_id % 3 = 0 THEN 'email' END, CASE WHEN doc_id % 5 = 0 THEN 'phone' END], lambda x: x IS NOT NULL), ',') AS kinds FROM documents")
def _(t):
    flags = {n: c("doc_id") % k == 0 for n, k in (("name", 2), ("email", 3), ("phone", 5))}
    return t.documents.select("doc_id", F.array_join(D.flag_names(flags), ",").alias("kinds"))


PRICES = {"A100": 1.39, "H100": 2.69, "L40S": 0.79}


@query("prj_20_cost_projection", "WITH r AS (SELECT event_type, count(*) / (epoch(max(ts)) - epoch(min(ts))) AS rate FROM events GROUP BY 1) SELECT event_type, gpu, round(price / (rate * 3600) * 1000000, 2) AS dollars FROM r, (VALUES " + ", ".join(f"('{k}', {v})" for k, v in PRICES.items()) + ") v(gpu, price)")
def _(t):
    # What a million events of each type cost at the rate at which they came, by the price of an hour.
    at = F.unix_micros(c("ts").cast("timestamp")) / 1e6
    rates = t.events.groupBy("event_type").agg((one() / (F.max(at) - F.min(at))).alias("rate"))
    prices = F.array(*[F.struct(F.lit(k).alias("gpu"), F.lit(v).alias("price")) for k, v in PRICES.items()])
    return rates.select("event_type", "rate", F.inline(prices)).select("event_type", "gpu", F.round(D.cost_per_million(c("price"), c("rate")), 2).alias("dollars"))


# ---- sources ----------------------------------------------------------------------------------------


@query("src_05_last_wins", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def _(t):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return t.events.withColumn("r", rank).where("r = 1").select("user_id", "value")


@query("src_06_jsn_01_record_layouts", "SELECT doc_id, source AS path, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE lang END AS text FROM documents")
def _(t):
    d = c("doc_id") % 4
    raw = (
        F.when(d == 0, F.to_json(F.struct(c("source").alias("custom_id"), F.array(F.struct(c("lang").alias("text"))).alias("outputs"))))
        .when(d == 1, F.to_json(F.struct(c("source").alias("s3_path"), c("lang").alias("text"))))
        .when(d == 2, F.to_json(F.struct(c("source").alias("custom_id"), F.struct(F.struct(F.array(F.struct(F.struct(c("lang").alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response"))))
        .otherwise(F.to_json(F.struct(c("source").alias("custom_id"), F.lit("x").alias("completion_error"))))
    )
    g = lambda p: F.get_json_object("raw", p)
    rows = t.documents.select("doc_id", raw.alias("raw"))
    text = F.coalesce(g("$.outputs[0].text"), g("$.text"), g("$.response.body.choices[0].message.content"), g("$.response.choices[0].message.content"))
    return rows.select("doc_id", F.coalesce(g("$.s3_path"), g("$.custom_id")).alias("path"), text.alias("text"))


@query("src_12_22_dimension_lookup", "SELECT o.o_orderkey, c.c_name AS name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def _(t):
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey"), "left").select("o_orderkey", c("c_name").alias("name"))


@query("src_13_completed_scan", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    done = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey")
    return t.orders.where("o_orderstatus = 'F' AND o_totalprice > 0").join(done, c("o_orderkey") == c("l_orderkey"), "left_anti").select("o_orderkey")


@query("src_14_flt_19_20_transcripts", "SELECT conv_id, text AS transcription FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') WHERE r = 1 AND conv_id % 3 <> 0")
def _(t):
    entries = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    tags = F.array(F.struct((c("conv_id") % 3 == 0).alias("machine")))
    rows = t.conversations.groupBy("conv_id").agg(entries.alias("e")).withColumn("tags", tags)
    first = F.get(F.filter("e", lambda x: x["role"] == "user"), F.lit(0))["text"]
    return rows.where(~F.exists("tags", lambda x: x["machine"])).select("conv_id", first.alias("transcription")).where("transcription IS NOT NULL")


@query("src_17_25_26_harvest", r"SELECT page_id, len(regexp_extract_all(html, 'https?://[^\s<>]+')) AS links FROM pages")
def _(t):
    return t.pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"https?://[^\s<>]+"), F.lit(0))).cast("long").alias("links"))


@query("src_19_duplicate_ids", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(one().alias("n")).where("n > 1")


@query("src_20_set_01_path_union", "SELECT DISTINCT trim(source) AS path FROM documents WHERE trim(source) <> '' UNION SELECT 'x'")
def _(t):
    extra = t.spark.createDataFrame([("x",), ("src1",)], "path string")
    return t.documents.select(F.trim("source").alias("path")).where("path != ''").union(extra.where("path = 'x'")).distinct()


@query("src_23_deny_list_parts", "SELECT page_id, nullif(regexp_extract(url, '([^/]+)/([^/]*)$', 1), '') AS folder, nullif(regexp_extract(url, '([^/]+)/([^/]*)$', 2), '') AS name FROM pages")
def _(t):
    part = lambda k: F.nullif(F.regexp_extract("url", r"([^/]+)/([^/]*)$", k), F.lit(""))
    return t.pages.select("page_id", part(1).alias("folder"), part(2).alias("name"))


# ---- joins and sets ---------------------------------------------------------------------------------


@query("joi_01_map_01_attribute_merge", "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 4 = 0 THEN 9 END, l.quality) AS quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    base = F.create_map(F.lit("quality"), c("quality"), F.lit("toxic"), c("toxic"))
    later = F.when(c("doc_id") % 4 == 0, F.create_map(F.lit("quality"), F.lit(9)))
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", base.alias("m"), later.alias("n"))
    # Later attributes win: earlier entries with their keys are filtered out first.
    merged = F.when(c("n").isNull(), c("m")).otherwise(F.map_concat(F.map_filter("m", lambda k, v: ~F.map_contains_key(F.coalesce("n", F.create_map().cast("map<string,int>")), k)), "n"))
    return rows.select("doc_id", merged["quality"].alias("quality"), merged["toxic"].alias("toxic"))


@query("joi_02_set_04_common_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(t):
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id"))


@query("joi_03_gold_lookup", "SELECT l.doc_id, l.quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE d.lang = 'en'")
def _(t):
    return t.documents.where("lang = 'en'").join(t.labels, "doc_id").select("doc_id", "quality")


@query("joi_04_agg_06_test_scores", "SELECT b.item_id, d.source AS candidate, round(avg(CASE WHEN d.doc_id IS NULL THEN 0.0 ELSE CAST(d.n_chars % 2 AS DOUBLE) END), 6) AS score, avg(CASE WHEN d.doc_id IS NULL THEN 0.0 ELSE CAST(d.n_chars % 2 AS DOUBLE) END) > 0.5 AS ok FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY 1, 2")
def _(t):
    # A test's pages are the documents that hold its passage; without any it has no candidate.
    pages = passages_in(t.benchmark, "item_id", t.documents, "doc_id").join(t.documents.select("doc_id", "source", "n_chars"), "doc_id")
    rows = t.benchmark.select("item_id").join(pages, "item_id", "left").select("item_id", c("source").alias("candidate"), F.coalesce((c("n_chars") % 2).cast("double"), F.lit(0.0)).alias("passed"))
    return rows.groupBy("item_id", "candidate").agg(F.round(F.avg("passed"), 6).alias("score"), (F.avg("passed") > 0.5).alias("ok"))


@query("joi_05_paired_pages", "SELECT a.page_id, b.doc_id FROM pages a JOIN documents b ON a.page_id = b.doc_id")
def _(t):
    return t.pages.join(t.documents, c("page_id") == c("doc_id")).select("page_id", "doc_id")


@query("joi_06_lookup_chain", "SELECT l.l_orderkey, l.l_linenumber, n.n_name AS nation FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey")
def _(t):
    return t.lineitem.join(t.supplier, c("l_suppkey") == c("s_suppkey"), "left").join(t.nation, c("s_nationkey") == c("n_nationkey"), "left").select("l_orderkey", "l_linenumber", c("n_name").alias("nation"))


@query("joi_07_27_alternate_key", "SELECT d.doc_id, coalesce(a.quality, b.quality) AS quality FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id + 1")
def _(t):
    a, b = t.labels.select(c("doc_id").alias("k1"), c("quality").alias("q1")), t.labels.select(c("doc_id").alias("k2"), c("quality").alias("q2"))
    rows = t.documents.join(a, c("doc_id") == c("k1"), "left").join(b, c("doc_id") + 1 == c("k2"), "left")
    return rows.select("doc_id", F.coalesce("q1", "q2").alias("quality"))


@query("joi_08_contaminated", "SELECT item_id FROM benchmark b WHERE item_id % 11 = 0 OR EXISTS (SELECT 1 FROM pages p WHERE p.page_id = b.item_id)")
def _(t):
    keyed = t.benchmark.withColumn("uri", F.when(c("item_id") % 11 == 0, "").otherwise(c("item_id").cast("string")))
    train = t.pages.select(c("page_id").cast("string").alias("u"))
    hit = keyed.where("uri != ''").join(train, c("uri") == c("u"), "left_semi")
    return hit.unionByName(keyed.where("uri = ''")).select("item_id")


@query("joi_09_10_16_17_anti", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)")
def _(t):
    bad = t.lineitem.where("l_quantity > 45").select("l_orderkey")
    return t.orders.join(bad, c("o_orderkey") == c("l_orderkey"), "left_anti").select("o_orderkey")


@query("joi_11_12_set_02_03_new_work", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t):
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("joi_13_14_15_skip_done", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 150000)")
def _(t):
    # Customers without a large order that is settled or open: what is done is skipped.
    done = t.orders.where("o_orderstatus <> 'P' AND o_totalprice > 150000").select("o_custkey")
    return t.customer.join(done, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


@query("joi_16_all_rejected", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'R')")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.every(c("l_returnflag") == "R").alias("all")).where("all").select("l_orderkey")


@query("joi_18_candidate_pairs", "SELECT a.conv_id, a.turn AS left_turn, b.turn AS right_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def _(t):
    a = t.conversations.select("conv_id", c("turn").alias("left_turn"))
    b = t.conversations.select("conv_id", c("turn").alias("right_turn"))
    return a.join(b, "conv_id").where("left_turn < right_turn")


VOTES_SQL = "SELECT least(a, b) AS first, greatest(a, b) AS second, count(*) FILTER (w = least(a, b)) AS wins, count(*) FILTER (w = greatest(a, b)) AS losses FROM (SELECT event_type AS a, CASE user_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'signup' END AS b, CASE WHEN value > 50 THEN event_type ELSE CASE user_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'signup' END END AS w FROM events) WHERE a <> b GROUP BY 1, 2"


@query("joi_19_agg_38_votes", VOTES_SQL)
def _(t):
    return votes(t)


@query("joi_20_order_test", "SELECT conv_id, min(turn) FILTER (role = 'user') < max(turn) FILTER (role = 'assistant') AS ordered FROM conversations GROUP BY conv_id")
def _(t):
    return t.conversations.groupBy("conv_id").agg((F.min(F.when(c("role") == "user", c("turn"))) < F.max(F.when(c("role") == "assistant", c("turn")))).alias("ordered"))


PLAIN_URL = r"regexp_replace(lower(regexp_extract({0}, '^[^/]*')) || regexp_replace({0}, '^[^/]*', ''), '/$', '')".format(r"regexp_replace(regexp_replace({}, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '')")


@query(
    "joi_23_url_provenance",
    r"WITH l AS (SELECT " + PLAIN_URL.format(*["url"] * 2) + r" AS u, 'part_' || page_id % 7 AS f FROM pages WHERE page_id % 3 <> 0), o AS (SELECT " + PLAIN_URL.format(*["url || CASE WHEN page_id % 2 = 0 THEN '#x' ELSE '' END"] * 2)
    + r" AS u, regexp_extract(url, '^\w+://([^/?#]*)', 1) AS f FROM pages WHERE page_id % 5 <> 0) SELECT l.u AS url, string_agg(DISTINCT l.f, ',' ORDER BY l.f) AS files, string_agg(DISTINCT o.f, ',' ORDER BY o.f) AS origins FROM l JOIN o USING (u) GROUP BY l.u",
)
def _(t):
    # Two lists of addresses, written differently, each with where an address stands.
    local = t.pages.where("page_id % 3 != 0").select("url", F.concat(F.lit("part_"), (c("page_id") % 7).cast("string")).alias("file"))
    other = t.pages.where("page_id % 5 != 0").select(F.concat("url", F.when(c("page_id") % 2 == 0, "#x").otherwise("")).alias("url"), X.url_host(c("url")).alias("file"))
    found = V.shared_urls(local, other)
    return found.select("url", F.array_join("files", ",").alias("files"), F.array_join("origins", ",").alias("origins"))


@query("src_17_candidate_outputs", r"WITH n AS (SELECT 'out/' || source || CASE WHEN doc_id % 9 = 0 THEN '_page' ELSE '_pg' END || doc_id % 50 || '_repeat' || doc_id % 3 || CASE WHEN doc_id % 11 = 0 THEN '.txt' ELSE '.md' END AS path FROM documents) SELECT regexp_extract(path, 'out/(.+)_pg(\d+)_repeat(\d+)\.md$', 1) AS pdf, CAST(regexp_extract(path, '_pg(\d+)_', 1) AS INTEGER) AS page, count(DISTINCT regexp_extract(path, '_repeat(\d+)', 1)) AS repeats FROM n WHERE regexp_matches(path, '_pg\d+_repeat\d+\.md$') GROUP BY 1, 2")
def _(t):
    d = c("doc_id")
    name = F.concat(F.lit("out/"), "source", F.when(d % 9 == 0, "_page").otherwise("_pg"), (d % 50).cast("string"), F.lit("_repeat"), (d % 3).cast("string"), F.when(d % 11 == 0, ".txt").otherwise(".md"))
    return V.outputs_by_name(t.documents.select(name.alias("path"))).groupBy("pdf", "page").agg(F.count_distinct("repeat").alias("repeats"))


@query("src_25_votes_with_metadata", "SELECT role || ':' || turn AS left_metadata, vote, count(*) AS n FROM (SELECT role, turn, CASE WHEN length(text) % 3 = 0 THEN 'left' WHEN length(text) % 3 = 1 THEN 'right' ELSE 'both_bad' END AS vote FROM conversations WHERE turn % 4 <> 3) GROUP BY ALL")
def _(t):
    # A page of entries a conversation, and a store of votes that knows some entries only.
    key = F.concat_ws("/", "conv_id", "turn")
    entry = F.format_string('<div class="entry gold eval" data-entry-id="%s"\n data-left-metadata="%s" data-right-metadata="x"><p>...</p></div>', key, F.concat_ws(":", "role", "turn"))
    pages = t.conversations.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("html"))
    size = F.length("text") % 3
    vote = F.struct(F.concat_ws("_", "conv_id", "turn"), F.when(size == 0, "left").when(size == 1, "right").otherwise("both_bad"))
    stores = t.conversations.where("turn % 4 != 3").groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_list(vote))).alias("store"))
    return V.votes_with_metadata(pages, stores).groupBy("left_metadata", "vote").agg(one().alias("n"))


@query("ext_31_rating_reports", "SELECT event_type AS name, user_id % 20 AS k, round(round(avg(value) * 10, 2), 2) AS rating, round(max(value), 1) AS high FROM events GROUP BY 1, 2")
def _(t):
    by = t.events.groupBy((c("user_id") % 20).alias("k"), "event_type").agg(F.round(F.avg("value") * 10, 2).alias("r"), F.round(F.max("value"), 1).alias("h"))
    line = F.format_string("%s  %.2f ± 1.5 [0.0, %.1f]", "event_type", "r", "h")
    reports = by.groupBy("k").agg(F.concat(F.lit("Ratings\n=======\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("value"))
    return V.ratings(reports, keep=("k",)).select("name", "k", "rating", "high")


@query("ext_33_blind_sides", "SELECT doc_id, CASE WHEN substr(md5(doc_id || 's'), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'left' ELSE 'right' END AS gold_side, md5(CASE WHEN substr(md5(doc_id || 's'), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN text ELSE reverse(text) END) AS left_md5 FROM documents")
def _(t):
    pairs = t.documents.select("doc_id", c("text").alias("gold"), F.reverse("text").alias("other"))
    return V.blind_sides(pairs, "doc_id", "gold", "other", "s").select("doc_id", "gold_side", F.md5("left").alias("left_md5"))


@query("ext_24_archive_records", "SELECT doc_id || '-' || doc_id || 'o1-page-' || CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 ELSE 1 END AS name, md5(text) AS digest FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0")
def _(t):
    # Records as JSON: restricted ones, tags of machines, objects of other types, pages without numbers.
    d, text = c("doc_id"), c("doc_id").cast("string")
    thing = lambda k, kind: F.struct(F.concat(text, F.lit(k)).alias("objectId"), kind.alias("objectType"), F.lit("http://e.x/").alias("objectUrl"))
    record = F.struct(F.struct(F.when(d % 3 != 0, "Unrestricted").otherwise("Restricted - Partly").alias("status")).alias("accessRestriction"), F.array(thing("o1", F.when(d % 5 != 0, "Image (JPG)").otherwise("Audio")), thing("o2", F.lit("Image (TIFF)"))).alias("digitalObjects"))
    said = F.array(F.struct(F.struct(text.alias("naId"), F.concat(text, F.lit("o1")).alias("objectId"), F.when(d % 2 == 0, (d % 9).cast("int")).alias("pageNum")).alias("target"), F.lit("Transcription").alias("contributionType"), c("text").alias("contribution")))
    records = t.documents.select(F.to_json(F.struct(record.alias("record"), F.array(F.struct((d % 4 == 0).alias("aiMachineGenerated"))).alias("record_tag"), said.alias("record_transcription"))).alias("value"))
    return V.archive_pages(records).select("name", F.md5("transcription").alias("digest"))


@query("joi_24_preferred_match", "SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'label' WHEN item_id IS NOT NULL THEN 'bench' ELSE 'none' END AS found FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def _(t):
    options = t.labels.select("doc_id", F.lit(1).alias("rank"), F.lit("label").alias("found")).unionByName(t.benchmark.select(c("item_id").alias("doc_id"), F.lit(2).alias("rank"), F.lit("bench").alias("found")))
    best = options.groupBy("doc_id").agg(F.min_by("found", "rank").alias("found"))
    return t.documents.join(best, "doc_id", "left").select("doc_id", F.coalesce("found", F.lit("none")).alias("found"))


@query("joi_25_grouped_tests", "SELECT o_orderkey, count(l_linenumber) AS tests, o_orderstatus AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 3")
def _(t):
    tests = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("t"))
    return t.orders.join(tests, c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("tests"), c("o_orderstatus").alias("status"))


@query("joi_full_outer", "SELECT coalesce(d.doc_id, l.page_id) AS id, d.doc_id IS NOT NULL AS left_side, l.page_id IS NOT NULL AS right_side FROM documents d FULL JOIN pages l ON l.page_id * 3 = d.doc_id")
def _(t):
    rows = t.documents.select("doc_id").join(t.pages.select("page_id"), c("page_id") * 3 == c("doc_id"), "full")
    return rows.select(F.coalesce("doc_id", "page_id").alias("id"), c("doc_id").isNotNull().alias("left_side"), c("page_id").isNotNull().alias("right_side"))


@query("set_05_url_intersection", "SELECT page_id AS id FROM pages INTERSECT SELECT item_id FROM benchmark")
def _(t):
    return t.pages.select(c("page_id").alias("id")).intersect(t.benchmark.select("item_id"))


@query("set_06_09_complements", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def _(t):
    return t.documents.select("doc_id").subtract(t.labels.where("quality = 1").select("doc_id")).subtract(t.labels.where("toxic = 1").select("doc_id"))


@query("set_07_override", "SELECT doc_id, coalesce(l.quality, -1) AS v FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    rows = t.documents.select("doc_id", F.lit(-1).alias("v"), F.lit(0).alias("age")).unionByName(t.labels.join(t.documents.select("doc_id"), "doc_id", "left_semi").select("doc_id", c("quality").alias("v"), F.lit(1).alias("age")))
    return rows.groupBy("doc_id").agg(F.max_by("v", "age").alias("v"))


@query("set_08_snk_09_average_row", "SELECT 'average' AS lang, round(avg(n), 4) AS n FROM (SELECT lang, avg(n_chars) AS n FROM documents GROUP BY lang) UNION ALL SELECT lang, round(avg(n_chars), 4) FROM documents GROUP BY lang")
def _(t):
    detail = t.documents.groupBy("lang").agg(F.avg("n_chars").alias("n"))
    both = detail.agg(F.avg("n").alias("n")).withColumn("lang", F.lit("average")).unionByName(detail)
    return both.select("lang", F.round("n", 4).alias("n"))


# ---- aggregates -------------------------------------------------------------------------------------

SCORES = "(SELECT o_orderpriority AS candidate, o_orderstatus AS category, CASE WHEN o_totalprice > 50000 THEN 1.0 ELSE 0.0 END AS passed FROM orders)"


def _scores(t: Tables) -> DataFrame:
    return t.orders.select(c("o_orderpriority").alias("candidate"), c("o_orderstatus").alias("category"), F.when(c("o_totalprice") > 50000, 1.0).otherwise(0.0).alias("passed"))


@query("agg_07_08_pass_rates", f"SELECT candidate, category, round(avg(passed), 6) AS rate, count(*) AS tests FROM {SCORES} GROUP BY 1, 2")
def _(t):
    return _scores(t).groupBy("candidate", "category").agg(F.round(F.avg("passed"), 6).alias("rate"), one().alias("tests"))


@query("agg_09_macro_average", f"WITH b AS (SELECT candidate, category, avg(passed) AS r, count(*) AS n FROM {SCORES} GROUP BY 1, 2) SELECT candidate, category, round(r, 6) AS rate, n AS tests FROM b UNION ALL SELECT candidate, 'overall', round(avg(r), 6), CAST(sum(n) AS BIGINT) FROM b GROUP BY candidate")
def _(t):
    return C.macro_report(_scores(t), "candidate", "category", "passed").select("candidate", "category", F.round("rate", 6).alias("rate"), "tests")


@query("agg_rollup_report", f"SELECT candidate, category, count(*) AS tests, CAST(sum(passed) AS BIGINT) AS passed FROM {SCORES} GROUP BY ROLLUP (candidate, category)")
def _(t):
    return _scores(t).rollup("candidate", "category").agg(one().alias("tests"), F.sum("passed").cast("long").alias("passed"))


@query("agg_10_failing_everywhere", "SELECT l_partkey FROM lineitem GROUP BY 1 HAVING NOT bool_or(l_quantity > 48)")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.bool_or(c("l_quantity") > 48).alias("any")).where("NOT any").select("l_partkey")


@query("agg_11_12_baseline_rows", "SELECT o_orderkey AS id, 'baseline' AS kind FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 4) UNION ALL SELECT DISTINCT l_orderkey, 'test' FROM lineitem WHERE l_linenumber > 4")
def _(t):
    have = t.lineitem.where("l_linenumber > 4").select(c("l_orderkey").alias("id")).distinct()
    lacking = t.orders.select(c("o_orderkey").alias("id")).join(have, "id", "left_anti")
    return lacking.withColumn("kind", F.lit("baseline")).unionByName(have.withColumn("kind", F.lit("test")))


@query("agg_13_id_iou", "SELECT round(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (quality = 1 OR toxic = 0), 0), 6) AS iou FROM labels")
def _(t):
    return C.id_iou(t.labels, c("quality") == 1, c("toxic") == 0).select(F.round("iou", 6).alias("iou"))


@query("agg_15_17_attribute_inventory", "SELECT name, count(*) AS n FROM (SELECT 'quality' AS name, quality AS v FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY name HAVING count(*) > 5")
def _(t):
    m = F.create_map(F.lit("quality"), c("quality").cast("string"), F.lit("toxic"), c("toxic").cast("string"))
    rows = t.labels.select(F.explode(m).alias("name", "v")).where(c("v").try_cast("double").isNotNull())
    return rows.groupBy("name").agg(one().alias("n")).where("n > 5")


@query("agg_16_empirical_cdf", "SELECT event_id, round(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) / count(*) OVER (PARTITION BY event_type), 9) AS cdf FROM events")
def _(t):
    ranked = C.empirical_cdf(t.events.select("event_id", "event_type", "value"), "event_type", "value", "event_id")
    return ranked.select("event_id", F.round("cdf", 9).alias("cdf"))


@query("agg_16_value_summary", "SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(median(value), 6) AS middle FROM events WHERE isfinite(value) GROUP BY 1 HAVING count(*) >= 5")
def _(t):
    finite = t.events.where(c("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return finite.groupBy("event_type").agg(one().alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("middle")).where("n >= 5")


@query("agg_18_weighted_means", "SELECT event_type, round(sum(value) / count(*), 6) AS by_row, round(sum(value * user_id) / sum(user_id), 6) AS by_weight FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.sum("value") / one(), 6).alias("by_row"), F.round(F.sum(c("value") * c("user_id")) / F.sum("user_id"), 6).alias("by_weight"))


@query("agg_19_srt_03_host_counts", r"SELECT regexp_extract(url, '^\w+://([^/?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 1000")
def _(t):
    return t.pages.groupBy(X.url_host(c("url")).alias("host")).agg(one().alias("n")).orderBy(F.desc("n"), "host").limit(1000)


@query("agg_20_21_22_categories", "SELECT CASE WHEN toxic = 1 AND quality = 1 THEN 'both' WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'other' END AS bucket, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS share FROM labels GROUP BY 1")
def _(t):
    bucket = D.first_true({"both": (c("toxic") == 1) & (c("quality") == 1), "toxic": c("toxic") == 1, "good": c("quality") == 1}, "other")
    n = t.labels.groupBy(bucket.alias("bucket")).agg(one().alias("n"))
    return n.withColumn("share", F.round(100 * c("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("agg_23_24_25_state_counts", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, round(100 * count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS percent, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS open FROM orders")
def _(t):
    return t.orders.agg(one().alias("total"), F.count_if(c("o_orderstatus") == "F").alias("done"), F.round(100 * F.count_if(c("o_orderstatus") == "F") / one(), 4).alias("percent"), F.round(F.sum(F.when(c("o_orderstatus") == "O", c("o_totalprice"))), 2).alias("open"))


@query("agg_26_worker_states", "SELECT user_id % 10 AS worker, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy((c("user_id") % 10).alias("worker")).pivot("event_type", ["click", "error"]).count().na.fill(0)


@query("agg_27_rates", "SELECT event_type, round(sum(value) / (epoch(max(ts)) - epoch(min(ts))), 6) AS rate FROM events GROUP BY 1")
def _(t):
    seconds = F.unix_micros(F.max("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.min("ts").cast("timestamp")) / 1e6
    return t.events.groupBy("event_type").agg(F.round(F.sum("value") / seconds, 6).alias("rate"))


@query("agg_28_win_02_attempts", "SELECT l_linenumber AS attempt, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent, round(100 * sum(count(*)) OVER (ORDER BY l_linenumber) / sum(count(*)) OVER (), 6) AS upto FROM lineitem GROUP BY 1")
def _(t):
    n = t.lineitem.groupBy(c("l_linenumber").alias("attempt")).agg(one().alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return n.select("attempt", "n", F.round(100 * c("n") / total, 6).alias("percent"), F.round(100 * F.sum("n").over(Window.orderBy("attempt")) / total, 6).alias("upto"))


@query("agg_29_conditional_means", "SELECT o_orderpriority AS k, round(coalesce(avg(o_totalprice) FILTER (o_orderstatus = 'X'), avg(o_totalprice)), 4) AS none, round(coalesce(avg(o_totalprice) FILTER (o_orderstatus = 'F'), avg(o_totalprice)), 4) AS some FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(c("o_orderpriority").alias("k")).agg(F.round(C.conditional_mean(c("o_totalprice"), c("o_orderstatus") == "X"), 4).alias("none"), F.round(C.conditional_mean(c("o_totalprice"), c("o_orderstatus") == "F"), 4).alias("some"))


@query("agg_30_micro_scores", "SELECT round(sum(l_quantity) / sum(l_extendedprice), 9) AS p, coalesce(round(sum(l_quantity) / nullif(sum(l_tax * 0), 0), 9), -1) AS r FROM lineitem")
def _(t):
    return t.lineitem.agg(F.round(F.sum("l_quantity") / F.sum("l_extendedprice"), 9).alias("p"), F.coalesce(F.round(F.sum("l_quantity") / F.nullif(F.sum(c("l_tax") * 0), F.lit(0)), 9), F.lit(-1.0)).alias("r"))


@query("agg_31_32_33_rollup", "SELECT 'l_discount' AS element, round(avg(l_discount), 6) AS mean FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 6) FROM lineitem UNION ALL SELECT 'row', round(avg((l_discount + l_tax) / 2), 6) FROM lineitem")
def _(t):
    one_row = t.lineitem.agg(F.avg("l_discount").alias("l_discount"), F.avg("l_tax").alias("l_tax"), F.avg((c("l_discount") + c("l_tax")) / 2).alias("row"))
    return one_row.unpivot([], ["l_discount", "l_tax", "row"], "element", "mean").select("element", F.round("mean", 6).alias("mean"))


CDM = "WITH f AS (SELECT doc_id, ['x=' || doc_id, lang, source] AS a, ['x=' || n_chars, lang] AS b FROM documents), z AS (SELECT doc_id, list_zip(a, b) AS p FROM f) SELECT doc_id, round(list_sum(list_transform(p, lambda x: greatest(length(coalesce(x[2], '')) - levenshtein(coalesce(x[1], ''), coalesce(x[2], '')), 0))) / list_sum(list_transform(p, lambda x: length(coalesce(x[2], '')))), 6) AS cdm FROM z"


@query("agg_35_arr_05_formula_score", CDM)
def _(t):
    a, b = F.array(F.concat(F.lit("x="), c("doc_id").cast("string")), c("lang"), c("source")), F.array(F.concat(F.lit("x="), c("n_chars").cast("string")), c("lang"))
    rows = t.documents.select("doc_id", F.zip_with(a, b, lambda p, g: F.struct(F.coalesce(p, F.lit("")).alias("p"), F.coalesce(g, F.lit("")).alias("g"))).alias("z"))
    got = F.aggregate("z", F.lit(0), lambda acc, x: acc + F.greatest(F.length(x["g"]) - F.levenshtein(x["p"], x["g"]), F.lit(0)))
    return rows.select("doc_id", F.round(got / F.aggregate("z", F.lit(0), lambda acc, x: acc + F.length(x["g"])), 6).alias("cdm"))


@query("agg_36_smp_08_bootstrap")
def _(t):
    return C.bootstrap_interval(_scores(t).where("candidate = '1-URGENT'"), "category", "passed", 1000)


@query("agg_37_permutation")
def _(t):
    scores = _scores(t)
    names = [r["candidate"] for r in scores.select("candidate").where("candidate IS NOT NULL").distinct().orderBy("candidate").limit(2).collect()]
    return C.stratified_permutation(scores, names[0], names[1], "candidate", "category", "passed", 2000)


def votes(t: Tables) -> DataFrame:
    """Votes between event types: each event against the type that its user stands for, won by values over 50."""
    b = F.when(c("user_id") % 3 == 0, "click").when(c("user_id") % 3 == 1, "view").otherwise("signup")
    rows = t.events.select(c("event_type").alias("a"), b.alias("b"), F.when(c("value") > 50, c("event_type")).otherwise(b).alias("w")).where("a != b")
    keyed = rows.select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"), "w")
    return keyed.groupBy("first", "second").agg(F.count_if(c("w") == c("first")).alias("wins"), F.count_if(c("w") == c("second")).alias("losses"))


def _pairs(t: Tables) -> list[tuple[str, str, int, int]]:
    """The votes on the driver: a row a pair of types."""
    return [tuple(r) for r in votes(t).orderBy("first", "second").collect()]


@query("agg_39_sequential_elo")
def _(t):
    return t.spark.createDataFrame(sorted(C.elo_arena(_pairs(t)).items()), "method string, rating double")


@query("agg_40_srt_08_bootstrapped_elo")
def _(t):
    return C.bootstrap_elo(_pairs(t), t.spark, 100).orderBy(F.desc("mean"))


MED = "WITH a AS (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS x FROM conversations), d AS (SELECT p.conv_id, p.turn, round(avg(levenshtein(p.x, q.x) / greatest(length(p.x), length(q.x), 1)), 9) AS m FROM a p JOIN a q ON p.conv_id = q.conv_id AND p.turn <> q.turn GROUP BY 1, 2) SELECT conv_id, arg_min(turn, (m, turn)) AS turn, round(min(m), 6) AS mean_distance FROM d GROUP BY 1"


@query("agg_41_medoid", MED)
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.regexp_replace("text", "[^A-Za-z ]", "").alias("x"))
    return C.medoid(rows, "conv_id", "turn", "x").select("conv_id", "turn", F.round("mean_distance", 6).alias("mean_distance"))


@query("agg_42_group_repeats", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    name = F.concat("source", F.lit("_repeat"), (c("doc_id") % 4).cast("string"), F.lit(".md"))
    return t.documents.groupBy(F.regexp_replace(name, r"_repeat\d+\.md$", "").alias("source")).agg(one().alias("n"))


@query("agg_43_medoid_reward", MED.replace(" SELECT conv_id, arg_min(turn, (m, turn)) AS turn, round(min(m), 6) AS mean_distance FROM d GROUP BY 1", " SELECT conv_id, turn, round(1 - m / greatest(max(m) OVER (PARTITION BY conv_id), 1e-9), 6) AS reward FROM d"))
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.regexp_replace("text", "[^A-Za-z ]", "").alias("x"))
    d = C.pair_means(rows, "conv_id", "turn", "x").withColumnRenamed("mean", "m")
    return d.select("conv_id", "turn", F.round(1 - c("m") / F.greatest(F.max("m").over(Window.partitionBy("conv_id")), F.lit(1e-9)), 6).alias("reward"))


@query("agg_44_front_matter_reward", "SELECT doc_id, round(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 0.5 + 0.1 * (doc_id % 2 = 0)::INT + 0.1 * (doc_id % 3 = 0)::INT END, 6) AS reward FROM documents")
def _(t):
    d = c("doc_id")
    got = {"lang": F.when(d % 2 == 0, "a"), "table": d % 3 == 0}
    want = {"lang": F.lit("a"), "table": F.lit(True)}
    return t.documents.select("doc_id", F.round(C.front_matter_reward(got, want, d % 5 != 0), 6).alias("reward"))


@query("agg_45_element_reward", r"SELECT doc_id, (CASE WHEN len(regexp_extract_all(text, '\|')) = doc_id % 3 THEN 0.5 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '!!')) = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS reward FROM documents")
def _(t):
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    return t.documents.select("doc_id", (F.when(n(r"\|") == c("doc_id") % 3, 0.5).otherwise(0.0) + F.when(n("!!") == 0, 0.5).otherwise(0.0)).alias("reward"))


@query("agg_46_47_pass_reward", "SELECT o_orderkey, avg((l_quantity > 25)::INT) AS reward FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    rates = t.lineitem.groupBy("l_orderkey").agg(F.avg((c("l_quantity") > 25).cast("int")).alias("reward"))
    return t.orders.join(rates, c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", "reward")


NGRAM = r"WITH g AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM benchmark), gn AS (SELECT doc_id, array_to_string(w[i:i+7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM g WHERE len(w) >= 8)), bn AS (SELECT DISTINCT array_to_string(w[i:i+7], ' ') AS k FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8))"


@query("agg_48_ngram_overlap", NGRAM + " SELECT gn.doc_id, count(*) AS grams, count(bn.k) AS matched FROM gn LEFT JOIN bn ON bn.k = gn.k GROUP BY 1")
def _(t):
    # Runs are tested where their document lies; only those found leave its row.
    hits = shared_runs(t.documents, "doc_id", t.benchmark).groupBy("doc_id").agg(one().alias("matched"))
    rows = t.documents.select("doc_id", (F.size(X.words(c("text"))) - 7).cast("long").alias("grams")).where("grams > 0")
    return rows.join(hits, "doc_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0).cast("long")))


@query("agg_49_srt_04_votes_per_base", "SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r <= 2")
def _(t):
    n = t.documents.groupBy("source", "lang").agg(one().alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "lang"))).where("r <= 2").drop("r")


@query("agg_50_distinct_signature", "SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def _(t):
    w = Window.partitionBy("lang", "source").orderBy("doc_id")
    return t.documents.withColumn("r", F.row_number().over(w)).where("r = 1").select("lang", "source", "doc_id")


@query("agg_51_duplicate_ids", "SELECT k, doc_id FROM (SELECT doc_id % 100 AS k, doc_id, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY (quality IS NOT NULL) DESC, doc_id DESC) AS r FROM documents LEFT JOIN labels USING (doc_id)) WHERE r = 1")
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left").withColumn("k", c("doc_id") % 100)
    w = Window.partitionBy("k").orderBy(F.desc(c("quality").isNotNull()), F.desc("doc_id"))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("k", "doc_id")


@query("agg_52_distinct_counts", "SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT text) AS texts FROM documents")
def _(t):
    return t.documents.agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.count_distinct("text").alias("texts"))


# ---- windows, sorts, sampling -----------------------------------------------------------------------


@query("win_03_chunks", "SELECT o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) / 50) AS BIGINT) AS chunk FROM orders")
def _(t):
    return K.chunks(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", 50, "o_orderstatus").select("o_orderkey", "chunk")


BINS = "WITH RECURSIVE s AS (SELECT source, doc_id, n_chars + 1024 AS need, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), b AS (SELECT source, doc_id, i, need AS held, 0 AS bin FROM s WHERE i = 1 UNION ALL SELECT s.source, s.doc_id, s.i, CASE WHEN b.held + s.need > 300000 THEN s.need ELSE b.held + s.need END, b.bin + CASE WHEN b.held + s.need > 300000 THEN 1 ELSE 0 END FROM b JOIN s ON s.source = b.source AND s.i = b.i + 1) SELECT doc_id, CAST(bin AS BIGINT) AS bin FROM b"


@query("win_04_snk_06_07_bins", BINS)
def _(t):
    return K.bin_rows(t.documents.select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 300000).select("doc_id", "bin")


@query("win_05_neighbours", "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query("win_06_07_grid_neighbours", "SELECT l_orderkey, l_linenumber, lag(l_quantity) OVER w AS up, lead(l_quantity) OVER w AS down, last_value(CASE WHEN l_returnflag = 'R' THEN l_linestatus END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice)")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    heading = F.last(F.when(c("l_returnflag") == "R", c("l_linestatus")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.lag("l_quantity").over(w).alias("up"), F.lead("l_quantity").over(w).alias("down"), heading.alias("heading"))


@query("win_08_gap_runs", "SELECT doc_id, CASE WHEN doc_id % 5 >= 2 THEN '1-' || (1 + doc_id % 5) ELSE '' END AS runs FROM documents")
def _(t):
    tokens = F.concat(F.array(F.lit("a")), F.array_repeat(F.lit("-"), (c("doc_id") % 5).cast("int")), F.array(F.lit("b"), F.lit("-")))
    runs = F.transform(K.gap_runs(tokens, "-", 2), lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    return t.documents.select("doc_id", F.array_join(runs, ",").alias("runs"))


@query("win_08_short_word_runs", r"WITH w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n\t]+'), lambda x: x <> '') AS ws FROM documents)), g AS (SELECT doc_id, i - 1 AS i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM w WHERE length(ws[i]) <= 3), k AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS b FROM g GROUP BY doc_id, i - r HAVING count(*) >= 4) SELECT doc_id, count(*) AS runs, string_agg(a || '-' || b, ',' ORDER BY a) AS places FROM k GROUP BY 1")
def _(t):
    # Runs of four and more short words in whole texts.
    words = F.filter(F.split("text", "[ \\n\\t]+"), lambda w: w != "")
    runs = K.gap_runs(F.transform(words, lambda w: F.when(F.length(w) <= 3, "-").otherwise(w)), "-", 4)
    # Exploded and gathered in its row, so that the runs of a text are found once.
    rows = t.documents.select("doc_id", F.explode(F.array(runs)).alias("r")).where(F.size("r") > 0)
    return rows.select("doc_id", F.size("r").cast("long").alias("runs"), F.array_join(F.transform("r", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("places"))


@query("win_09_merge_spans", "WITH s AS (SELECT l_suppkey AS g, l_partkey AS a, l_partkey + l_linenumber AS b FROM lineitem), m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY g ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM s), r AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT g, min(a) AS a, max(b) AS b FROM r GROUP BY g, k")
def _(t):
    spans = t.lineitem.select(c("l_suppkey").alias("g"), c("l_partkey").alias("a"), (c("l_partkey") + c("l_linenumber")).alias("b"))
    return K.merge_spans(spans, "g", "a", "b")


@query("win_10_window_around", "SELECT a.conv_id, a.turn, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY 1, 2")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-1, 1)
    return t.conversations.select("conv_id", "turn", one().over(w).alias("n"))


@query("win_11_latest_state", "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@query("win_12_line_index", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS line FROM documents")
def _(t):
    return numbered(t.documents.select("doc_id", "source"), ["source"], ["doc_id"]).select("doc_id", c("row").alias("line"))


@query("srt_01_02_bottom_k", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 10")
def _(t):
    return t.events.select("event_id", "value").orderBy("value", "event_id").limit(10)


@query("srt_05_06_arg_max", "SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.max_by("doc_id", F.struct(c("n_chars"), -c("doc_id"))).alias("doc_id"))


@query("srt_07_09_next_item", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def _(t):
    return t.orders.where("o_orderstatus != 'F'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("smp_01_06_sample_n", "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def _(t):
    return S.sample_n(t.documents.select("doc_id"), "doc_id", 100, "7")


@query("smp_02_one_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS r FROM documents) WHERE r = 1")
def _(t):
    return S.sample_per_group(t.documents.select("source", "doc_id"), "source", "doc_id", 1)


@query("smp_03_04_05_first_and_random", "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber <= 1) DESC, md5('0:' || l_linenumber), l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def _(t):
    return S.sample_per_group(t.lineitem.select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 3, c("l_linenumber") <= 1)


@query("smp_07_hierarchical", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('1:' || doc_id), doc_id) AS r FROM documents WHERE source IN (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('1:' || source), source LIMIT 5)) WHERE r = 1")
def _(t):
    files = S.sample_n(t.documents.select("source").distinct(), "source", 5, "1")
    return S.sample_per_group(t.documents.join(files, "source", "left_semi").select("source", "doc_id"), "source", "doc_id", 1, seed="1")


@query("smp_09_word_segments")
def _(t):
    return t.documents.select("doc_id", S.word_segment(c("text"), c("doc_id")).alias("segment"))


@query("smp_10_flip", "SELECT doc_id, CASE WHEN substr(md5('3:' || doc_id), 1, 1) < '8' THEN (doc_id % 4) * 90 ELSE 0 END AS rotation FROM documents")
def _(t):
    return t.documents.select("doc_id", F.when(F.substring(S.order_key(c("doc_id"), "3"), 1, 1) < "8", (c("doc_id") % 4) * 90).otherwise(0).cast("long").alias("rotation"))


@query("smp_11_items_per_group", "SELECT CAST(greatest(1, floor(500 / avg(n))) AS BIGINT) AS items FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def _(t):
    return t.lineitem.groupBy("l_orderkey").count().agg(F.greatest(F.lit(1), F.floor(500 / F.avg("count"))).cast("long").alias("items"))


@query("ext_15_cluster_sample", "SELECT doc_id FROM documents WHERE source IN (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('0:' || source), source LIMIT greatest(1, CAST(floor((SELECT count(DISTINCT source) FROM documents) * 0.1) AS INTEGER)))")
def _(t):
    return S.sample_groups(t.documents.select("source", "doc_id"), "source", 0.1).select("doc_id")


@query("ext_30_histogram", "SELECT CASE WHEN n_chars >= 20000 THEN 51 ELSE CAST(floor(n_chars / 400) AS BIGINT) + 1 END AS bin, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(F.width_bucket(c("n_chars"), F.lit(0), F.lit(20000), F.lit(50)).alias("bin")).agg(one().alias("n"))


# ---- arrays, geometry, JSON, dates, numbers ---------------------------------------------------------


@query("geo_01_box_iou", "SELECT l_orderkey, l_linenumber, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS iou FROM (SELECT *, l_quantity * 10 + 20 * 10 - i AS u FROM (SELECT *, greatest(0, least(l_quantity, 5 + 20) - greatest(0, 5)) * greatest(0, least(10, 2 + 10) - 2) AS i FROM lineitem))")
def _(t):
    a = F.array(F.lit(0.0), F.lit(0.0), c("l_quantity"), F.lit(10.0))
    b = F.array(*map(F.lit, [5.0, 2.0, 20.0, 10.0]))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(C.box_iou(a, b), 6).alias("iou"))


@query("geo_03_04_overlap", "SELECT l_orderkey, l_linenumber, NOT (l_quantity < 20 - 0.5 OR 0 > 30.5) AS hit, round(2 * l_quantity + 1, 6) AS x FROM lineitem")
def _(t):
    a = F.array(F.lit(0.0), F.lit(0.0), c("l_quantity"), F.lit(10.0))
    b = F.array(*map(F.lit, [20.0, 0.0, 30.0, 10.0]))
    return t.lineitem.select("l_orderkey", "l_linenumber", C.boxes_overlap(a, b, 0.5).alias("hit"), F.round(C.affine(c("l_quantity"), F.lit(0.0), [2, 0, 0, 1, 1, 0])["x"], 6).alias("x"))


@query("geo_06_png_size", "SELECT doc_id, CAST(doc_id % 5000 AS INTEGER) AS width, CAST(n_chars AS INTEGER) AS height FROM documents")
def _(t):
    number = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    raw = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(c("doc_id") % 5000), number(c("n_chars")))
    return t.documents.select("doc_id", C.png_size(F.base64(F.unhex(raw))).alias("s")).select("doc_id", "s.*")


@query("arr_02_06_07_counts", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS kinds, round(CASE WHEN len(w) = 0 THEN 0 ELSE 2 * (len(list_distinct(w)) / len(w)) / (len(list_distinct(w)) / len(w) + 1) END, 6) AS f1 FROM w")
def _(t):
    rows = t.documents.select("doc_id", X.words(c("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("kinds"))
    p = C.ratio(c("kinds"), c("words"))
    return rows.withColumn("f1", F.round(C.f1(p, F.lit(1.0)), 6))


@query("map_02_nested_counters", "SELECT user_id % 5 AS worker, event_type AS state, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy((c("user_id") % 5).alias("worker"), c("event_type").alias("state")).agg(one().alias("n"))


@query("jsn_02_encode", "SELECT doc_id, '{\"lang\":\"' || lang || '\",\"none\":null,\"é\":' || doc_id || '}' AS json FROM documents")
def _(t):
    s = F.struct("lang", F.lit(None).cast("string").alias("none"), c("doc_id").alias("é"))
    return t.documents.select("doc_id", F.to_json(s, {"ignoreNullFields": "false"}).alias("json"))


@query("jsn_03_04_batch_response", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS content, CASE WHEN doc_id % 3 = 0 THEN 'default' ELSE lang END AS with_default FROM documents")
def _(t):
    status = F.when(c("doc_id") % 3 == 0, 500).otherwise(200)
    raw = F.to_json(F.struct(F.struct(status.alias("status_code"), F.struct(F.array(F.struct(F.struct(F.to_json(F.struct("lang")).alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response")))
    rows = t.documents.select("doc_id", raw.alias("raw"))
    good = F.get_json_object("raw", "$.response.status_code") == "200"
    content = F.when(good, F.from_json(F.get_json_object("raw", "$.response.body.choices[0].message.content"), "lang string")["lang"])
    return rows.select("doc_id", content.alias("content"), F.coalesce(content, F.lit("default")).alias("with_default"))


@query("jsn_props_variant", "SELECT event_id, json_extract_string(props, '$.' || k) AS v FROM (SELECT *, json_keys(props)[1] AS k FROM events WHERE props IS NOT NULL AND json_valid(props))")
def _(t):
    rows = t.events.where(c("props").isNotNull()).withColumn("m", F.from_json("props", "map<string,string>")).where(c("m").isNotNull())
    return rows.select("event_id", F.get(F.map_values("m"), F.lit(0)).alias("v"))


@query("dat_01_03_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format(F.to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "yyyy-MM-dd'T'HH:mm:ss"), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("dat_02_stm_05_lease_state", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'view' THEN 'free' WHEN epoch(TIMESTAMP '2024-01-20') - epoch(ts) <= 864000 THEN 'leased' ELSE 'stale' END AS state FROM events")
def _(t):
    age = F.unix_seconds(F.lit("2024-01-20").cast("timestamp")) - F.unix_micros(c("ts").cast("timestamp")) / 1e6
    state = F.when(c("event_type") == "purchase", "done").when(c("event_type") == "view", "free").when(age <= 864000, "leased").otherwise("stale")
    return t.events.select("event_id", state.alias("state"))


@query("dat_04_parse", "SELECT doc_id, strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') AS day, CAST(doc_id % 100 AS DOUBLE) AS mean FROM documents")
def _(t):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (c("doc_id") % 300).cast("int")), "MMM d, yyyy")
    score = F.concat((c("doc_id") % 100).cast("string"), F.lit(" ± 1.1"))
    return t.documents.select("doc_id", F.date_format(F.to_date(day, "MMM d, yyyy"), "yyyy-MM-dd").alias("day"), F.get(F.split(score, r"\s*±"), F.lit(0)).cast("double").alias("mean"))


@query("mth_01_elo_expected", "SELECT o_orderkey, round(1 / (1 + pow(10, (1500 - o_totalprice / 100) / 400)), 9) AS expected FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.round(C.elo_expected(c("o_totalprice") / 100, F.lit(1500.0)), 9).alias("expected"))


@query("mth_02_03_04_scalars", "SELECT o_orderkey, greatest(0, 1 - o_totalprice / 100000) AS similarity, CAST(pow(2, o_orderkey % 6) AS BIGINT) AS backoff, (360 - (o_orderkey % 4) * 90) % 360 AS turn FROM orders")
def _(t):
    k = c("o_orderkey")
    return t.orders.select("o_orderkey", X.similarity_from_distance(c("o_totalprice") / 100000).alias("similarity"), F.pow(F.lit(2), k % 6).cast("long").alias("backoff"), F.pmod(360 - (k % 4) * 90, F.lit(360)).alias("turn"))
