"""Queries for text functions, filters and rules.

The corpus has no Markdown of its own, so several queries first make it: a fixed
pattern of marks around real words, on both engines alike.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import text as X
from docflow.operators import coherency as H
from docflow.operators import filters as P
from docflow.operators import language as L
from docflow.operators import rules as R
from docflow.plans.registry import Tables, query

# A Markdown page as (Spark expression, SQL expression) over doc_id and the letters of a whole text.
HEAD = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"
MD_SQL = (
    "('# Title ' || doc_id || chr(10) || chr(10) || '> ' || {h} || chr(10) || '## Part **two**' || chr(10) || '- item ' || lang || chr(10) || '* ' || source || chr(10) || '1. one' || chr(10) || "
    "'| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | ' || doc_id || ' |' || chr(10) || 'An $x_' || doc_id || '$ and $$y=' || n_chars || '$$ and \\(z\\) ![alt ' || lang || '](img_' || doc_id || '.png) [link](http://e.x/' || doc_id || ') `code` ===== ' || chr(10) || chr(10) || chr(10) || chr(10) || "
    "'<table><tr><td>' || lang || '</td><td>' || doc_id || '</td></tr></table>' || chr(10) || '<!-- bbox: ' || doc_id || ', 2, 30.5, 4 -->  end')"
).replace("{h}", HEAD)
PAGES_SQL = f"WITH p AS (SELECT doc_id, lang, source, n_chars, {MD_SQL} AS md FROM documents)"


def markdown_pages(t: Tables) -> DataFrame:
    h = F.regexp_replace("text", "[^A-Za-z ]", "")
    parts = [
        "# Title ", F.col("doc_id"), "\n\n> ", h, "\n## Part **two**\n- item ", F.col("lang"), "\n* ", F.col("source"), "\n1. one\n| a | b |\n|---|---|\n| 1 | ", F.col("doc_id"),
        " |\nAn $x_", F.col("doc_id"), "$ and $$y=", F.col("n_chars"), "$$ and \\(z\\) ![alt ", F.col("lang"), "](img_", F.col("doc_id"), ".png) [link](http://e.x/", F.col("doc_id"),
        ") `code` ===== \n\n\n\n<table><tr><td>", F.col("lang"), "</td><td>", F.col("doc_id"), "</td></tr></table>\n<!-- bbox: ", F.col("doc_id"), ", 2, 30.5, 4 -->  end",
    ]
    md = F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return t.documents.select("doc_id", "lang", "source", "n_chars", md.alias("md"))


def page_query(name: str, spark_fn, sql: str) -> None:
    """A query of one text function over the made pages."""

    @query(name, f"{PAGES_SQL} SELECT doc_id, {sql} AS out FROM p")
    def run(t: Tables) -> DataFrame:
        return markdown_pages(t).select("doc_id", spark_fn(F.col("md")).alias("out"))


WS = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
page_query(
    "str_01_normalize_text",
    X.normalize_ascii,
    "translate(" + "regexp_replace(" * 8 + r"md, '<br/?>', ' ', 'g'), '\s+', ' ', 'g'), '\*\*(.*?)\*\*', '\1', 'g'), '__(.*?)__', '\1', 'g'), '</?b>', '', 'g'), '</?i>', '', 'g'), '\*(.*?)\*', '\1', 'g'), '_(.*?)_', '\1', 'g'), '‘’‚“”„＿–—‑‒−µ', '''''''" + '"""' + "_-----μ')",
)
page_query("str_02_fold_tex", X.fold_tex, "translate(regexp_replace(md, '\\s+', ' ', 'g'), '‘’‚“”„＿–—‑‒−µ', '''''''\"\"\"_-----μ')")
page_query("str_10_collapse_symbols", X.collapse_repeated_symbols, r"regexp_replace(regexp_replace(md, '={3,}', '===', 'g'), '-{3,}', '---', 'g')")
page_query("str_11_remove_markdown_tables", X.remove_markdown_tables, r"regexp_replace(md, '\| a \| b \|\n\|---\|---\|\n\| 1 \| \d+ \|\n', '', 'g')")
page_query("str_12_strip_inline_math", X.strip_inline_math, r"regexp_replace(regexp_replace(md, '\$(x_\d+)\$', '\1', 'g'), '\\\((.+?)\\\)', '\1', 'g')")
page_query("str_13_strip_markdown", X.strip_markdown_syntax, r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '(?m)^[ \t]*>+[ \t]*', '', 'g'), '(?m)^[ \t]*#{1,6}[ \t]+', '', 'g'), '(?m)^[ \t]*[-*+][ \t]+', '', 'g'), '(?m)^[ \t]*\d+\.[ \t]+', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '`([^`]+)`', '\1', 'g')")
page_query("str_14_normalize_whitespace", X.normalize_whitespace, r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')")
page_query("str_16_split_paragraphs", lambda c: F.array_join(X.split_paragraphs(c), "|"), r"array_to_string(list_filter(list_transform(regexp_split_to_array(md, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|')")
page_query("str_17_remove_parts", lambda c: X.remove_error_strings(X.remove_heading_marks(X.remove_tables(X.remove_images(c), "1.9"))), r"regexp_replace(regexp_replace(regexp_replace(md, '!\[.*?\]\(.*?\)', '', 'g'), '(?s)<table.*?</table>', '', 'g'), '(?m)^(#{1,6})\s*', '', 'g')")
page_query("str_18_clean_text", X.clean_text, r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '[ \t]+\n', chr(10), 'g'), '\n+', chr(10), 'g'), ' +', ' ', 'g'), '^\s+|\s+$', '', 'g')")
page_query("str_19_extract_headings", lambda c: F.array_join(F.transform(X.extract_headings(c), lambda h: F.concat(h["text"], F.lit("@"), h["level"].cast("string"))), "|"), "'Title ' || doc_id || '@1|Part **two**@2'")
page_query("str_20_extract_lists", lambda c: F.array_join(X.extract_lists(c), "|"), "'item ' || lang || '|' || source")
page_query("str_21_extract_tables", lambda c: F.concat(X.detect_table_type(c), F.lit(":"), F.array_join(X.extract_tables(c), "|")), "'html:<table><tr><td>' || lang || '</td><td>' || doc_id || '</td></tr></table>'")
page_query("str_22_extract_images", lambda c: F.concat(F.to_json(X.extract_images(c)), F.to_json(X.extract_image_boxes(c))), "'[{\"alt\":\"alt ' || lang || '\",\"url\":\"img_' || doc_id || '.png\",\"raw\":\"![alt ' || lang || '](img_' || doc_id || '.png)\"}][[' || doc_id || '.0,2.0,30.5,4.0]]'")
page_query("str_23_extract_formulas", lambda c: F.array_join(X.extract_formulas(c), "|"), "'y=' || n_chars || '|x_' || doc_id")
page_query("str_24_parse_markdown", lambda c: F.concat_ws("#", F.size(X.parse_markdown(c)["tables"]).cast("string"), X.parse_markdown(c)["table_type"], F.length(X.parse_markdown(c)["text"]).cast("string")), r"'1#html#' || length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '!\[.*?\]\(.*?\)', '', 'g'), '(?is)<table.*?</table>', '', 'g'), '\n{2,}', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'))")
page_query("str_25_harvest_equations", lambda c: F.array_join(X.harvest_equations(c), "|"), "'z|y=' || n_chars || '|x_' || doc_id")
page_query("str_26_harvest_tex_math", lambda c: F.array_join(X.harvest_tex_math(c), "|"), "'y=' || n_chars || '|x_' || doc_id || '|z'")
page_query("str_27_latex_brackets", X.normalize_latex_brackets, r"regexp_replace(regexp_replace(md, '(?s)\$\$(.+?)\$\$', '\\[\1\\]', 'g'), '(?s)\$([^$]+?)\$', '\\(\1\\)', 'g')")
page_query("str_29_bbox_tokens", X.bbox_tokens, "replace(replace(md, '<!-- bbox:', '<|bbox_start|>'), '-->', '<|bbox_end|>')")
page_query("str_33_cap_split", lambda c: X.cap_split(c, 100), r"regexp_replace(left(md, 47), '\s+\S*$', '') || ' ... ' || regexp_replace(right(md, 47), '^\S*\s+', '')")
page_query("str_34_clean_element", X.clean_element, r"replace(replace(replace(replace(regexp_replace(md, '^\s+|\s+$', '', 'g'), '[', '\['), ']', '\]'), chr(10), '\n'), chr(13), '\r')")
page_query("prj_19_html_escape", X.html_escape, "replace(replace(replace(replace(replace(md, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')")
page_query("flt_06_markdown_table", P.has_markdown_table, "true")
page_query("flt_07_math_symbols", P.has_math_symbols, "false")
page_query("flt_08_latex_table", lambda c: P.has_latex_table(F.when(F.col("doc_id") % 3 == 0, F.concat(c, F.lit("\\begin{tabular}"))).otherwise(c)), "doc_id % 3 = 0")
page_query("flt_09_latex_commands", lambda c: P.has_latex_outside_math(F.when(F.col("doc_id") % 3 == 0, F.concat(c, F.lit("\\frac"))).otherwise(F.concat(c, F.lit("$$\\frac$$")))), "doc_id % 3 = 0")
page_query("flt_11_break_in_cell", lambda c: P.has_break_in_cell(F.when(F.col("doc_id") % 3 == 0, F.concat(c, F.lit("<td>a<br>b</td>"))).otherwise(F.concat(c, F.lit("<td>a</td><br>")))), "doc_id % 3 = 0")
page_query("flt_13_text_rules", lambda c: P.text_reject_reason(F.when(F.col("doc_id") % 2 == 0, c).otherwise(F.col("lang")), F.col("doc_id") % 3 != 0, F.col("doc_id") % 5 != 0), "CASE WHEN doc_id % 2 = 0 THEN 'markdown_table' WHEN doc_id % 3 = 0 THEN 'html_table' WHEN doc_id % 5 = 0 THEN 'math_render' END")


@query("str_15_prepare_text")
def _(t: Tables) -> DataFrame:
    return markdown_pages(t).select("doc_id", X.prepare_for_text_edit(F.col("md"), "1.9").alias("out"))


ASCII = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"


@query(
    "str_03_04_edit_distance",
    "WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS x FROM conversations), p AS (SELECT a.conv_id, a.turn, a.x AS a, coalesce(b.x, reverse(a.x)) AS b FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(levenshtein(a, b) / greatest(length(b), 1), 4) AS to_truth, round(levenshtein(a, b) / greatest(length(a), length(b), 1), 4) AS to_longer FROM p",
)
def _(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.regexp_replace("text", "[^A-Za-z ]", "").alias("a"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    rows = rows.join(after, ["conv_id", "turn"], "left").withColumn("b", F.coalesce("b", F.reverse("a")))
    a, b = F.col("a"), F.col("b")
    return rows.select("conv_id", "turn", F.round(X.edit_distance_to_truth(a, b), 4).alias("to_truth"), F.round(X.normalized_levenshtein(a, b), 4).alias("to_longer"))


FRONT_SQL = "'---' || chr(10) || 'primary_language: ' || lang || chr(10) || 'is_rotation_valid: True' || chr(10) || 'rotation_correction: ' || (doc_id % 4) * 90 || chr(10) || 'is_table: False' || chr(10) || 'is_diagram: ' || CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END || chr(10) || '---' || chr(10) || source"


def _front(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select("doc_id", "lang", "source", X.render_front_matter(F.col("lang"), F.lit(True), (d % 4) * 90, F.lit(False), d % 2 == 0, F.col("source")).alias("page"))


@query("str_31_render_front_matter", f"SELECT doc_id, {FRONT_SQL} AS page FROM documents")
def _(t: Tables) -> DataFrame:
    return _front(t).select("doc_id", "page")


@query("str_30_parse_front_matter", "SELECT doc_id, lang AS language, CAST((doc_id % 4) * 90 AS INTEGER) AS rotation, source AS body FROM documents")
def _(t: Tables) -> DataFrame:
    parsed = X.parse_front_matter(F.col("page"))
    return _front(t).select("doc_id", parsed["front"]["primary_language"].alias("language"), parsed["front"]["rotation_correction"].cast("int").alias("rotation"), parsed["body"].alias("body"))


@query("str_32_update_rotation", f"WITH p AS (SELECT doc_id, {FRONT_SQL} AS page FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(page, 'rotation_correction: \\d+', 'rotation_correction: 0') ELSE regexp_replace(regexp_replace(page, 'is_rotation_valid: True', 'is_rotation_valid: False'), 'rotation_correction: \\d+', 'rotation_correction: ' || 360 - (doc_id % 3) * 90) END AS page FROM p")
def _(t: Tables) -> DataFrame:
    return _front(t).select("doc_id", X.update_rotation(F.col("page"), (F.col("doc_id") % 3) * 90).alias("page"))


@query("str_36_raw_text", "SELECT doc_id, source || chr(10) || lang AS raw FROM documents")
def _(t: Tables) -> DataFrame:
    prompt = F.concat(F.lit("Look.\nRAW_TEXT_START\n"), "source", F.lit("\n"), "lang", F.lit("\nRAW_TEXT_END\nDone."))
    return t.documents.select("doc_id", X.raw_text_section(prompt).alias("raw"))


@query("str_37_last_code_block", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || chr(10) WHEN 1 THEN lang || chr(10) WHEN 2 THEN source ELSE 'plain ' || lang END AS code FROM documents")
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id") % 4
    reply = (
        F.when(d == 0, F.concat(F.lit("a\n```html\nx\n```\n```html\n"), "source", F.lit("\n```")))
        .when(d == 1, F.concat(F.lit("```py\n"), "lang", F.lit("\n```")))
        .when(d == 2, F.concat(F.lit("open ```html\n"), "source"))
        .otherwise(F.concat(F.lit("plain "), "lang"))
    )
    return t.documents.select("doc_id", X.last_code_block(reply).alias("code"))


@query("str_43_sentences", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS n FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"))


@query("str_45_pdf_hash", "SELECT doc_id, sha1(CAST(doc_id AS VARCHAR)) AS full_hash, left(md5(CAST(doc_id AS VARCHAR)), 12) AS short_hash FROM documents")
def _(t: Tables) -> DataFrame:
    key = F.col("doc_id").cast("string")
    full, short = F.sha1(key), F.left(F.md5(key), F.lit(12))
    url = F.concat(F.lit("s3://bucket/"), F.left(full, F.lit(4)), F.lit("/"), F.substring(full, 5, 100), F.lit(".pdf"))
    stored = F.regexp_extract(url, r"/([0-9a-f]{4})/([0-9a-f]+)\.pdf$", 1)
    rest = F.regexp_extract(url, r"/([0-9a-f]{4})/([0-9a-f]+)\.pdf$", 2)
    local = F.concat(F.lit("./"), short, F.lit("_pg1.pdf"))
    return t.documents.select("doc_id", F.concat(stored, rest).alias("full_hash"), X.pdf_hash(local).alias("short_hash"))


@query("str_46_url_host", r"SELECT page_id, nullif(regexp_extract(url, '^\w+://([^/?#]*)', 1), '') AS host FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.url_host(F.col("url")).alias("host"))


@query("str_47_candidate_name", "SELECT doc_id, source AS pdf, CAST(doc_id % 7 AS INTEGER) AS page, CAST(doc_id % 3 AS INTEGER) AS repeat FROM documents")
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    name = F.concat("source", F.lit("_pg"), (d % 7).cast("string"), F.lit("_repeat"), (d % 3).cast("string"), F.lit(".md"))
    return t.documents.select("doc_id", X.candidate_name(name).alias("x")).select("doc_id", "x.*")


@query("str_48_group_hash", "SELECT lang, sha1(string_agg(k, '' ORDER BY k)) AS hash FROM (SELECT lang, source || '/' || doc_id AS k FROM documents) GROUP BY lang")
def _(t: Tables) -> DataFrame:
    key = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return t.documents.groupBy("lang").agg(X.group_hash(F.collect_list(key)).alias("hash"))


@query("str_50_prompt_length", "SELECT doc_id, length(text) AS n, length(text) > 6000 AS long FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length("text").cast("long").alias("n"), (F.length("text") > 6000).alias("long"))


@query("prj_21_safe_filename", "SELECT doc_id, CASE WHEN length(n) > 200 THEN left(n, 150) || '_' || left(md5(k), 8) ELSE n END AS name FROM (SELECT doc_id, k, translate(k, '/\\:', '___') AS n FROM (SELECT doc_id, 'a/b\\c:' || repeat(source, CAST(doc_id % 90 AS INTEGER)) AS k FROM documents))")
def _(t: Tables) -> DataFrame:
    key = F.concat(F.lit("a/b\\c:"), F.repeat(F.col("source"), (F.col("doc_id") % 90).cast("int")))
    return t.documents.select("doc_id", X.safe_filename(key).alias("name"))


@query("src_07_split_key", "SELECT doc_id, source || '-x.pdf' AS path, CAST(doc_id % 50 AS INTEGER) AS page FROM documents")
def _(t: Tables) -> DataFrame:
    key = F.concat("source", F.lit("-x.pdf-"), (F.col("doc_id") % 50).cast("string"))
    return t.documents.select("doc_id", X.split_key(key).alias("x")).select("doc_id", "x.*")


WORDS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
SPAM_SQL = "['" + "', '".join(P.SPAM_WORDS) + "']"


@query("flt_01_download_spam", f"WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents) SELECT doc_id, len(ws) > 0 AND len(list_filter(ws, lambda x: list_contains({SPAM_SQL}, x))) > 0.004 * len(ws) AS spam FROM w")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", P.is_download_spam(F.col("text")).alias("spam"))


ALPHA_SQL = r"length(regexp_replace(text, '[^\p{L}]+', '', 'g')) / greatest(length(text), 1)"


@query("flt_02_document_filter", f"WITH w AS (SELECT *, {WORDS_SQL} AS ws, {ALPHA_SQL} AS alpha FROM documents) SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'form' WHEN length(text) < 200 THEN NULL WHEN alpha < 0.5 THEN NULL WHEN NOT (lang IS NULL OR lang IN ('en', 'de')) THEN 'language' WHEN len(ws) > 0 AND len(list_filter(ws, lambda x: list_contains({SPAM_SQL}, x))) > 0.004 * len(ws) THEN 'spam' END AS reason FROM w")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", P.drop_reason(F.col("text"), F.col("lang"), F.col("doc_id") % 17 == 0, ["en", "de"]).alias("reason"))


@query("flt_04_language_keep", "SELECT doc_id FROM documents WHERE lang IS NULL OR lang IN ('en', 'fr')")
def _(t: Tables) -> DataFrame:
    return t.documents.where(P.keeps_language(F.col("lang"), ["en", "fr"])).select("doc_id")


GRAMS_SQL = r"SELECT doc_id, lang, unnest(flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 1), lambda i: substr('_' || w || '_', i, 3))))) AS gram FROM documents"
DETECT_SQL = f"""WITH g AS ({GRAMS_SQL}), c AS (SELECT lang, gram, count(*) AS n FROM g WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY ALL),
tot AS (SELECT lang, sum(n) AS total FROM c GROUP BY 1), f AS (SELECT DISTINCT gram FROM c JOIN tot USING (lang) WHERE n * {L.PROFILE} >= total),
m AS (SELECT gram, l.lang, coalesce(c.n, 0) AS n FROM f CROSS JOIN (SELECT lang FROM tot) l LEFT JOIN c USING (gram, lang)),
s AS (SELECT lang, sum(n) AS t, count(*) AS v FROM m GROUP BY 1), pr AS (SELECT gram, m.lang, ln((n + 1) / (t + v)) AS p FROM m JOIN s USING (lang)),
d AS (SELECT doc_id, pr.lang, count(*) AS grams, round(sum(p) / count(*), 9) AS score FROM g JOIN pr USING (gram) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS k, score - lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS lead FROM d),
o AS (SELECT x.doc_id, x.text, coalesce(grams, 0) AS grams, CASE WHEN grams >= {L.LEAST_GRAMS} AND coalesce(lead, 0) >= {L.LEAST_LEAD} THEN r.lang ELSE 'unknown' END AS language, round(lead, 6) AS lead FROM documents x LEFT JOIN r ON r.doc_id = x.doc_id AND k = 1)"""


def detected(t: Tables, **more: Column) -> DataFrame:
    """The language of every document, by profiles of four fifths of the documents, and more columns."""
    return L.detect(t.documents.withColumns(more), "doc_id", *L.profiles(t.documents.where("doc_id % 5 != 0")), keep=tuple(more))


@query("flt_04_language_detection", f"{DETECT_SQL} SELECT doc_id, grams, language, lead FROM o")
def _(t: Tables) -> DataFrame:
    return detected(t)


@query("flt_02_04_detected_filter", f"{DETECT_SQL} SELECT doc_id, CASE WHEN length(text) < 200 THEN NULL WHEN {ALPHA_SQL} < 0.5 THEN NULL WHEN NOT (language = 'unknown' OR language IN ('en', 'de')) THEN 'language' WHEN len({WORDS_SQL}) > 0 AND len(list_filter({WORDS_SQL}, lambda x: list_contains({SPAM_SQL}, x))) > 0.004 * len({WORDS_SQL}) THEN 'spam' END AS reason FROM o")
def _(t: Tables) -> DataFrame:
    # What a text gives with a language that is kept, and with one that is not: both are told in its row, so no text is shuffled.
    reason = lambda lang: P.drop_reason(F.col("text"), F.lit(lang).cast("string"), F.lit(False), ["en", "de"])
    rows = detected(t, kept=reason(None), foreign=reason(L.UNKNOWN))
    return rows.select("doc_id", F.when(P.keeps_language(F.nullif("language", F.lit(L.UNKNOWN)), ["en", "de"]), F.col("kept")).otherwise(F.col("foreign")).alias("reason"))


COHERENT_SQL = rf"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents), u AS (SELECT unnest(ws) AS w FROM w), f AS (SELECT w, count(*) AS n, ln({H.BACK_OFF} * count(*) / sum(count(*)) OVER ()) AS fall FROM u GROUP BY 1),
p AS (SELECT doc_id, i - 1 AS i, ws[i] AS a, ws[i + 1] AS b FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)), k AS (SELECT a, b, ln(count(*) / any_value(f.n)) AS score FROM p JOIN f ON f.w = a GROUP BY a, b HAVING count(*) >= {H.KNOWN}),
c AS (SELECT doc_id, i // {H.CHUNK} AS chunk, avg(coalesce(score, fall)) AS mean FROM p LEFT JOIN k USING (a, b) LEFT JOIN f ON f.w = p.b GROUP BY ALL)
SELECT doc_id, round(avg(mean), 6) AS coherency, count(*) AS chunks, round(min(mean), 6) AS worst FROM c GROUP BY 1"""


@query("str_49_coherency", COHERENT_SQL)
def _(t: Tables) -> DataFrame:
    found = H.coherency(t.documents, ["doc_id"], H.bigram_model(t.documents))
    return found.select("doc_id", F.round("coherency", 6).alias("coherency"), "chunks", F.round("worst", 6).alias("worst"))


@query("pip_07_flt_25_ext_50_51_coherency_tags", COHERENT_SQL.replace("SELECT doc_id, round(avg(mean), 6) AS coherency, count(*) AS chunks, round(min(mean), 6) AS worst FROM c GROUP BY 1", "SELECT d.doc_id, 'bigram_incoherent' AS name, d.n_chars AS \"end\", coalesce(m < -7.5, true) AS value FROM documents d LEFT JOIN (SELECT doc_id, avg(mean) AS m FROM c GROUP BY 1) x USING (doc_id)"))
def _(t: Tables) -> DataFrame:
    # Attributes that a model makes: one span a document, under the model's name; texts too short to judge count as incoherent.
    found = H.coherency(t.documents, ["doc_id"], H.bigram_model(t.documents)).select(F.col("doc_id").alias("d"), "coherency")
    rows = t.documents.join(found, F.col("doc_id") == F.col("d"), "left")
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("end"), F.coalesce(F.col("coherency") < -7.5, F.lit(True)).alias("value")))
    tagged = rows.select("doc_id", F.transform_keys(F.create_map(F.lit("incoherent"), span), lambda k, v: F.concat(F.lit("bigram_"), k)).alias("a"))
    return tagged.select("doc_id", F.explode("a").alias("name", "s")).select("doc_id", "name", F.get("s", F.lit(0))["end"].alias("end"), F.get("s", F.lit(0))["value"].alias("value"))


@query("str_49_srt_05_coherent_candidate")
def _(t: Tables) -> DataFrame:
    # Three ways to take the text from a page; the one that reads best under a model of the documents.
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " ")
    ways = {"tags_dropped": F.regexp_replace(plain, "<[^>]*>", ""), "tags_spaced": F.regexp_replace(plain, "<[^>]*>", " "), "as_it_is": F.col("html")}
    candidates = t.pages.select("page_id", F.explode(F.array(*[F.struct(F.lit(n).alias("engine"), x.alias("text")) for n, x in ways.items()])).alias("x")).select("page_id", "x.*")
    return H.most_coherent(candidates, "page_id", "engine", H.bigram_model(t.documents)).select("page_id", "engine", F.round("coherency", 6).alias("coherency"))


@query("flt_05_upright", "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 4 = 0")
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.where(P.is_upright(d % 5 != 0, (d % 4) * 90)).select("doc_id")


# Each page's own body as a table: its tags close or do not as the page has them; some pages lack the end, some have no table.
TABLED = "CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN regexp_replace(html, '<article>', '<article><table>') ELSE regexp_replace(regexp_replace(html, '<article>', '<article><TABLE class=x>'), '</article>', '</table></article>') END"
TAGS_SQL = r"regexp_extract_all(x, '<(/?)([a-zA-Z][^\s/>]*)[^>]*?(/?)>', {})"


@query(
    "flt_10_html_tables",
    rf"""WITH RECURSIVE p AS (SELECT page_id, {TABLED} AS html FROM pages),
b AS (SELECT *, regexp_extract_all(html, '(?is)<table\b[^>]*>.*?</table>') AS ts, len(regexp_extract_all(html, '(?i)<table\b[^>]*>')) AS n, len(regexp_extract_all(html, '(?i)</table>')) AS m FROM p),
u AS (SELECT page_id, k, ts[k] AS x FROM (SELECT page_id, ts, unnest(range(1, len(ts) + 1)) AS k FROM b)),
g AS (SELECT page_id, k, {TAGS_SQL.format(1)} AS e, {TAGS_SQL.format(2)} AS nm, {TAGS_SQL.format(3)} AS s FROM u),
w AS (SELECT page_id, k, 0 AS i, []::VARCHAR[] AS o, true AS ok FROM g
      UNION ALL
      SELECT w.page_id, w.k, w.i + 1, CASE WHEN s[i + 1] = '/' THEN o WHEN e[i + 1] <> '/' THEN list_append(o, lower(nm[i + 1])) WHEN list_contains(o, lower(nm[i + 1])) THEN o[1:len(o) - list_position(list_reverse(o), lower(nm[i + 1]))] ELSE o END,
             ok AND (s[i + 1] = '/' OR e[i + 1] <> '/' OR list_contains(o, lower(nm[i + 1])))
      FROM w JOIN g ON g.page_id = w.page_id AND g.k = w.k WHERE i < len(e)),
f AS (SELECT w.page_id, bool_and(ok AND len(o) = 0) AS good FROM w JOIN g ON g.page_id = w.page_id AND g.k = w.k WHERE i = len(e) GROUP BY 1)
SELECT b.page_id, NOT contains(lower(html), '<table') OR (n = m AND (n = 0 OR len(ts) > 0) AND coalesce(good, true)) AS balanced FROM b LEFT JOIN f USING (page_id)""",
)
def _(t: Tables) -> DataFrame:
    k, html = F.col("page_id") % 5, F.col("html")
    tabled = F.when(k == 0, html).when(k == 1, F.regexp_replace(html, "<article>", "<article><table>")).otherwise(F.regexp_replace(F.regexp_replace(html, "<article>", "<article><TABLE class=x>"), "</article>", "</table></article>"))
    return t.pages.select("page_id", P.balanced_html_tables(tabled).alias("balanced"))


# Marks in place of frequent words of the corpus, so that they nest, cross and stay open as the texts have it.
MARKED = {" the ": " $ ", " de ": r" \( ", " and ": r" \) ", " en ": r" \[ ", " la ": r" \] ", " of ": " $$ ", " der ": r" \begin{align*}", " die ": r" \end{align*} "}
MARKED_SQL = "coalesce(text, '')"
for _word, _mark in MARKED.items():
    MARKED_SQL = f"replace({MARKED_SQL}, '{_word}', '{_mark}')"
STRIPPED = r"list_transform({}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"


def marked(t: Tables) -> Column:
    out = F.coalesce("text", F.lit(""))
    for word, mark in MARKED.items():
        out = F.replace(out, F.lit(word), F.lit(mark))
    return out


def _passes() -> str:
    """SQL of the passes in their order: each pattern's matches, then the text without them."""
    sql, lists = f"SELECT doc_id, {MARKED_SQL} AS x0 FROM documents", []
    for k, p in enumerate((r"\\\((.+?)\\\)", r"\\\[(.+?)\\\]", r"\$\$(.+?)\$\$", r"\$(.+?)\$")):
        lists.append(STRIPPED.format(f"regexp_extract_all(x{k}, '(?s){p}', 1)"))
        sql = f"SELECT *, regexp_replace(x{k}, '(?s){p}', '', 'g') AS x{k + 1} FROM ({sql})"
    return f"SELECT doc_id, array_to_string(list_concat(list_concat({lists[0]}, {lists[1]}), list_concat({lists[2]}, {lists[3]})), '|') AS found FROM ({sql})"


@query("str_25_nested_equations", _passes())
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", marked(t).alias("x")).select("doc_id", F.array_join(X.harvest_equations(F.col("x")), "|").alias("found"))


_TEX = "[]"
for _kind, _pattern in X.TEX_MATH:
    _TEX = f"list_concat({_TEX}, list_transform({STRIPPED.format(f'regexp_extract_all(x, {chr(39)}(?s){_pattern}{chr(39)}, 1)')}, lambda y: '{_kind}:' || y))"


@query("str_26_tex_equations", f"SELECT doc_id, array_to_string(list_filter({_TEX}, lambda y: NOT ends_with(y, ':') OR length(regexp_extract(y, ':(.*)', 1)) > 0), '|') AS found FROM (SELECT doc_id, {MARKED_SQL} AS x FROM documents)")
def _(t: Tables) -> DataFrame:
    found = X.tex_equations(F.col("x"))
    return t.documents.select("doc_id", marked(t).alias("x")).select("doc_id", F.array_join(F.transform(found, lambda f: F.concat(f["kind"], F.lit(":"), f["equation"])), "|").alias("found"))


@query("flt_14_baseline_test")
def _(t: Tables) -> DataFrame:
    limit = F.when(F.col("doc_id") % 10 == 0, F.lit(500))
    return t.documents.select("doc_id", P.baseline_failure(F.col("text"), limit, 30).alias("failure"))


@query("str_09_repeat_counts")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", P.trailing_repeats(F.col("text")).alias("repeats"))


@query("flt_15_ngram_accept", r"SELECT doc_id, regexp_full_match(g, '[A-Za-z0-9.,!?() ]+\n?') AND length(trim(g)) > 9 AS ok FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS g FROM documents)")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("g")).select("doc_id", P.ngram_acceptable(F.col("g"), 3).alias("ok"))


@query("flt_16_triage", "SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN value < 10 THEN 'overrun' ELSE 'good' END AS verdict, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    error = F.when(F.col("event_type") == "error", F.lit("x"))
    finish = F.when(F.col("value") < 10, "length").otherwise("stop")
    return t.events.groupBy(P.triage(error, finish).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_17_page_accept", "SELECT l_orderkey, l_linenumber, (l_linenumber <> 4 AND l_extendedprice <= 16384 AND l_returnflag <> 'R' AND (l_linestatus = 'O' OR l_linenumber = 7)) AS ok FROM lineitem")
def _(t: Tables) -> DataFrame:
    c = F.col
    status, finish = F.when(c("l_linenumber") != 4, 200).otherwise(500), F.when(c("l_returnflag") != "R", "stop").otherwise("length")
    return t.lineitem.select("l_orderkey", "l_linenumber", P.page_accepted(status, c("l_extendedprice"), finish, c("l_linestatus") == "O", c("l_linenumber") == 7).alias("ok"))


@query("flt_18_document_accept", "SELECT l_orderkey, count(*) AS pages, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS fallback FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) <= 0.004 * count(*)")
def _(t: Tables) -> DataFrame:
    out = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("l_returnflag") == "R").alias("fallback"))
    return out.where(F.col("fallback") <= 0.004 * F.col("pages"))


@query("flt_21_22_mined_tests", r"SELECT doc_id, contains(x.a, x.s) AS contradicted, regexp_matches(s, '[\p{L}\p{N}]') AND NOT regexp_matches(s, '[$]') AS valid FROM (SELECT d.doc_id, d.text AS a, coalesce(string_split(e.text, chr(10))[1], d.source) AS s FROM documents d LEFT JOIN documents e ON e.doc_id = d.doc_id + 1) x")
def _(t: Tables) -> DataFrame:
    # The first line of the next document, held against the whole text.
    after = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("line"))
    s = F.coalesce("line", "source")
    return t.documents.join(after, "doc_id", "left").select("doc_id", F.contains(F.col("text"), s).alias("contradicted"), P.mined_text_valid(s).alias("valid"))


@query("flt_23_24_short_texts", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 3)) AS long_lines, length(trim(text)) < 3 AS trivial FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 3)).cast("long").alias("long_lines"), P.both_trivial(F.col("text"), F.lit("")).alias("trivial"))


TRUTH, GUESS = "quality:any and not toxic:any", "alpha:avg>0.75 and not spam:any"


def attributed(t: Tables) -> DataFrame:
    """Documents with a map of span attributes, joined by id; rule input."""
    span = lambda v: F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("end"), v.cast("double").alias("value")))
    lines = F.filter(X.lines(F.col("text")), lambda x: F.length(x) > 0)
    per_line = F.transform(lines, lambda x: F.struct(F.lit(0).cast("long").alias("start"), F.length(x).cast("long").alias("end"), P.alpha_share(x).alias("value")))
    own = F.create_map(F.lit("alpha"), per_line, F.lit("spam"), span(P.is_download_spam(F.col("text"))))
    docs = t.documents.select("doc_id", "n_chars", own.alias("own"))
    labels = t.labels.select("doc_id", "quality", "toxic")
    joined = docs.join(labels, "doc_id", "left")
    given = F.when(F.col("quality").isNotNull(), F.create_map(F.lit("quality"), span(F.col("quality")), F.lit("toxic"), span(F.col("toxic"))))
    return joined.select("doc_id", F.coalesce(F.map_concat("own", given), F.col("own")).alias("attributes"))


ATTR_SQL = rf"""
WITH a AS (
  SELECT d.doc_id, coalesce(l.quality = 1, false) AND NOT coalesce(l.toxic = 1, false) AS t, {WORDS_SQL.replace('text', 'd.text')} AS ws,
         list_transform(list_filter(string_split(d.text, chr(10)), lambda x: length(x) > 0), lambda x: length(regexp_replace(x, '[^\p{{L}}]+', '', 'g')) / length(x)) AS al
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
), b AS (
  SELECT doc_id, t, coalesce(len(al) > 0 AND list_sum(al) / len(al) > 0.75, false) AND NOT (len(ws) > 0 AND len(list_filter(ws, lambda x: list_contains({SPAM_SQL}, x))) > 0.004 * len(ws)) AS g FROM a
)"""


@query("rul_04_07_rule_rows", ATTR_SQL + " SELECT doc_id, t, g FROM b")
def _(t: Tables) -> DataFrame:
    c = F.col("attributes")
    return attributed(t).select("doc_id", R.compile_rule(TRUTH, c).alias("t"), R.compile_rule(GUESS, c).alias("g"))


@query(
    "agg_14_rule_confusion",
    ATTR_SQL + """, c AS (SELECT count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND NOT g) AS tn, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn FROM b)
SELECT tp, tn, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp + fn, 0), 0) AS iou FROM c""",
)
def rule_confusion(t: Tables) -> DataFrame:
    c = F.col("attributes")
    return R.confusion(attributed(t), R.compile_rule(TRUTH, c), R.compile_rule(GUESS, c))


@query("rul_09_leaf_statistics", "SELECT 'quality:any' AS leaf, count(l.doc_id) AS entries, count(*) FILTER (l.quality = 1) AS positive, count(*) FILTER (l.quality = 1) AS matched FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT 'toxic:any', count(l.doc_id), count(*) FILTER (l.toxic = 1), count(*) FILTER (l.toxic = 1) FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t: Tables) -> DataFrame:
    return R.leaf_statistics(attributed(t), TRUTH)


@query("rul_01_08_rule_text", "SELECT lang, source, '((' || lang || ':any and not ' || regexp_replace(source, '[^A-Za-z0-9_]', '_', 'g') || ':all) or n:avg>' || count(*) || '.5)' AS canonical, 3 AS leaves FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2, regexp_replace(source, '[^A-Za-z0-9_]', '_', 'g')")
def _(t: Tables) -> DataFrame:
    # A rule for each language and source of the corpus, parsed and written back.
    @F.arrow_udf("struct<canonical:string,leaves:int>")
    def parsed(rules: pa.Array) -> pa.Array:
        trees = [R.parse(x) for x in rules.to_pylist()]
        return pa.array([{"canonical": str(x), "leaves": len(R.leaves(x))} for x in trees], pa.struct([("canonical", pa.string()), ("leaves", pa.int32())]))

    names = t.documents.where("lang IS NOT NULL AND source IS NOT NULL").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    rule = F.concat("lang", F.lit(":any and not "), F.regexp_replace("source", "[^A-Za-z0-9_]", "_"), F.lit(":all or (n:avg>"), F.col("n").cast("string"), F.lit(".5)"))
    return names.select("lang", "source", parsed(rule).alias("x")).select("lang", "source", "x.*")
