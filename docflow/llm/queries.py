"""The registered queries: thin digests of the operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docflow.llm import quality_rules as rules
from docflow.llm.exact_dedup import exact_dedup
from docflow.llm.license_scan import license_scan
from docflow.llm.minhash_dedup import near_duplicates
from docflow.llm.ngram_join import ngram_join
from docflow.llm.packing import pack_documents
from docflow.llm.quality_classifier import quality_scores
from docflow.llm.quality_rules import quality_rules
from docflow.llm.sentence_pieces import round_trip
from docflow.llm.sharding import shard_documents
from docflow.llm.substring_dedup import substring_dedup
from docflow.llm.token_alignment import align_tokens
from docflow.llm.token_files import read_tokens, token_checksums, token_folder, write_token_files
from docflow.llm.whitening import whiten


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_folder(spark)
    write_token_files(_documents(spark, sf_dir), folder)
    return token_checksums(read_tokens(spark, folder))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), 85)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir)).drop("char_distance", "word_distance")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "dedup.n_words", "dedup.n_removed", "dedup.kept_sha256")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_documents(spark, sf_dir))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_license_scan": op2_license_scan,
    "op3_token_files": op3_token_files,
    "op4_packing": op4_packing,
    "op5_sentence_pieces": op5_sentence_pieces,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sharding": op10_sharding,
    "op11_ngram_join": op11_ngram_join,
    "op12_token_alignment": op12_token_alignment,
    "op13_whitening": op13_whitening,
}

def _quality_sql() -> str:
    """SQL for the quality rules, with the word lists and bounds of the operator."""
    lists = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.COMMON_WORDS.items())
    counts = ", ".join(f"length(regexp_replace(text, '[^{k[1:-1] if k.startswith('[') else k}]+', '', 'g'))".replace("'\"()-", "''\"()-") for k in rules.CLASSES)
    n, k = len(rules.CLASSES) + 1, rules.N_COMMON + 1
    share = lambda c, i: f"CAST(floor({c}[{i}] / greatest(list_sum({c}), 1) * {rules.BINS}) AS INTEGER)"
    bins = lambda c, m: "[" + ", ".join(share(c, i + 1) for i in range(m)) + "]"
    part = lambda p, m: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END"
    distance = lambda a, b: (
        f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(list_zip(list_transform({a}, lambda x: x / list_sum({a})), list_transform({b}, lambda x: x / list_sum({b}))), "
        f"lambda z: {part('z[1]', '((z[1] + z[2]) / 2)')} + {part('z[2]', '((z[1] + z[2]) / 2)')})) / 2)) END"
    )
    return rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN regexp_full_match(lower(lang), '[a-z]{{2,3}}([-_].*)?') THEN regexp_extract(lower(lang), '^[a-z]+') ELSE 'other' END AS language, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS letters,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, [{counts}] AS ks, CASE language {lists} ELSE []::VARCHAR[] END AS cw FROM d
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), r AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, language, len(ws) AS n_words, length(text) - ks[5] AS word_chars, ks[4] AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         list_append(ks, length(text) - list_sum(ks)) AS chars, CASE WHEN len(cw) > 0 THEN list_transform(cw, lambda x: len(list_filter(letters, lambda y: y = x))) ELSE list_transform(range({rules.N_COMMON}), lambda x: 0::BIGINT) END AS cs, len(letters) AS nl FROM w LEFT JOIN r USING (doc_id)
), h AS (
  SELECT *, list_append(cs, nl - list_sum(cs)) AS common, n_words < {rules.MIN_BASE_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f
), b AS (
  SELECT language, unnest(range(1, {n + k} + 1)) AS slot, unnest(list_concat({bins('chars', n)}, {bins('common', k)})) AS bin FROM h WHERE NOT base_failed AND n_words >= {rules.MIN_WORDS}
), md AS (
  SELECT language, slot, quantile_disc(bin, 0.5) AS bin, count(*) AS docs FROM b GROUP BY ALL
), pl AS (SELECT slot, quantile_disc(bin, 0.5) AS bin FROM b GROUP BY 1),
dr AS (
  SELECT language, list((docs * md.bin + {rules.PRIOR_DOCS} * pl.bin) / (docs + {rules.PRIOR_DOCS}) ORDER BY slot) AS v FROM md JOIN pl USING (slot) GROUP BY 1
), q AS (
  SELECT language, v[1:{n}] AS rc, v[{n + 1}:{n + k}] AS rw FROM dr
), x AS (
  SELECT h.*, {distance('chars', 'rc')} AS dc, {distance('common', 'rw')} AS dw FROM h LEFT JOIN q USING (language)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= {rules.MIN_WORDS} AND coalesce(dc > {rules.MAX_CHAR_DISTANCE} + {rules.LENGTH_SLACK} / greatest(n_words, 1) OR dw > {rules.MAX_WORD_DISTANCE} + {rules.LENGTH_SLACK} / greatest(n_words, 1), false)) AS kept FROM x
"""


ORACLE_SQL: dict[str, str] = {
    "op8_quality_rules": _quality_sql(),
    "op6_exact_dedup": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
    "op7_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), '|')) AS h, sh FROM s),
c AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n, arg_min(sh, doc_id) AS sh FROM n WHERE n > 0 GROUP BY h),
e AS (SELECT rep, n, unnest(sh) AS x FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, CASE WHEN n.n = 0 THEN n.doc_id ELSE k.component_id END AS component_id,
       n.doc_id = CASE WHEN n.n = 0 THEN n.doc_id ELSE k.component_id END AS kept
FROM n LEFT JOIN c ON c.h = n.h AND n.n > 0 LEFT JOIN k ON k.rep = c.rep
""",
    "op11_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), '|')) AS h, sh FROM s),
c AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n, arg_min(sh, doc_id) AS sh FROM n WHERE n > 0 GROUP BY h),
e AS (SELECT rep, n, unnest(sh) AS x FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, CASE WHEN n.n = 0 THEN n.doc_id ELSE k.component_id END AS component_id
FROM n LEFT JOIN c ON c.h = n.h AND n.n > 0 LEFT JOIN k ON k.rep = c.rep
""",
    "op9_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, unnest(list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i:i+19], ' ')))) AS h FROM w WHERE len(ws) >= 20
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g
), x AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE k > 1
), y AS (SELECT doc_id, list(j) AS js FROM x GROUP BY doc_id),
z AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
t AS (
  SELECT z.doc_id, string_agg(z.word, ' ' ORDER BY z.j) AS kept FROM z LEFT JOIN x ON x.doc_id = z.doc_id AND x.j = z.j WHERE x.j IS NULL GROUP BY z.doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN y USING (doc_id) LEFT JOIN t USING (doc_id)
""",
}
