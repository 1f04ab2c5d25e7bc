"""Text functions as Columns: they stay in the JVM and inside code generation.

Python's ``\\w`` and ``\\W`` are Unicode classes, Java's are ASCII; the constants
here are the one place that says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}_]+"
ALNUM = r"[\p{L}\p{N}]"

# Characters folded to plain ones before texts are compared.
FOLD_FROM = "‘’‚“”„＿–—‑‒−\u00b5"
FOLD_TO = "'''\"\"\"_-----\u03bc"

# What is replaced, in order, before texts are compared; \\1 is the first group.
NORMALIZE_STEPS = [(r"<br/?>", " "), (r"\s+", " "), (r"\*\*(.*?)\*\*", r"\1"), (r"__(.*?)__", r"\1"), (r"</?b>", ""), (r"</?i>", ""), (r"\*(.*?)\*", r"\1"), (r"_(.*?)_", r"\1")]

# The marks of the page formats that are read here.
IMAGE = r"!\[.*?\]\(.*?\)"
HTML_TABLE = r"(?is)<table.*?</table>"
TABLE_TAG = "POSICUBE_TABLE_KV"
TAGGED_TABLE = rf"(?is)<{TABLE_TAG}>.*?</{TABLE_TAG}>"
INLINE_MATH = r"(?s)(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)"
INLINE_LATEX = r"(?s)\\\((.+?)\\\)"
BLOCK_MATH = r"(?s)\$\$(.+?)\$\$"
CODE_BLOCK = r"(?s)```.*?```|~~~.*?~~~"


def replace_all(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def strip(text: Column) -> Column:
    """Cut white space at both ends, as Python does for ASCII."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased; empty texts have none."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def normalize_ascii(text: Column) -> Column:
    """Canonical text for comparisons, up to the Unicode form (see ``fuzzy.normalize``)."""
    text = replace_all(text, *[(pattern, new.replace("\\", "$")) for pattern, new in NORMALIZE_STEPS])
    return F.translate(text, FOLD_FROM, FOLD_TO)


def fold_tex(text: Column) -> Column:
    """The weaker folding used when texts are matched with TeX sources."""
    return F.translate(F.regexp_replace(text, r"\s+", " "), FOLD_FROM, FOLD_TO)


def edit_distance_to_truth(pred: Column, truth: Column) -> Column:
    """Edit distance over the truth's length; may exceed 1."""
    return F.levenshtein(pred, truth) / F.greatest(F.length(truth), F.lit(1))


def normalized_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty texts."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def similarity_from_distance(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)


def collapse_repeated_symbols(text: Column) -> Column:
    """Runs of three and more divider characters become three of the first."""
    return F.regexp_replace(text, r"([=_~\\-])[=_~\\-]{2,}", "$1$1$1")


def strip_inline_math(text: Column) -> Column:
    return replace_all(text, (r"(?s)(?<!\$)\$(?!\$)\s*(.+?)\s*(?<!\$)\$(?!\$)", "$1"), (r"(?s)\\\(\s*(.+?)\s*\\\)", "$1"))


def strip_markdown_syntax(text: Column) -> Column:
    """Quote, heading and list marks at line starts, links and code ticks."""
    return replace_all(text, (r"(?m)^[ \t]*>+[ \t]*", ""), (r"(?m)^[ \t]*#{1,6}[ \t]+", ""), (r"(?m)^[ \t]*[-*+][ \t]+", ""), (r"(?m)^[ \t]*\d+\.[ \t]+", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"`([^`]+)`", "$1"))


def normalize_whitespace(text: Column) -> Column:
    return strip(replace_all(text, (r"\r\n|\r", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")))


def remove_markdown_tables(text: Column) -> Column:
    """GFM tables: a piped line, its separator line, and the piped lines below."""
    return F.regexp_replace(text, r"(?m)^[ \t]*\|.*\|[ \t]*\n[ \t]*\|?[ \t]*[:-]+[-| :]*\|?[ \t]*(\n|\z)([ \t]*\|.*\|[ \t]*(\n|\z))*", "")


def remove_images(text: Column) -> Column:
    return strip(F.regexp_replace(text, IMAGE, ""))


def remove_tables(text: Column, version: str = "") -> Column:
    """Table markup of a format version: 1.9 HTML tables, 1.10 tagged key-values."""
    if version == "1.9":
        text = replace_all(text, (r"(?s)<style.*?</style>", ""), (r"(?s)<table.*?</table>", ""))
    elif version == "1.10":
        text = F.regexp_replace(text, rf"(?s)<{TABLE_TAG}>.*?</{TABLE_TAG}>", "")
    return strip(text)


def remove_heading_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^(#{1,6})\s*", "")


def remove_error_strings(text: Column) -> Column:
    return replace_all(text, ("plaintext", ""), (r"<p>\|.*?\|</p>", ""))


def clean_text(text: Column) -> Column:
    return strip(replace_all(text, (r"[ \t]+\n", "\n"), (r"\n+", "\n"), (r" +", " ")))


def prepare_for_text_edit(text: Column, table_version: str = "") -> Column:
    """What is left of Markdown for a comparison of running text, in thirteen steps.

    Front matter is stripped here.
    """
    text = remove_tables(remove_images(text), table_version)
    text = replace_all(text, (HTML_TABLE, " "), (TAGGED_TABLE, " "))
    text = remove_markdown_tables(text)
    text = replace_all(text, (CODE_BLOCK, " "), (r"(?s)\$\$.*?\$\$", " "), (r"(?s)\\\[.*?\\\]", " "), (r"(?s)\A---.*?---\s*", ""))
    return normalize_whitespace(strip_markdown_syntax(strip_inline_math(collapse_repeated_symbols(text))))


def split_paragraphs(text: Column) -> Column:
    """Parts between blank lines; lines where there are none."""
    pieces = lambda pattern: F.filter(F.transform(F.split(text, pattern), strip), lambda p: p != "")
    return F.when(F.size(pieces(r"\n\s*\n")) > 0, pieces(r"\n\s*\n")).otherwise(pieces("\n"))


def extract_headings(text: Column) -> Column:
    """Headings as (text, level)."""
    pattern = F.lit(r"(?m)^(#{1,6})[ \t]*([^\n]+)")
    marks, titles = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    return F.zip_with(titles, marks, lambda t, m: F.struct(F.trim(t).alias("text"), F.length(m).alias("level")))


def extract_lists(text: Column) -> Column:
    items = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*[-*+][ \t]+([^\n]*)"), F.lit(1))
    return F.filter(F.transform(items, strip), lambda x: x != "")


def detect_table_type(text: Column) -> Column:
    return F.when(text.rlike(TAGGED_TABLE), "tagged").when(text.rlike(HTML_TABLE), "html")


def extract_tables(text: Column) -> Column:
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    kind = detect_table_type(text)
    return F.when(kind == "tagged", found(TAGGED_TABLE)).when(kind == "html", found(HTML_TABLE)).otherwise(F.array().cast("array<string>"))


def extract_images(text: Column) -> Column:
    pattern = F.lit(r"!\[(.*?)\]\((.*?)\)")
    parts = F.arrays_zip(*[F.regexp_extract_all(text, pattern, F.lit(k)).alias(n) for k, n in ((1, "alt"), (2, "url"), (0, "raw"))])
    return F.transform(parts, lambda x: F.struct(x["alt"].alias("alt"), x["url"].alias("url"), x["raw"].alias("raw")))


def extract_image_boxes(text: Column) -> Column:
    """[x, y, w, h] of every bbox comment."""
    number = r"(-?\d+(?:\.\d+)?)"
    pattern = F.lit(rf"<!--\s*bbox:\s*\[?{number}\s*,\s*{number}\s*,\s*{number}\s*,\s*{number}\s*\]?\s*-->")
    sides = [F.regexp_extract_all(text, pattern, F.lit(k)) for k in range(1, 5)]
    return F.transform(F.arrays_zip(*[s.alias(n) for s, n in zip(sides, "xywh", strict=True)]), lambda b: F.array(*[b[n].cast("double") for n in "xywh"]))


def extract_formulas(text: Column) -> Column:
    """Block formulas first, then inline ones of what is left."""
    blocks = F.regexp_extract_all(text, F.lit(BLOCK_MATH), F.lit(1))
    inline = F.regexp_extract_all(F.regexp_replace(text, BLOCK_MATH, ""), F.lit(INLINE_MATH), F.lit(1))
    return F.filter(F.transform(F.concat(blocks, inline), strip), lambda x: x != "")


def extract_text(text: Column) -> Column:
    """Text without images and tables."""
    kind, plain = detect_table_type(text), F.regexp_replace(text, IMAGE, "")
    plain = F.when(kind == "tagged", F.regexp_replace(plain, TAGGED_TABLE, "")).when(kind == "html", F.regexp_replace(plain, HTML_TABLE, "")).otherwise(plain)
    return strip(replace_all(plain, (r"\n{2,}", "\n"), (r"[ \t]+", " ")))


def parse_markdown(text: Column) -> Column:
    return F.struct(extract_text(text).alias("text"), extract_tables(text).alias("tables"), extract_images(text).alias("images"), extract_image_boxes(text).alias("image_bboxes"), extract_formulas(text).alias("formulas"), detect_table_type(text).alias("table_type"))


def harvest_equations(text: Column, dollars: bool = True) -> Column:
    """Equations between \\(, \\[ and, with ``dollars``, $$ and $, in that order; each pass works on what the last left."""
    patterns = (INLINE_LATEX, r"(?s)\\\[(.+?)\\\]", BLOCK_MATH, r"(?s)\$(.+?)\$")[: 4 if dollars else 2]
    found = lambda text, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), strip)
    none = F.array().cast("array<string>")
    out, left = none, text
    for pattern in patterns:
        out = F.concat(out, found(left, pattern))
        left = F.regexp_replace(left, pattern, "")
    # Passes before the last leave a text without their marks as it is.
    plain = ~(F.contains(text, F.lit("\\(")) | F.contains(text, F.lit("\\[")) | (F.contains(text, F.lit("$$")) if dollars else F.lit(False)))
    return F.when(plain, found(text, patterns[-1]) if dollars else none).otherwise(out)


#: Environments and marks of display formulas in TeX sources, then inline ones, each with its name.
TEX_MATH = (
    ("$$", r"\$\$(.*?)\$\$"),
    ("equation", r"\\begin\{equation\}(.*?)\\end\{equation\}"),
    ("equation*", r"\\begin\{equation\*\}(.*?)\\end\{equation\*\}"),
    ("align", r"\\begin\{align\}(.*?)\\end\{align\}"),
    ("align*", r"\\begin\{align\*\}(.*?)\\end\{align\*\}"),
    ("displaymath", r"\\begin\{displaymath\}(.*?)\\end\{displaymath\}"),
    ("displaymath", r"\\\[(.*?)\\\]"),
    ("inline", r"\$(.*?)\$"),
    ("inline", r"\\\((.*?)\\\)"),
)


def tex_equations(text: Column) -> Column:
    """Formulas of TeX sources (kind, equation); every pattern reads the whole text, so overlaps are kept."""

    def named(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"(?s){pattern}"), F.lit(1))
        return F.transform(found, lambda e: F.struct(F.lit(kind).alias("kind"), strip(e).alias("equation")))

    return F.filter(F.concat(*[named(*x) for x in TEX_MATH]), lambda x: x["equation"] != "")


def harvest_tex_math(text: Column) -> Column:
    """The formulas of :func:`tex_equations` alone."""
    return F.transform(tex_equations(text), lambda x: x["equation"])


def normalize_latex_brackets(text: Column) -> Column:
    """$$..$$ becomes \\[..\\] and $..$ becomes \\(..\\)."""
    return replace_all(text, (r"(?s)\$\$(.+?)\$\$", r"\\[$1\\]"), (r"(?s)(?<!\\)\$([^$]+?)\$", r"\\($1\\)"))


def parse_front_matter(text: Column) -> Column:
    """(front, body): the fields between leading --- lines as a map, and the rest; null front without them."""
    has = text.rlike(r"(?s)\A---\n.*?\n---")
    raw = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")
    rows = F.filter(F.split(raw, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(rows, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))))
    return F.struct(F.when(has, F.map_from_entries(pairs)).alias("front"), F.when(has, strip(body)).otherwise(text).alias("body"))


def render_front_matter(language: Column, valid: Column, rotation: Column, table: Column, diagram: Column, body: Column) -> Column:
    """A page as front matter and text; booleans are written True and False, nulls null."""
    flag = lambda c: F.when(c, "True").when(~c, "False").otherwise("null")
    head = F.concat(F.lit("---\nprimary_language: "), F.coalesce(language, F.lit("null")), F.lit("\nis_rotation_valid: "), flag(valid), F.lit("\nrotation_correction: "), F.coalesce(rotation.cast("string"), F.lit("null")), F.lit("\nis_table: "), flag(table), F.lit("\nis_diagram: "), flag(diagram), F.lit("\n---"))
    return F.when(F.coalesce(body, F.lit("")) == "", head).otherwise(F.concat(head, F.lit("\n"), body))


def update_rotation(text: Column, angle: Column) -> Column:
    """Write the correction that undoes a rotation by ``angle`` into front matter."""
    fix = F.pmod(F.lit(360) - angle, F.lit(360)).cast("string")
    with_valid = F.regexp_replace(text, r"(?m)^is_rotation_valid:.*$", F.lit("is_rotation_valid: False"))
    return F.regexp_replace(F.when(fix == "0", text).otherwise(with_valid), F.lit(r"(?m)^rotation_correction:.*$"), F.concat(F.lit("rotation_correction: "), fix))


def cap_split(text: Column, limit: int) -> Column:
    """Head and tail of a long text, both cut between words, around an ellipsis."""
    half = limit // 2 - 3
    head = F.regexp_replace(F.left(text, F.lit(half)), r"\s+\S*\z", "")
    tail = F.regexp_replace(F.right(text, F.lit(half)), r"^\S*\s+", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit(" ... "), tail))


def clean_element(text: Column) -> Column:
    """Text of a page element on one line with brackets and line ends escaped."""
    return F.replace(F.replace(F.replace(F.replace(strip(text), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def raw_text_section(prompt: Column) -> Column:
    return F.nullif(F.regexp_extract(prompt, r"(?s)RAW_TEXT_START\s*\n(.*?)\nRAW_TEXT_END", 1), F.lit(""))


def last_code_block(reply: Column) -> Column:
    """The last html block, else the last block, else an open block's rest, else the reply."""
    block = lambda p: F.try_element_at(F.regexp_extract_all(reply, F.lit(p), F.lit(1)), F.lit(-1))
    return F.coalesce(block(r"(?s)```html\n(.*?)```"), block(r"(?s)```\w*\n(.*?)```"), F.nullif(F.regexp_extract(reply, r"(?s)```\w*\n(.*)\z", 1), F.lit("")), reply)


def bbox_tokens(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("<!-- bbox:"), F.lit("<|bbox_start|>")), F.lit("<!--bbox:"), F.lit("<|bbox_start|>")), F.lit("-->"), F.lit("<|bbox_end|>"))


def url_host(url: Column) -> Column:
    return F.parse_url(url, F.lit("AUTHORITY"))


def pdf_hash(url: Column) -> Column:
    """The hash in a stored PDF's name: two-letter folder and rest, or the bare name."""
    return F.nullif(F.concat(F.regexp_extract(url, r"/([0-9a-f]{4})/([0-9a-f]+)\.pdf$", 1), F.regexp_extract(url, r"([0-9a-f]+)(?:_pg\d+)?\.pdf$", 1)), F.lit(""))


def candidate_name(name: Column) -> Column:
    """(pdf, page, repeat) of ``<pdf>_pg<page>_repeat<n>.md``."""
    part = lambda k: F.regexp_extract(name, r"^(.*)_pg(\d+)_repeat(\d+)\.md$", k)
    return F.when(name.rlike(r"^(.*)_pg(\d+)_repeat(\d+)\.md$"), F.struct(part(1).alias("pdf"), part(2).cast("int").alias("page"), part(3).cast("int").alias("repeat")))


def group_hash(paths: Column) -> Column:
    """One hash for a set of paths in any order."""
    return F.sha1(F.array_join(F.array_sort(paths), ""))


def safe_filename(name: Column) -> Column:
    safe = F.translate(name, "/\\:", "___")
    return F.when(F.length(safe) > 200, F.concat(F.left(safe, F.lit(150)), F.lit("_"), F.left(F.md5(name), F.lit(8)))).otherwise(safe)


def html_escape(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def split_key(key: Column) -> Column:
    """(path, page) of a key cut at its last dash."""
    return F.struct(F.regexp_extract(key, r"^(.*)-([0-9]+)$", 1).alias("path"), F.regexp_extract(key, r"^(.*)-([0-9]+)$", 2).cast("int").alias("page"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(strip(text), r"(?<=[.!?])\s+"), lambda s: s != "")
