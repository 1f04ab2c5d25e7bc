"""Document and page predicates, each a Column; composites give a reject reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions import text as T

# Words that mark download spam.
SPAM_WORDS = ["download", "pdf", "epub", "mobi", "free", "ebook", "file", "save", "casino", "viagra", "cialis", "ciprofloxacin"]
SPAM_SHARE = 0.004
MIN_CHARS = 200
MIN_ALPHA = 0.5

# Mathematical symbols that should not stand outside tables.
MATH_SYMBOLS = "∈∉⊂⊃⊆⊇∅∪∩∀∃¬⊕⊗⊙∂∇∆∫∬∭∮∏∑√∛∜⊥∠∡⊤⊢⊣∴∵∶∷∝≅≆≇≊≋⊖⊘⊚⊛⊜⊝"

# LaTeX commands that should not stand outside formulas.
LATEX_COMMANDS = [
    r"\begin{itemize}", r"\begin{enumerate}", r"\item", r"\begin{figure}", r"\includegraphics", r"\caption", r"\label", r"\ref",
    r"\eqref", r"\begin{table}", r"\begin{tabular}", r"\textit", r"\textbb", r"\begin{equation}", r"\begin{align}", r"\frac", r"\sum",
    r"\int", r"\sqrt", r"\prod", r"\lim", r"\binom", r"\mathbb", r"\mathcal", r"\to", r"\varphi", r"\cdot", r"\langle", r"\rangle", r"\cite",
]

# Character ranges that a page must not contain.
DISALLOWED = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{1f600}-\x{1f64f}\x{1f300}-\x{1f5ff}\x{1f680}-\x{1f6ff}\x{1f1e0}-\x{1f1ff}]"


def spam_share(text: Column) -> Column:
    ws = T.words(text)
    return F.when(F.size(ws) > 0, F.size(F.filter(ws, lambda w: w.isin(SPAM_WORDS))) / F.size(ws)).otherwise(0.0)


def is_download_spam(text: Column, share: float = SPAM_SHARE) -> Column:
    return F.coalesce(spam_share(text) > share, F.lit(False))


def alpha_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / F.greatest(F.length(text), F.lit(1))


def keeps_language(lang: Column, languages: list[str]) -> Column:
    """An unknown language is kept."""
    return lang.isNull() | lang.isin(languages)


def drop_reason(text: Column, lang: Column, has_form: Column, languages: list[str]) -> Column:
    """Why a document is dropped, or null.  Short and letter-poor texts are kept unjudged."""
    return (
        F.when(F.coalesce(has_form, F.lit(False)), "form")
        .when(F.length(text) < MIN_CHARS, None)
        .when(alpha_share(text) < MIN_ALPHA, None)
        .when(~keeps_language(lang, languages), "language")
        .when(is_download_spam(text), "spam")
    )


def is_upright(valid: Column, rotation: Column) -> Column:
    return F.coalesce(valid, F.lit(False)) & (F.coalesce(rotation, F.lit(0)) == 0)


def has_markdown_table(text: Column) -> Column:
    """A row of three pipes and more beside a dashed line that starts with a pipe."""
    row, rule = r"[ \t]*\|[^\n]*\|[^\n]*\|[ \t]*", r"[ \t]*\|[^\n]*-[^\n]*"
    return text.rlike(rf"(?m)^{row}\n{rule}$") | text.rlike(rf"(?m)^{rule}\n{row}$")


def has_math_symbols(text: Column) -> Column:
    # One range holds all symbols but the sign of negation; few texts have any of it, and a range is tested faster than a set.
    return text.rlike(r"[\x{ac}\x{2200}-\x{22ff}]") & F.regexp_replace(text, r"(?is)<table\b.*?</table>", "").rlike(f"[{MATH_SYMBOLS}]")


def has_latex_table(text: Column) -> Column:
    return text.rlike(r"(?i)\\begin\{tab(le|ular)\}")


def has_latex_outside_math(text: Column) -> Column:
    rest = T.replace_all(text, (r"(?s)\$\$(.+?)\$\$", ""), (r"(?s)\\\((.+?)\\\)", ""), (r"(?s)\\\[(.+?)\\\]", ""))
    out = F.lit(False)
    for command in LATEX_COMMANDS:
        out = out | rest.contains(command)
    return out


#: A tag: its slash, its name, and the slash at its end.
TAG = r"<(/?)([a-zA-Z][^\s/>]*)[^>]*?(/?)>"


def _closes(tags: Column) -> Column:
    """Whether tags, in order, close each other: an end tag closes the last open one of its name and all within it."""
    part = lambda tag, k: F.regexp_extract(tag, TAG, k)
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("open"))

    def step(acc: Column, tag: Column) -> Column:
        name = F.lower(part(tag, 2))
        place = F.array_position(F.reverse(acc["open"]), name)
        left = F.slice(acc["open"], F.lit(1), F.greatest((F.size(acc["open"]) - place).cast("int"), F.lit(0)))
        closed = F.struct((acc["ok"] & (place > 0)).alias("ok"), F.when(place > 0, left).otherwise(acc["open"]).alias("open"))
        opened = F.struct(acc["ok"].alias("ok"), F.array_append(acc["open"], name).alias("open"))
        return F.when(part(tag, 3) == "/", acc).when(part(tag, 1) == "/", closed).otherwise(opened)

    return F.aggregate(tags, start, step, lambda acc: acc["ok"] & (F.size(acc["open"]) == 0))


def balanced_html_tables(text: Column) -> Column:
    """Whether every HTML table is whole: as many ends as begins, and within each the tags close each other."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    tables = F.regexp_extract_all(text, F.lit(r"(?is)<table\b[^>]*>.*?</table>"), F.lit(0))
    whole = F.forall(tables, lambda x: _closes(F.regexp_extract_all(x, F.lit(TAG), F.lit(0))))
    begins = count(r"(?i)<table\b[^>]*>")
    return ~F.contains(F.lower(text), F.lit("<table")) | ((begins == count(r"(?i)</table>")) & ((begins == 0) | (F.size(tables) > 0)) & whole)


def has_break_in_cell(text: Column) -> Column:
    return text.rlike(r"(?is)<t[dh]\b[^>]*>(?:(?!</t[dh]>).)*<br\s*/?>")


def text_reject_reason(text: Column, valid_tables: Column, renders: Column) -> Column:
    """The first rule that a page's text breaks, or null; the last two inputs come from outside."""
    return (
        F.when(has_markdown_table(text), "markdown_table")
        .when(~valid_tables, "html_table")
        .when(~renders, "math_render")
        .when(has_math_symbols(text), "math_symbols")
        .when(has_latex_outside_math(text), "latex_command")
        .when(has_latex_table(text), "latex_table")
    )


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def trailing_repeats(text: Column, sizes: int = 5, most: int | None = None) -> Column:
    """How often the last n characters repeat at the end, for n of 1 to ``sizes``.

    Runs of white space count as one space, also at the ends.  Shorter texts have no repeats.
    With ``most`` counts beyond it are not told apart, and only as much of the text's end is read.
    """
    back = F.reverse(text)
    if most is not None:
        back = F.regexp_extract(back, rf"(?sU)^(?:\s++|\S){{0,{(most + 1) * sizes}}}+", 0)
    back = F.regexp_replace(back, r"(?U)\s+", " ")

    def repeats(back: Column, n: int) -> Column:
        # The longest prefix of the reversed text with period n: possessive, so no back-tracking.
        run = F.regexp_extract(back, rf"(?s)^((.{{{n}}})\2*+)", 1)
        return F.floor(F.length(run) / n).cast("int")

    # Bound by a lambda: the end would else be made anew for every size.
    return F.get(F.transform(F.array(back), lambda b: F.array(*[repeats(b, n) for n in range(1, sizes + 1)])), F.lit(0))


def baseline_failure(text: Column, max_length: Column, max_repeats: int = 30) -> Column:
    """Why a page fails the baseline test, or null.  With a maximum length only that is judged."""
    repeats = F.array_max(trailing_repeats(text, most=max_repeats))
    return (
        F.when(max_length.isNotNull(), F.when(alnum_count(text) > max_length, "not_blank"))
        .when(~text.rlike(r"[\p{L}\p{N}]"), "no_alnum")
        .when(repeats > max_repeats, "repeats")
        .when(text.rlike(DISALLOWED), "disallowed_characters")
    )


def ngram_acceptable(gram: Column, n: int) -> Column:
    return gram.rlike(r"^[A-Za-z0-9.,!?() ]+$") & (F.length(F.trim(gram)) > 3 * n)


def triage(error: Column, finish: Column) -> Column:
    return F.when(error.isNotNull(), "error").when(F.coalesce(finish, F.lit("")) != "stop", "overrun").otherwise("good")


def page_accepted(status: Column, total_tokens: Column, finish: Column, valid: Column, last_attempt: Column, limit: int = 16384) -> Column:
    """A page's response is used; an invalid rotation passes on the last attempt."""
    return (status == 200) & (total_tokens <= limit) & (finish == "stop") & (valid | last_attempt)


def mined_text_valid(*fields: Column) -> Column:
    out = F.lit(True)
    for f in fields:
        odd = f.rlike(r"\\[\(\[]|\$|[\x{2070}-\x{209f}\x{00b2}\x{00b3}\x{00b9}]")
        out = out & (f.isNull() | (f.rlike(T.ALNUM) & ~odd))
    return out


def both_trivial(a: Column, b: Column) -> Column:
    return (F.length(F.trim(a)) < 3) & (F.length(F.trim(b)) < 3)
