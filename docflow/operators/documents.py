"""Documents from pages and pages from documents, with character spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assemble(pages: DataFrame, key: str, page: str = "page", text: str = "text", totals: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: text, spans (start, end, page) and totals.

    Pages join in page order.  A null page adds neither text nor a line end; every
    other page but the last ends with one.  Documents without text are dropped.
    The pages of one document meet in one task, so a document must fit there.
    """
    totals = totals or {}
    grouped = pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(page).alias("page"), F.col(text).alias("text")))).alias("p"), F.count(F.lit(1)).alias("pages"), *[c.alias(n) for n, c in totals.items()])
    last = F.element_at("p", -1)["page"]
    part = lambda x: F.when(x["text"].isNull(), "").when(x["page"] == last, x["text"]).otherwise(F.concat(x["text"], F.lit("\n")))
    grouped = grouped.withColumn("parts", F.transform("p", part))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,page:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["part"])
        span = F.struct(acc["at"].alias("start"), end.alias("end"), x["page"].cast("long").alias("page"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    both = F.zip_with("p", "parts", lambda a, b: F.struct(a["page"].alias("page"), b.alias("part")))
    out = grouped.select(key, F.array_join("parts", "").alias("text"), F.aggregate(both, zero, step)["spans"].alias("spans"), "pages", *totals)
    return out.where(F.length("text") > 0)


def explode_pages(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Pages of documents: every span's page number and text, beside the other columns."""
    rows = docs.select("*", F.posexplode(spans).alias("page_index", "span"))
    body = F.substring(F.col(text), (F.col("span.start") + 1).cast("int"), (F.col("span.end") - F.col("span.start")).cast("int"))
    return rows.withColumn("page", F.col("span.page")).withColumn("page_text", body).drop(text, spans, "span")


def running_offsets(pages: DataFrame, key: str, page: str, length: Column) -> DataFrame:
    """Pages with the half-open span that they take in their document."""
    before = Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length).over(before), F.lit(0))
    return pages.withColumn("start", start).withColumn("end", start + length)


def aligned(values: Column, index: Column, default: Column) -> Column:
    """The value at a page's index, or the default where the array is short or null."""
    return F.coalesce(F.get(values, index), default)


def workspace_statistics(docs: DataFrame, tokens: str, pages: str, fallback: str, originals: Column, long_context: int = 32768) -> DataFrame:
    """One row of totals over processed documents, as a partial and a final aggregate."""
    t = F.col(tokens)
    n = F.count(F.lit(1))
    each = lambda c: c / F.greatest(n, F.lit(1))
    return docs.agg(
        n.alias("docs"),
        F.sum(t).alias("tokens"),
        F.sum(pages).alias("pages"),
        F.sum(fallback).alias("fallback"),
        F.count_if(t > long_context).alias("long_docs"),
        F.coalesce(F.sum(F.when(t > long_context, t)), F.lit(0)).alias("long_tokens"),
        (originals - n).alias("skipped"),
        F.round(each(F.sum(t)), 4).alias("tokens_each"),
        F.round(each(F.sum(pages)), 4).alias("pages_each"),
    )


def pii_flag(public: Column, sensitive: Column, identifier: Column, linked: Column) -> Column:
    """Public documents have none; sensitive ones do; else an identifier with linked facts does.  Null counts as false."""
    on = lambda c: F.coalesce(c, F.lit(False))
    return F.when(on(public), False).otherwise(on(sensitive) | (on(identifier) & on(linked)))


def flag_names(flags: dict[str, Column]) -> Column:
    """The names of the flags that are set, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))


def first_true(cases: dict[str, Column], other: str) -> Column:
    """The first bucket whose condition holds."""
    out = F.when(F.lit(False), F.lit(other))
    for name, condition in cases.items():
        out = out.when(condition, name)
    return out.otherwise(other)


def coerce_bool(value: Column) -> Column:
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("true", "1", "yes", "y"), True).when(v.isin("false", "0", "no", "n"), False)


def coerce_rotation(value: Column) -> Column:
    v = F.try_cast(value, "int") if hasattr(F, "try_cast") else value.try_cast("int")
    return F.when(v.isin(0, 90, 180, 270), v).otherwise(0)


def default_response(language: Column, valid: Column, rotation: Column, table: Column, diagram: Column, text: Column) -> Column:
    """A response with its defaults; a language that is a boolean is none."""
    blank = F.nullif(F.trim(text), F.lit(""))
    return F.struct(
        F.when(F.lower(language).isin("true", "false"), None).otherwise(language).alias("primary_language"),
        F.coalesce(valid, F.lit(True)).alias("is_rotation_valid"),
        F.coalesce(rotation, F.lit(0)).alias("rotation_correction"),
        F.coalesce(table, F.lit(False)).alias("is_table"),
        F.coalesce(diagram, F.lit(False)).alias("is_diagram"),
        F.when(blank.isNotNull(), text).alias("natural_text"),
    )


def cost_per_million(dollars_an_hour: Column, pages_a_second: Column) -> Column:
    return dollars_an_hour / (pages_a_second * 3600) * 1_000_000
