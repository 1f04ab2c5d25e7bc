"""Attribute values that keep their type: booleans, numbers, texts and nulls side by side, as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.operators import rules as R

SPANS = "array<struct<start:bigint,end:bigint,value:variant>>"


def spans(column: Column, name: str) -> Column:
    """The spans [start, end, value] of one attribute of a JSON text.

    What is no JSON, lacks the attribute, or is no list has none; nor do entries that are no list of
    three and more.  A JSON null is a null value.
    """
    path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    entries = F.try_variant_get(F.try_parse_json(column), path, "array<variant>")
    three = F.filter(F.transform(F.coalesce(entries, F.array().cast("array<variant>")), lambda e: F.try_variant_get(e, "$", "array<variant>")), lambda e: F.size(e) >= 3)
    value = lambda e: F.when(~F.is_variant_null(F.get(e, F.lit(2))), F.get(e, F.lit(2)))
    at = lambda e, k: F.try_variant_get(F.get(e, F.lit(k)), "$", "bigint")
    return F.transform(three, lambda e: F.struct(at(e, 0).alias("start"), at(e, 1).alias("end"), value(e).alias("value")))


def kind(value: Column) -> Column:
    """boolean, number, text, list or object; null for none."""
    name = F.schema_of_variant(value)
    return F.when(name == "BOOLEAN", "boolean").when(name == "STRING", "text").when(name.startswith("ARRAY"), "list").when(name.startswith("OBJECT"), "object").when(name != "VOID", "number")


def truth(value: Column) -> Column:
    """Whether a value holds: true, a number but 0, a text, list or object that is not empty."""
    text = F.try_variant_get(value, "$", "string")
    return F.coalesce(
        F.when(kind(value) == "boolean", F.try_variant_get(value, "$", "boolean"))
        .when(kind(value) == "number", F.try_variant_get(value, "$", "double") != 0)
        .when(kind(value) == "text", F.length(text) > 0)
        .when(kind(value) == "list", text != "[]")
        .when(kind(value) == "object", text != "{}"),
        F.lit(False),
    )


def number(value: Column) -> Column:
    """A number, a boolean as 1 or 0, a text that spells a number; else null."""
    return F.when(kind(value) == "boolean", F.try_variant_get(value, "$", "boolean").cast("double")).when(kind(value).isin("number", "text"), F.try_variant_get(value, "$", "string").try_cast("double"))


def _leaf(column: Column, leaf: R.Leaf) -> Column:
    values = F.filter(F.transform(spans(column, leaf.attribute), lambda s: s["value"]), lambda v: v.isNotNull())
    if leaf.kind == "any":
        out = F.exists(values, truth)
    elif leaf.kind == "all":
        out = (F.size(values) > 0) & F.forall(values, truth)
    else:  # one value that is no number makes the mean unknown
        numbers = F.transform(values, number)
        mean = F.when(F.forall(numbers, lambda v: v.isNotNull()), F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(numbers), F.lit(0)))
        out = {"avg>": mean > leaf.bound, "avg<": mean < leaf.bound, "avg==": mean == leaf.bound, "avg>=": mean >= leaf.bound, "avg<=": mean <= leaf.bound}[leaf.kind]
    return F.coalesce(out, F.lit(False))


def compile_rule(rule: str | R.Leaf | R.Node, column: Column) -> Column:
    """An attribute rule as a boolean Column over a JSON text of attributes with values of any type."""
    tree = R.parse(rule) if isinstance(rule, str) else rule
    if isinstance(tree, R.Leaf):
        return _leaf(column, tree)
    parts = [compile_rule(p, column) for p in tree.parts]
    return ~parts[0] if tree.op == "not" else parts[0] & parts[1] if tree.op == "and" else parts[0] | parts[1]


def value_kinds(docs: DataFrame, column: str, names: list[str]) -> DataFrame:
    """(attribute, schema, entries): the type that holds all values of each attribute, and how many there are."""
    out = [docs.select(F.lit(n).alias("attribute"), F.explode(spans(F.col(column), n)).alias("s")).select("attribute", "s.value") for n in names]
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("attribute").agg(F.schema_of_variant_agg("value").alias("schema"), F.count(F.lit(1)).alias("entries"))
