"""A small rule language over span attributes that compiles to one Column.

``attr:any``, ``attr:all`` and ``attr:avg>0.5`` (also ``<``, ``==``, ``>=``,
``<=``) joined by and, or, not and parentheses; not binds tightest, then and.
Values are two-valued: a missing attribute is false, so its ``not`` is true, and
``all`` over no values is false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\()|(\))|([\w.\-]+):(any|all|avg\s*(?:>=|<=|==|>|<)\s*[-+]?[\d.]+)|(and|or|not)\b)", re.IGNORECASE)


@dataclass(frozen=True)
class Leaf:
    attribute: str
    kind: str
    bound: float | None = None

    def __str__(self) -> str:
        return f"{self.attribute}:{self.kind}" + ("" if self.bound is None else f"{self.bound:g}")


@dataclass(frozen=True)
class Node:
    op: str
    parts: tuple

    def __str__(self) -> str:
        return f"not {self.parts[0]}" if self.op == "not" else f"({f' {self.op} '.join(map(str, self.parts))})"


def tokens(rule: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    at = 0
    while rule[at:].strip():
        m = _TOKEN.match(rule, at)
        if not m:
            raise ValueError(f"unexpected text at {at}: {rule[at:]!r}")
        if m[1] or m[2]:
            out.append((m[1] or m[2], None))
        elif m[5]:
            out.append((m[5].lower(), None))
        else:
            kind = m[4].lower().replace(" ", "")
            bound = re.fullmatch(r"(avg(?:>=|<=|==|>|<))(.+)", kind)
            out.append(("leaf", Leaf(m[3], bound[1], float(bound[2])) if bound else Leaf(m[3], kind)))
        at = m.end()
    return out


def parse(rule: str) -> Leaf | Node:
    """The rule's tree; ValueError for anything that is not a rule."""
    rest = tokens(rule)[::-1]

    def take(*kinds: str) -> tuple[str, object] | None:
        return rest.pop() if rest and rest[-1][0] in kinds else None

    def primary() -> Leaf | Node:
        if take("not"):
            return Node("not", (primary(),))
        if take("("):
            inner = level("or")
            if not take(")"):
                raise ValueError("a parenthesis is not closed")
            return inner
        if leaf := take("leaf"):
            return leaf[1]
        raise ValueError("a rule ends too early" if not rest else f"unexpected {rest[-1][0]!r}")

    def level(op: str) -> Leaf | Node:
        below = primary if op == "and" else lambda: level("and")
        out = below()
        while take(op):
            out = Node(op, (out, below()))
        return out

    found = level("or")
    if rest:
        raise ValueError(f"unexpected {rest[-1][0]!r}")
    return found


def leaves(rule: Leaf | Node) -> list[Leaf]:
    """Distinct leaves in order."""
    found = [rule] if isinstance(rule, Leaf) else [x for p in rule.parts for x in leaves(p)]
    return list(dict.fromkeys(found))


def _values(attributes: Column, leaf: Leaf) -> Column:
    """Non-null span values as doubles; booleans count 1 and 0."""
    spans = F.coalesce(F.try_element_at(attributes, F.lit(leaf.attribute)), F.array().cast("array<struct<start:bigint,end:bigint,value:double>>"))
    return F.filter(F.transform(spans, lambda s: s["value"].cast("double")), lambda v: v.isNotNull())


def leaf_column(attributes: Column, leaf: Leaf) -> Column:
    values = _values(attributes, leaf)
    if leaf.kind == "any":
        out = F.exists(values, lambda v: v != 0)
    elif leaf.kind == "all":
        out = (F.size(values) > 0) & F.forall(values, lambda v: v != 0)
    else:
        mean = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.nullif(F.size(values), F.lit(0))
        bound = F.lit(leaf.bound)
        out = {"avg>": mean > bound, "avg<": mean < bound, "avg==": mean == bound, "avg>=": mean >= bound, "avg<=": mean <= bound}[leaf.kind]
    return F.coalesce(out, F.lit(False))


def compile_rule(rule: str | Leaf | Node, attributes: Column) -> Column:
    """The rule as a boolean Column over a map of span arrays."""
    tree = parse(rule) if isinstance(rule, str) else rule
    if isinstance(tree, Leaf):
        return leaf_column(attributes, tree)
    parts = [compile_rule(p, attributes) for p in tree.parts]
    return ~parts[0] if tree.op == "not" else parts[0] & parts[1] if tree.op == "and" else parts[0] | parts[1]


def leaf_statistics(docs: DataFrame, rule: str, attributes: str = "attributes") -> DataFrame:
    """For each leaf: span entries, entries that are exactly true (1), documents matched."""
    rows = []
    for leaf in leaves(parse(rule)):
        spans = F.coalesce(F.size(F.try_element_at(F.col(attributes), F.lit(leaf.attribute))), F.lit(0))
        positive = F.size(F.filter(_values(F.col(attributes), leaf), lambda v: v == 1))
        rows.append(F.struct(F.lit(str(leaf)).alias("leaf"), F.sum(F.greatest(spans, F.lit(0))).cast("long").alias("entries"), F.sum(positive).cast("long").alias("positive"), F.count_if(leaf_column(F.col(attributes), leaf)).alias("matched")))
    return docs.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def confusion(docs: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """tp, tn, fp, fn, precision, recall, f1 and iou; ratios over nothing are 0."""
    counts = docs.select(truth.alias("t"), guess.alias("g")).agg(
        F.count_if(F.col("t") & F.col("g")).alias("tp"), F.count_if(~F.col("t") & ~F.col("g")).alias("tn"), F.count_if(~F.col("t") & F.col("g")).alias("fp"), F.count_if(F.col("t") & ~F.col("g")).alias("fn")
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("iou", ratio(tp, tp + fp + fn))
