"""A benchmark of page tests: tests of all types run on what candidates made of the pages, pass rates and their intervals.

A test belongs to a page and has a type, which says which of its fields count:

* ``present``, ``absent``: ``text``, with ``max_diffs``, ``case_sensitive``, ``first_n`` and ``last_n``;
* ``order``: ``before`` and ``after`` with ``max_diffs``;
* ``table``: ``cell`` and its neighbours ``up``, ``down``, ``left``, ``right``, ``top_heading``, ``left_heading``;
* ``math``: ``math`` is one of the page's equations, as written (nothing is rendered here);
* ``baseline``: the page has text, does not repeat itself at its end and holds no odd characters, or, with ``max_length``, is blank.

Outputs meet the tests of their page, all at once, so that a page is read and folded once.  Repeats
of a page are averaged.  A page that a candidate lacks fails all its tests; such failures are the
difference to the number of tests and never written out.

Defined results: unknown types and tests without the field that their type needs fail, with
an explanation.  Null texts are empty.  Tests without a page or id, and outputs without
a page, are dropped; tests that share an id in a category count as one, by their mean.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions import fuzzy as Z
from docflow.functions import tables as G
from docflow.functions import text as X
from docflow.operators import filters as P
from docflow.operators.scratch import written

FIELDS = {
    "category": "string", "type": "string", "text": "string", "max_diffs": "int", "case_sensitive": "boolean", "first_n": "int", "last_n": "int", "before": "string", "after": "string", "cell": "string", "up": "string", "down": "string",
    "left": "string", "right": "string", "top_heading": "string", "left_heading": "string", "math": "string", "ignore_dollar_delimited": "boolean", "max_length": "int", "max_repeats": "int",
}
NEAR = ("up", "down", "left", "right", "top_heading", "left_heading")
#: Types that need the page's text in Python.
TEXTUAL = ("present", "absent", "order", "table")
#: Different outputs of a page whose results are held.
_ALIKE = 16
_RESULT = "candidate string, category string, id string, passed boolean, explanation string"


def _presence(test: dict, body: str, explain: bool) -> tuple[bool, str]:
    query = Z.normalize(test["text"]) or ""
    if not query.strip():
        return False, "no text to look for"
    # Case counts unless the test says that it does not.
    if test["case_sensitive"] is False:
        query, body = query.lower(), body.lower()
    first, last = test["first_n"], test["last_n"]
    if first and last:
        body = body[:first] + body[-last:]
    elif first or last:
        body = body[:first] if first else body[-last:]
    most = test["max_diffs"] or 0
    if Z.holds(query, body, most) == (test["type"] == "present"):
        return True, ""
    return False, f"{test['type']}: best match {Z.partial_ratio(query, body):.3f} against {1 - most / len(query):.3f}" if explain else test["type"]


def _order(test: dict, body: str) -> tuple[bool, str]:
    before, after, most = Z.normalize(test["before"]) or "", Z.normalize(test["after"]) or "", test["max_diffs"] or 0
    if not before.strip() or not after.strip() or most > min(len(before), len(after)) // 2:
        return False, "order: a text is missing or too short for its differences"
    one = Z.near_start(before, body, most)
    two = None if one is None else Z.near_start(after, body, most, last=True)
    if one is None or two is None:
        return False, f"order: {'before' if one is None else 'after'} not found"
    return (True, "") if one < two else (False, "order: only the other way round")


def _table(test: dict, text: str) -> tuple[bool, str]:
    if not (test["cell"] or "").strip():
        return False, "table: no cell to look for"
    near = {k: Z.normalize(test[k]) for k in NEAR if test[k]}
    return (True, "") if G.table_test(text, Z.normalize(test["cell"]), test["max_diffs"] or 0, **near) else (False, "table: no such cell")


def _tests(column: pa.ListArray) -> Iterator[list[dict]]:
    """The tests of each row, read field by field."""
    rows = column.flatten()
    names = [f.name for f in rows.type]
    values = [[None] * len(x) if x.null_count == len(x) else x.to_pylist() for x in rows.flatten()]
    tests = iter([dict(zip(names, v, strict=True)) for v in zip(*values, strict=True)])
    for size in pc.list_value_length(column).to_pylist():
        yield [next(tests) for _ in range(size)]


def _textual(explain: bool):
    def judged(text: str, tests: list[dict]) -> list[tuple]:
        body, out = Z.normalize(text), []
        for test in tests:
            passed, why = _table(test, text) if test["type"] == "table" else _order(test, body) if test["type"] == "order" else _presence(test, body, explain)
            out.append((test["category"], test["id"], passed, why))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Outputs of a page follow each other mostly; of those that are alike one is judged.
        page: list[dict] | None = None
        held: dict[str, list[tuple]] = {}
        for batch in batches:
            out: list[tuple] = []
            for candidate, md, tests in zip(batch.column(0).to_pylist(), batch.column(1), _tests(batch.column(2)), strict=True):
                if tests != page:
                    page, held = tests, {}
                text = md.as_py() or ""
                if text not in held:
                    if len(held) >= _ALIKE:
                        held.clear()
                    held[text] = judged(text, tests)
                out += [(candidate, *x) for x in held[text]]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["candidate", "category", "id", "passed", "explanation"])

    return run


def complete(tests: DataFrame) -> DataFrame:
    """Tests with all fields of all types, null where they are not given."""
    own = {k: F.col(k).cast(kind) if k in tests.columns else F.lit(None).cast(kind) for k, kind in FIELDS.items()}
    own["category"] = F.coalesce(own["category"], own["type"])
    return tests.where("pdf IS NOT NULL AND page IS NOT NULL AND id IS NOT NULL").select("pdf", "page", F.col("id").cast("string").alias("id"), *[v.alias(k) for k, v in own.items()])


def run_tests(tests: DataFrame, outputs: DataFrame, explain: bool = True) -> DataFrame:
    """(candidate, category, id, passed, explanation) for each test (pdf, page, id, type, ...) on each output (candidate, pdf, page, md).

    Without ``explain`` failed presence tests do not say how close the best match is, which takes a whole text to find.
    """
    own = complete(tests)
    pages = outputs.select("candidate", "pdf", "page", F.coalesce("md", F.lit("")).alias("md"))
    text = own.where(F.col("type").isin(*TEXTUAL)).groupBy("pdf", "page").agg(F.collect_list(F.struct("id", *FIELDS)).alias("tests"))
    done = pages.join(text, ["pdf", "page"]).select("candidate", "md", "tests").mapInArrow(_textual(explain), _RESULT)
    rest = pages.join(own.where(~F.coalesce(F.col("type").isin(*TEXTUAL), F.lit(False))), ["pdf", "page"])
    dollars = X.harvest_equations(F.col("md"))
    without = X.harvest_equations(F.col("md"), dollars=False)
    math = F.array_contains(F.when(F.coalesce("ignore_dollar_delimited", F.lit(False)), without).otherwise(dollars), F.trim("math"))
    failure = P.baseline_failure(F.col("md"), F.col("max_length"))
    why = F.when(F.col("type") == "math", F.when(F.length(F.trim("math")) > 0, F.when(~math, "math: no such equation")).otherwise("math: no equation to look for")).when(F.col("type") == "baseline", failure).otherwise("unknown type")
    rest = rest.withColumn("explanation", why).select("candidate", "category", "id", F.col("explanation").isNull().alias("passed"), F.coalesce("explanation", F.lit("")).alias("explanation"))
    return done.unionByName(rest)


def _weighted(replicates: int, seed: int):
    """Per group and replicate, the sum of value times a Poisson(1) weight that hangs on the test's id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            # A batch's tests by place, and the scores of each group by the places of their tests.
            tests: dict[tuple[str, str], int] = {}
            scores: dict[tuple, list[tuple[int, float]]] = {}
            for own, candidate, category, key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if value:
                    scores.setdefault((own, candidate, category), []).append((tests.setdefault((category, key), len(tests)), value))
            weights = np.empty((len(tests), replicates))
            for (category, key), k in tests.items():
                weights[k] = np.random.default_rng([seed, zlib.crc32(f"{category}\0{key}".encode())]).poisson(1.0, replicates)
            for group, own in scores.items():
                places, values = zip(*own, strict=True)
                sums[group] = sums.get(group, 0.0) + np.array(values) @ weights[list(places)]
        for (own, candidate, category), total in sums.items():
            columns = [pa.array([own] * replicates, pa.bool_()), pa.array([candidate] * replicates, pa.string()), pa.array([category] * replicates, pa.string()), pa.array(range(replicates), pa.int32()), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["own", "candidate", "category", "replicate", "total"])

    return run


def report(tests: DataFrame, results: DataFrame, candidates: DataFrame, replicates: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(candidate, category, tests, rate, low, high): pass rates by category and ``overall``, the mean of those.

    ``low`` and ``high`` bound the overall rate: tests are resampled within categories by Poisson
    weights drawn where a test lies, so sums alone are shuffled, whatever scores there are.
    """
    # Tests stand among the scores as rows of their own, and all rows of a test in one task and together, so that
    # its weights are drawn once.  Rates and draws read them from a table: results would else be made twice.
    own = complete(tests).select(F.lit(True).alias("own"), F.lit(None).cast("string").alias("candidate"), "category", "id", F.lit(True).alias("passed"))
    given = results.select(F.lit(False).alias("own"), "candidate", "category", "id", "passed").unionByName(own)
    scores = given.repartition("category", "id").groupBy("own", "candidate", "category", "id").agg(F.avg(F.col("passed").cast("double")).alias("score"))
    scores = written(scores.sortWithinPartitions("category", "id"), "bench-scores")
    sizes = scores.where("own").groupBy("category").agg(F.count(F.lit(1)).alias("tests"))
    sums = scores.where("NOT own").groupBy("candidate", "category").agg(F.sum("score").alias("got"))
    grid = candidates.select("candidate").distinct().join(sizes.agg(F.collect_list(F.struct("category", "tests")).alias("s"))).select("candidate", F.inline("s"))
    rates = grid.join(sums, ["candidate", "category"], "left").select("candidate", "category", "tests", (F.coalesce("got", F.lit(0.0)) / F.col("tests")).alias("rate"))
    # Weights of all tests of a category, and of the scores of each candidate in it: a few rows a category and replicate.
    layout = "own boolean, candidate string, category string, replicate int, total double"
    weighted = scores.select("own", "candidate", "category", "id", "score").mapInArrow(_weighted(replicates, seed), layout)
    totals = written(weighted.groupBy("own", "candidate", "category", "replicate").agg(F.sum("total").alias("total")), "bench-draws")
    mass = totals.where("own").select("category", "replicate", F.col("total").alias("mass"))
    drawn = totals.where("NOT own").select("candidate", "category", "replicate", F.col("total").alias("drawn"))
    asked = candidates.select("candidate").distinct().join(mass)  # a row a candidate, category and replicate
    means = asked.join(drawn, ["candidate", "category", "replicate"], "left").where("mass > 0").groupBy("candidate", "replicate").agg(F.avg(F.coalesce("drawn", F.lit(0.0)) / F.col("mass")).alias("mean"))
    tail = (1 - level) / 2
    bounds = means.groupBy("candidate").agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))
    overall = rates.groupBy("candidate").agg(F.sum("tests").alias("tests"), F.avg("rate").alias("rate")).join(bounds, "candidate")
    none: Column = F.lit(None).cast(T.DoubleType())
    return rates.select("candidate", "category", "tests", "rate", none.alias("low"), none.alias("high")).unionByName(overall.select("candidate", F.lit("overall").alias("category"), "tests", "rate", "low", "high"))
