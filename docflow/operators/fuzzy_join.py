"""Which texts hold which passages up to some differences: a join of passages with whole texts.

A passage that may differ in ``k`` places is cut into ``k + 1`` pieces; in a text that holds it,
one piece stands exactly.  A piece is looked up by its first characters, 16 or the highest power
of two that it has.  Hashes of those *grams* set a map of bits of fixed size; a text's own grams,
at every place, are held against the map where the text lies, and only those that may be some
piece's are joined with the pieces.  A hit gives a passage, a text and a place; the text is read
again around such places alone to decide.

Two ways to differ:

* ``presence``: windows of the passage's length, cut at the text's ends, agree in a common
  subsequence of at least ``1 - diffs / length`` of the mean of both lengths.  Up to ``diffs``
  characters of either side have no partner, so ``k`` is twice ``diffs``.
* ``near``: parts of the text within an edit distance of ``diffs``, the best of each run of
  overlapping ones; ``k`` is ``diffs``.

Texts and passages are folded alike (marks, white space, quotes, NFC) and lower-cased unless a
passage is ``cased``.  ``first_n`` and ``last_n`` restrict a passage to that many characters at
the text's front and end (both: the two joined).

Defined results: a passage that is null or without visible characters, or whose ``diffs`` leave a piece no
character (or are null or negative), is in no text; nor is any passage in a null text.  Texts of one key are one
document: it holds what any of them holds.  Null keys are one key.  Repeated passages have
their own key each; of passages that share a key, each counts.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from docflow.functions import fuzzy as Z
from docflow.operators.bits import bit_map, in_map

#: Characters of a gram, and bits of the map as a power of two (2 MB).
GRAMS = (16, 8, 4, 2, 1)
MAP_BITS = 24
#: Combinations of ``cased``, ``first_n`` and ``last_n`` that one join may have: each reads the texts in its own way.
OPTIONS = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(text: str, sizes: set[int]) -> dict[int, np.ndarray]:
    """For each size, the hashes of the grams at all places of ``text``, as longs.

    The hash of twice as many characters comes from two of those before.
    """
    own = _mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    out, size, power = {}, 1, _BASE
    while own.size and size <= max(sizes, default=0):
        if size in sizes:
            out[size] = _mixed(own + np.uint64(size)).view(np.int64)
        own = own[: len(own) - size] * power + own[size:] if len(own) > size else own[:0]
        size, power = 2 * size, power * power
    return out


def viewed(text: str | None, cased: bool, first_n: int | None, last_n: int | None) -> str:
    """What of a text a passage is looked for in."""
    text = Z.normalize(text) or ""
    text = text if cased else text.lower()
    if first_n and last_n:
        return text[:first_n] + text[-last_n:]
    return text[:first_n] if first_n else text[-last_n:] if last_n else text


def _pieces(passage: str, k: int) -> tuple[int, list[int]]:
    """The gram's size and where the pieces begin; size 0 if some piece would be empty."""
    n = len(passage)
    least = n // (k + 1)
    return next((g for g in GRAMS if g <= least), 0), [i * n // (k + 1) for i in range(k + 1)]


def _probes(near: bool):
    """A row for each piece of a passage: its gram, and where in the passage it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                rows: list[tuple] = []
                for key, text, diffs, cased, first_n, last_n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    passage = Z.normalize(text) or ""
                    passage = passage if cased else passage.lower()
                    if diffs is None or diffs < 0 or not passage.strip():
                        continue
                    size, places = _pieces(passage, diffs if near else 2 * diffs)
                    hashes = gram_hashes(passage, {size}).get(size, ()) if size else ()
                    rows += [(key, passage, diffs, bool(cased), first_n, last_n, size, at, int(hashes[at])) for at in places if size]
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), kind) for v, kind in zip(zip(*rows[lo : lo + 10_000], strict=True), kinds, strict=True)], names)

    kinds = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    names = ["needle", "passage", "diffs", "cased", "first_n", "last_n", "size", "at", "gram"]
    return run


_PROBE = "needle string, passage string, diffs int, cased boolean, first_n int, last_n int, size int, at int, gram long"


def _hits(options: list[tuple], words: np.ndarray, key: StructField):
    """A row for each place of a text whose gram may be some piece's."""
    schema = to_arrow_schema(StructType([key, StructField("option", IntegerType()), StructField("size", IntegerType()), StructField("gram", LongType()), StructField("place", IntegerType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for k, text in enumerate(batch.column(1)):
                    for o, (cased, first_n, last_n, sizes) in enumerate(options):
                        for size, grams in gram_hashes(viewed(text.as_py(), cased, first_n, last_n), sizes).items():
                            at = np.flatnonzero(in_map(grams, words))
                            if len(at):
                                fixed = [pa.repeat(batch.column(0)[k], len(at)), *(pa.array(np.full(len(at), x, np.int32)) for x in (o, size))]
                                yield pa.RecordBatch.from_arrays([*fixed, pa.array(grams[at]), pa.array(at.astype(np.int32))], schema=schema)

    return run


def present(passage: str, body: str, diffs: int, places: list[int]) -> bool:
    """Whether a window that begins near one of ``places`` holds the passage."""
    m = len(passage)
    if not diffs:
        return any(body.startswith(passage, p) for p in places if p >= 0)
    done: set[int] = set()
    for place in sorted(set(places)):
        for start in range(max(place - 4 * diffs, 1 - m), min(place + 4 * diffs, len(body) - 1) + 1):
            if start not in done:
                done.add(start)
                window = body[max(start, 0) : start + m]
                if 2 * Z.lcs_length(passage, window) * m >= (m - diffs) * (m + len(window)):
                    return True
    return False


def near_starts(passage: str, body: str, diffs: int, places: list[int]) -> list[int]:
    """Where the best places of the passage around ``places`` begin."""
    reach = len(passage) + 2 * diffs
    spans = [[max(p - reach, 0), p + len(passage) + reach] for p in sorted(set(places))]
    for a, b in pairwise(range(len(spans))):
        if spans[b][0] <= spans[a][1]:  # overlapping surroundings are one
            spans[b][0] = spans[a][0]
            spans[a] = []
    return [lo + start for lo, hi in filter(None, spans) for start, _, _ in Z.near_matches(passage, body[lo:hi], diffs)]


def _decided(options: list[tuple], near: bool, key: StructField):
    schema = to_arrow_schema(StructType([StructField("needle", StringType()), key, StructField("first", IntegerType()), StructField("last", IntegerType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, asked in zip(*(batch.column(k) for k in range(3)), strict=True):
                bodies: dict[int, str] = {}
                for a in asked.as_py():
                    o = a["option"]
                    if o not in bodies:
                        bodies[o] = viewed(text.as_py(), *options[o][:3])
                    if near:
                        starts = near_starts(a["passage"], bodies[o], a["diffs"], a["places"])
                        if starts:
                            out.append((a["needle"], doc.as_py(), min(starts), max(starts)))
                    elif present(a["passage"], bodies[o], a["diffs"], a["places"]):
                        out.append((a["needle"], doc.as_py(), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)

    return run


def fuzzy_join(passages: DataFrame, key: str, docs: DataFrame, doc_key: str, text: str = "text", near: bool = False) -> DataFrame:
    """(key, doc_key) where the document holds the passage; with ``near`` also its first and last place.

    ``passages`` has the key, ``text`` and ``diffs``, and may have ``cased``, ``first_n`` and ``last_n``.
    """
    has = lambda name, kind: F.col(name).cast(kind) if name in passages.columns else F.lit(None).cast(kind)
    asked = passages.select(F.to_json(F.struct(F.col(key).alias("k"))).alias("needle"), F.col("text").cast("string"), F.col("diffs").cast("int"), has("cased", "boolean").alias("cased"), has("first_n", "int").alias("first_n"), has("last_n", "int").alias("last_n"))
    probes = asked.mapInArrow(_probes(near), _PROBE)
    probes = probes.withColumn("cased", F.coalesce("cased", F.lit(False)))
    kinds = probes.groupBy("cased", "first_n", "last_n").agg(F.collect_set("size").alias("sizes")).limit(OPTIONS + 1).collect()
    if len(kinds) > OPTIONS:
        raise ValueError(f"passages have more than {OPTIONS} combinations of cased, first_n and last_n")
    options = [(r["cased"], r["first_n"], r["last_n"], set(r["sizes"])) for r in kinds]
    number = F.lit(None).cast("int")
    for o, (cased, first_n, last_n, _) in enumerate(options):
        number = F.when((F.col("cased") == cased) & F.col("first_n").eqNullSafe(F.lit(first_n)) & F.col("last_n").eqNullSafe(F.lit(last_n)), o).otherwise(number)
    probes = probes.select("needle", "passage", "diffs", number.alias("option"), "size", "at", "gram")
    field = StructField("doc", docs.schema[doc_key].dataType)
    texts = docs.select(F.col(doc_key).alias("doc"), F.col(text).cast("string").alias("body"))
    words = bit_map(probes.select("gram"), MAP_BITS)
    hits = texts.mapInArrow(_hits(options, words, field), StructType([field, StructField("option", IntegerType()), StructField("size", IntegerType()), StructField("gram", LongType()), StructField("place", IntegerType())]))
    found = hits.join(probes, ["option", "size", "gram"])
    places = found.groupBy("doc", "needle", "passage", "diffs", "option").agg(F.collect_set(F.col("place") - F.col("at")).alias("places"))
    own = places.groupBy("doc").agg(F.collect_list(F.struct("needle", "passage", "diffs", "option", "places")).alias("asked")).withColumnRenamed("doc", "d")
    rows = texts.join(own, F.col("doc").eqNullSafe(F.col("d"))).select("doc", "body", "asked")
    schema = StructType([StructField("needle", StringType()), field, StructField("first", IntegerType()), StructField("last", IntegerType())])
    decided = rows.mapInArrow(_decided(options, near, field), schema).groupBy("needle", "doc").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    back = F.from_json("needle", StructType([StructField("k", passages.schema[key].dataType)]))["k"].alias(key)
    return decided.select(back, F.col("doc").alias(doc_key), *(["first", "last"] if near else []))


def order_join(tests: DataFrame, key: str, docs: DataFrame, doc_key: str, text: str = "text") -> DataFrame:
    """(key, doc_key) where ``before`` stands in front of ``after``, both up to ``diffs`` edits.

    Some place of ``before`` begins ahead of some place of ``after``.  Texts are compared with
    case.  Tests whose ``diffs`` exceed half of either passage are none.
    """
    half = lambda name: F.length(F.col(name)) / 2 >= F.col("diffs")
    rows = tests.where(half("before") & half("after"))
    sides = [
        fuzzy_join(rows.select(key, F.col(side).alias("text"), "diffs", F.lit(True).alias("cased")), key, docs, doc_key, text, near=True).toDF(f"{side}_key", f"{side}_doc", f"{side}_first", f"{side}_last")
        for side in ("before", "after")
    ]
    both = F.col("before_key").eqNullSafe(F.col("after_key")) & F.col("before_doc").eqNullSafe(F.col("after_doc")) & (F.col("before_first") < F.col("after_last"))
    return sides[0].join(sides[1], both).select(F.col("before_key").alias(key), F.col("before_doc").alias(doc_key))
