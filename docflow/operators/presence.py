"""Which texts hold which passages or runs of words: looked up in the text's own row, then compared whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from docflow.functions import text as T
from docflow.operators.bits import bit_map, in_map
from docflow.operators.fuzzy_join import GRAMS, gram_hashes

#: Words of a run that is looked up.
RUN = 8
#: Bits of the map of what is looked up, as a power of two (2 MB).
MAP_BITS = 24


def _let(value: Column, body) -> Column:
    """Bind a value: Catalyst would else evaluate it anew for every element of a lambda that uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def run_hashes(words: Column, run: int = RUN) -> Column:
    """Two hashes of every run of words, as structs; none where there are fewer words.

    Words are hashed once, and runs from those hashes, so no run is written out as text.
    """

    def of(h: Column) -> Column:
        here = lambda i: [F.get(h, i + k) for k in range(run)]
        both = lambda i: F.struct(F.xxhash64(*here(i)).alias("h1"), F.xxhash64(F.lit(run), *here(i)).alias("h2"))
        return F.when(F.size(h) >= run, F.transform(F.sequence(F.lit(0), F.size(h) - run), both)).otherwise(F.array().cast("array<struct<h1:bigint,h2:bigint>>"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def kept_runs(rows: DataFrame, key: str, runs: Column, words: np.ndarray) -> DataFrame:
    """(key, h): the runs of each row whose bits the map has.  Runs that nobody asks for stay in their row."""
    kind = rows.schema[key]
    schema = StructType([kind, *StructType.fromDDL("h struct<h1:bigint,h2:bigint>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten()
            if len(flat):
                at = np.flatnonzero(in_map(flat.field(0).to_numpy(zero_copy_only=False), words))
                owner = np.repeat(np.arange(len(sizes)), sizes)[at]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), flat.take(pa.array(at)).cast(arrow.field(1).type)], schema=arrow)

    return rows.select(key, runs.alias("runs")).mapInArrow(run, schema)


def shared_runs(docs: DataFrame, key: str, asked: DataFrame, run: int = RUN, text: str = "text") -> DataFrame:
    """(key, h): every place of a document where a run of ``run`` words stands that ``asked`` (text) has too."""
    own = asked.select(F.explode(run_hashes(T.words(F.col("text")), run)).alias("h")).distinct()
    words = bit_map(own.select("h.h1"), MAP_BITS)
    return kept_runs(docs, key, run_hashes(T.words(F.col(text)), run), words).join(own, "h", "left_semi")


def _grams(key: StructField, words: np.ndarray, sizes: set[int]):
    """The distinct grams of each text that some passage may begin with."""
    arrow = to_arrow_schema(StructType([key, *StructType.fromDDL("size int, gram long").fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for k, text in enumerate(batch.column(1)):
                    for size, grams in gram_hashes(text.as_py() or "", sizes).items():
                        found = np.unique(grams[in_map(grams, words)])
                        if len(found):
                            yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(found)), pa.array(np.full(len(found), size, np.int32)), pa.array(found)], schema=arrow)

    return run


def _first_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The gram that each passage begins with, as long as the passage allows."""
    with np.errstate(over="ignore"):
        for batch in batches:
            passages = batch.column(1).to_pylist()
            sizes = [next(g for g in GRAMS if g <= len(p)) for p in passages]
            grams = [int(gram_hashes(p[:g], {g})[g][0]) for p, g in zip(passages, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(grams, pa.int64())], ["number", "passage", "size", "gram"])


def passages_in(passages: DataFrame, key: str, docs: DataFrame, doc_key: str, text: str = "text") -> DataFrame:
    """(key, doc_key) where the document holds the whole passage, lower-cased, as a string.

    Documents are read once for all passages: their grams (runs of 16 characters, or fewer for
    short passages) are held against a map of the passages' first ones, those found are joined, and
    candidates compared whole.  Empty and null passages are in no document.
    """
    own = passages.where(F.length(text) > 0).select(key, F.lower(text).alias("passage"))
    asked = own.select("passage").distinct().select(F.xxhash64("passage").alias("number"), "passage").mapInArrow(_first_grams, "number long, passage string, size int, gram long")
    sizes = {r["size"] for r in asked.select("size").distinct().collect()}  # five at most
    words = bit_map(asked.select("gram"), MAP_BITS)
    rows = docs.select(doc_key, F.lower(text).alias("body"))
    field = rows.schema[doc_key]
    grams = rows.mapInArrow(_grams(field, words, sizes), StructType([field, *StructType.fromDDL("size int, gram long").fields]))
    met = grams.join(asked, ["size", "gram"]).select(F.col(doc_key).alias("met_key"), "passage")
    held = met.groupBy("met_key").agg(F.collect_set("passage").alias("asked"))
    found = rows.join(held, F.col(doc_key).eqNullSafe(F.col("met_key"))).select(doc_key, F.explode(F.filter("asked", lambda p: F.contains(F.col("body"), p))).alias("found"))
    return found.join(own, F.col("found") == F.col("passage")).select(key, doc_key).distinct()
