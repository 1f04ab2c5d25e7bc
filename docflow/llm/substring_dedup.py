"""Substring dedup: Rabin-Karp hashes of every fixed-length word window.

A window of 20 consecutive words is removed wherever its word sequence also
starts earlier (in a document with a smaller ``doc_id``, or earlier in the same
one).  Windows are named by 96 bits of two Rabin-Karp hashes and counted in Spark; the
repeated ones of a document merge into maximal intervals, whose words go.

Two exact reductions keep the counted windows far fewer than the words:

* Documents with equal words form a class; only its smallest ``doc_id`` takes
  part.  Every window of the others also starts earlier.
* Each window has a smallest 8-word hash (a *mark*).  Equal windows have equal
  marks, and neighbours mostly share theirs, so a mark that is seen once in the
  corpus rules out all its windows.  Only windows with repeated marks are counted.

Counting combines rows in each task first, and the rows of a frequent window meet
one row in a skew join, so a passage that a third of the documents share burdens
no single task.

The starts of removed windows become intervals in parts of a document of fixed
length before they meet, so neither a long text nor a long passage makes a long list.

Windows are compared by their 96 bits, not by their words again: among n different
windows some pair is taken for equal with a probability of about n**2 / 2**97, 6e-8 for
the 10**11 windows of a corpus of 100 TB whose marks repeat.

Defined results: a null text has no words.  A null ``doc_id`` sorts below all.
Rows that repeat a ``doc_id`` and its words get the same result; with other words
they count as separate documents in the order of their words' sha256.  Texts of
any length are read whole.  An empty table gives an empty result.  Other input
columns are kept as they are, but for one named as ``result`` says, which the result replaces.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm.common import let, materialize, release
from docflow.llm.wordhash import buffers, groups, lists, named, sliding, squeezed, whole_windows, window_hashes, word_edges, word_hashes

WIDTH = 20
#: Words of a mark.
GRAM = 8
#: Words of a document whose removed windows become intervals together.
PART = 4096


def _window_marks(words: np.ndarray, begins: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all grams; each whole window's smallest one; and which windows are whole."""
    n = max(len(words) - width + 1, 0)
    starts, _ = whole_windows(begins, width)
    whole = np.zeros(n, bool)
    whole[starts] = True
    grams = window_hashes(words, gram)
    least = sliding(grams, width - gram + 1, np.minimum)[:n].copy()
    least[~whole] = 0
    return grams, least, whole


def _names(texts: pa.Array) -> list[bytes]:
    """sha256 of each text's words joined by one space."""
    raw, at = buffers(texts)
    view = memoryview(np.ascontiguousarray(raw)).cast("B")
    return [named(view[at[k] : at[k + 1]])[0] for k in range(len(at) - 1)]


@F.arrow_udf(T.BinaryType())
def _digest(texts: pa.Array) -> pa.Array:
    return pa.array([name for lo, hi in groups(texts) for name in _names(texts[lo:hi])], pa.binary())


def _marks(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = width - gram  # a window has span + 1 grams
        for batch in batches:
            for lo, hi in groups(batch.column(1)):
                ids, texts = batch.column(0)[lo:hi], batch.column(1)[lo:hi]
                (words,), begins = word_hashes(texts)
                grams, least, whole = _window_marks(words, begins, width, gram)
                if whole.any():
                    # A gram is a mark if it is the smallest of some window that holds it.
                    pad = np.zeros(span, np.uint64)
                    highest = sliding(np.concatenate([pad, least, pad]), span + 1, np.maximum)
                    at = np.flatnonzero((highest == grams[: len(highest)]) & (highest > 0))
                else:
                    at = np.zeros(0, np.int64)
                owner = np.searchsorted(begins, at, "right") - 1
                cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
                marks = []
                for k in range(hi - lo):
                    own, times = np.unique(grams[at[cuts[k] : cuts[k + 1]]], return_counts=True)
                    marks.append(np.concatenate([own, own[times > 1]]).astype(np.int64))  # twice at most: enough to be repeated
                columns = [ids, pa.array(np.diff(begins), pa.int64()), pa.array(_names(texts), pa.binary()), lists(marks, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "words", "marks"])

    return run


def _windows(width: int, gram: int):
    """Of documents with repeated marks: windows to count, and those that repeat in their own document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in groups(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                (one, two), begins = word_hashes(part.column(0), both=True)
                _, least, whole = _window_marks(one, begins, width, gram)
                marks = np.unique(np.asarray(part.column(2).flatten())).view(np.uint64)
                marks.sort()
                starts = np.flatnonzero(whole)
                starts = starts[marks[np.minimum(np.searchsorted(marks, least[starts]), len(marks) - 1)] == least[starts]] if len(marks) else starts[:0]
                if not len(starts):
                    continue
                first, second = window_hashes(one, width)[starts], window_hashes(two, width)[starts]
                owner = np.searchsorted(begins, starts, "right") - 1
                order = np.lexsort((starts, second, first, owner))
                again = np.zeros(len(starts), bool)
                a, b = order[:-1], order[1:]
                again[b] = (first[a] == first[b]) & (second[a] == second[b]) & (owner[a] == owner[b])
                keys = np.asarray(part.column(1))[owner]
                columns = [pa.array(first.view(np.int64)), pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(keys, pa.int64()), pa.array((starts - begins[owner]).astype(np.int32)), pa.array(again)]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "dkey", "start", "again"])

    return run


def _runs(starts: Column, width: int) -> Column:
    """Sorted starts as maximal intervals [start, end)."""

    def run(s: Column) -> Column:
        begins = F.filter(s, lambda x, i: (i == 0) | (x - F.get(s, i - 1) > width))
        ends = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1) - x > width))
        return F.zip_with(begins, ends, lambda x, y: F.struct(x.alias("start"), (y + width).alias("end")))

    return let(starts, run)


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, bool]:
    """doc_id, words (sha256 of the words) and the intervals to remove, one row a class of equal rows.

    Null intervals stand for all: an earlier document has the same words.  The flag
    says whether some doc_id has several texts, which ``words`` then tells apart.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = materialize(texts.mapInArrow(_marks(width, gram), "doc_id long, n_words long, words binary, marks array<long>").where(F.col("n_words") >= width), "op9-marks")
    # One document a class, numbered in the order that says which of two is earlier.
    lowest = F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("lowest")
    classes = seen.groupBy("words").agg(lowest).repartitionByRange("lowest", "words").sortWithinPartitions("lowest", "words")
    classes = materialize(classes.withColumn("dkey", F.monotonically_increasing_id()), "op9-classes")
    own_id = F.coalesce("doc_id", F.lit(-(2**63)))
    spans = "array<struct<start:int,end:int>>"
    copies = seen.join(classes, "words").where(own_id > F.col("lowest")).select("doc_id", "words", F.lit(None).cast(spans).alias("spans"))
    copies = materialize(copies.distinct(), "op9-copies")
    ours = seen.join(classes, "words").where(own_id == F.col("lowest"))
    marks = ours.select("dkey", F.explode("marks").alias("mark"))
    repeated = marks.groupBy("mark").count().where("count > 1").select("mark")
    held = marks.join(repeated, "mark").groupBy("dkey").agg(F.collect_set("mark").alias("marks"))
    original = F.when(F.col("lowest") > -(2**63), F.col("lowest")).alias("doc_id")
    held = materialize(held.join(classes, "dkey").select(original, "words", "dkey", "marks"), "op9-held")
    # The words' digest is looked at only where a doc_id has several texts.
    several = seen.groupBy("doc_id").agg(F.min("words").alias("a"), F.max("words").alias("b")).where("a != b").limit(1).count() > 0
    release(spark, seen)
    same = F.col("t_id").eqNullSafe(F.col("doc_id"))
    texts = texts.withColumnRenamed("doc_id", "t_id")
    if several:
        texts, same = texts.withColumn("t_words", _digest("text")), same & (F.col("t_words") == F.col("words"))
    # Sizes of written arrays say little of their rows, so neither join may broadcast by them.
    windows = texts.join(held.hint("merge"), same).select("text", "dkey", "marks").mapInArrow(_windows(width, gram), "h1 long, h2 int, dkey long, start int, again boolean")
    windows = materialize(windows, "op9-windows")
    release(spark, held)
    once = windows.where("not again")
    firsts = once.groupBy("h1", "h2").agg(F.min("dkey").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = once.join(firsts, ["h1", "h2"]).where("dkey > first").select("dkey", "start")
    later = later.unionByName(windows.where("again").select("dkey", "start"))
    # A set, not a list: rows that repeat a document give its windows again.
    parts = later.groupBy("dkey", F.floor(F.col("start") / PART).alias("part")).agg(F.array_sort(F.collect_set("start")).alias("starts"))
    runs = parts.select("dkey", _runs(F.col("starts"), width).alias("spans"))
    runs = runs.groupBy("dkey").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    found = runs.join(classes, "dkey").select(original, "words", F.col("spans").cast(spans).alias("spans"))
    out = materialize(found.unionByName(copies), "op9-spans")
    release(spark, windows, copies, classes)
    return out, several


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted intervals, those that touch as one."""
    out: list[tuple[int, int]] = []
    for span in spans:
        if out and span["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], span["end"]))
        else:
            out.append((span["start"], span["end"]))
    return out


_RESULT = pa.struct([("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_KIND = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("removed", _SPANS)])


def _kept(text: memoryview, gone: bool, spans: list[dict] | None) -> dict:
    """What stays of one text; ``gone`` with null spans: nothing."""
    if not gone:
        digest, n = named(text)
        return {"text": None, "n_words": n, "n_removed": 0, "kept_sha256": digest.hex(), "removed": []}
    begins, ends = word_edges(np.frombuffer(text, np.uint8))
    n = len(begins)
    cuts = [(0, n)] if spans is None else merged(spans)
    kept, at = [], 0
    for start, end in [*cuts, (n, n)]:
        if start > at:
            kept += [*squeezed(text[begins[at] : ends[start - 1]]), b" "]
        at = end
    joined = b"".join(kept[:-1])
    return {"text": joined.decode(), "n_words": n, "n_removed": sum(e - s for s, e in cuts), "kept_sha256": hashlib.sha256(joined).hexdigest(), "removed": [{"start": s, "end": e} for s, e in cuts]}


@F.arrow_udf(_KIND)
def _removed(texts: pa.Array, gone: pa.Array, spans: pa.Array) -> pa.Array:
    parts = [pa.array([], _RESULT)]
    for lo, hi in groups(texts):  # by bytes: a batch of long texts is never held as Python objects whole
        raw, at = buffers(texts[lo:hi])
        view = memoryview(np.ascontiguousarray(raw)).cast("B")
        parts.append(pa.array([_kept(view[at[k] : at[k + 1]], gone[lo + k].as_py(), spans[lo + k].as_py()) for k in range(hi - lo)], _RESULT))
    return pa.concat_arrays(parts)


def substring_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, result: str = "dedup") -> DataFrame:
    """``docs`` with repeated windows removed, and the struct ``result`` beside.

    ``text`` changes where words go: the kept words are joined by one space.
    ``result`` has n_words, n_removed, kept_sha256 (of the kept words joined by one
    space) and the removed intervals, in words.
    """
    found, several = repeated_windows(docs, width, gram)
    # Names beside the input's, whatever those are.
    own = f"__op9_{uuid.uuid4().hex}"
    found = found.select(F.struct("doc_id").alias(f"{own}_id"), F.col("words").alias(f"{own}_words"), F.col("spans").alias(f"{own}_spans"), F.lit(True).alias(f"{own}_gone"))
    # As a struct: null ids are a key like any other, and equal keys an equi-join.
    rows = docs.withColumn(f"{own}_key", F.struct(F.col("doc_id").cast("long").alias("doc_id")))
    same = F.col(f"{own}_key").eqNullSafe(F.col(f"{own}_id"))
    if several:
        rows, same = rows.withColumn(f"{own}_digest", _digest(F.col("text").cast("string"))), same & (F.col(f"{own}_digest") == F.col(f"{own}_words"))
    else:  # copies of one row have one decision
        found = found.drop(f"{own}_words")
    joined = rows.join(found.hint("merge"), same, "left").withColumn(f"{own}_out", _removed(F.col("text").cast("string"), F.coalesce(f"{own}_gone", F.lit(False)), F.col(f"{own}_spans")))
    kept = [F.coalesce(F.col(f"{own}_out.text"), F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != result]
    return joined.select(*kept, F.col(f"{own}_out").dropFields("text").alias(result))
