"""Exact dedup by deterministic block naming.

A normalised text is cut into fixed-size blocks.  The distinct blocks are
sorted and numbered, so that each block has an integer name; adjacent names
then form pairs, the distinct pairs are sorted and numbered in turn, and so on
until one name is left for each document.  Names stand for contents compared
byte by byte, so equal (block count, last name) means equal texts: there is no
hash whose collisions could merge two of them.

Defined results: a null text counts as empty, and all empty texts are equal.
Rows that repeat a ``doc_id`` are counted each and told apart by their text;
where the text is equal too and the id is the largest, all of them are kept.  A
null ``doc_id`` sorts below all others, so it is kept only when its whole group
has null ids.  An empty table gives an
empty result.  Other columns of the input, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import materialize, release
from docflow.llm.wordhash import buffers

BLOCK_BYTES = 4096
#: Output rows of one Arrow batch.
_ROWS = 2048


def _blocks(block_bytes: int, content: bool):
    """Rows for every block: its contents, or its place and its sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1))
            raw, at = buffers(texts)
            view = memoryview(np.ascontiguousarray(raw)).cast("B")
            rows: list[tuple] = []
            for k, doc_id in enumerate(ids):
                body = view[at[k] : at[k + 1]]
                pieces = [body[i : i + block_bytes] for i in range(0, len(body), block_bytes)] or [body]
                digest = None if content else hashlib.sha256(body).digest()
                for i, piece in enumerate(pieces):
                    h = digest if len(pieces) == 1 and not content else hashlib.sha256(piece).digest()
                    rows.append((bytes(piece), h) if content else (doc_id, digest, len(pieces) if len(body) else 0, i, h))
                    if len(rows) >= _ROWS:
                        yield _batch(rows, content)
                        rows = []
            if rows:
                yield _batch(rows, content)

    return run


def _batch(rows: list[tuple], content: bool) -> pa.RecordBatch:
    names = ["block", "h"] if content else ["doc_id", "digest", "n_blocks", "idx", "h"]
    kinds = [pa.binary(), pa.binary()] if content else [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def name_keys(keyed: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Number the distinct values of ``keys`` in sorted order within hash ranges.

    The distinct step combines equal keys before they are shuffled, so a key that
    many rows share costs one row a task.  Partition number and rank make the
    name.  The table is written at once: later joins all see the same names, and
    AQE can split their skewed partitions.
    """
    distinct = keyed.dropDuplicates(keys).sortWithinPartitions(*keys)
    return materialize(distinct.withColumn("name", F.monotonically_increasing_id()).select(*keep, "name"), "op6-keys")


def document_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, digest (of the normalised text) and the identity (n_blocks, name)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Contents are compared here, once, where the distinct blocks are sorted.
    contents = docs.select("doc_id", "text").mapInArrow(_blocks(block_bytes, True), "block binary, h binary")
    names = name_keys(contents, ["block"], ["h"])
    # From here a block goes by its sha256, which is checked to stand for one content only.
    if names.groupBy("h").count().where("count > 1").limit(1).count():
        raise RuntimeError("two different blocks have one sha256")
    places = docs.mapInArrow(_blocks(block_bytes, False), "doc_id long, digest binary, n_blocks int, idx int, h binary")
    level = materialize(places.join(names, "h").select("doc_id", "digest", "n_blocks", "idx", "name", F.lit(1).alias("copies")), "op6-names")
    out = level.where("n_blocks <= 1")
    tops = level.where("n_blocks > 1")
    levels = (tops.agg(F.max("n_blocks")).first()[0] or 1) - 1
    for _ in range(levels.bit_length()):
        even = F.col("idx") % 2 == 0
        pairs = tops.groupBy("doc_id", "digest", "n_blocks", F.floor(F.col("idx") / 2).cast("int").alias("idx")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
            F.sum(F.when(even, F.col("copies"))).cast("int").alias("copies"),  # rows that repeat a document
        )
        pairs = materialize(pairs, "op6-pairs")
        keys = name_keys(pairs, ["left", "right"], ["left", "right"])
        tops = materialize(pairs.join(keys, ["left", "right"]).select("doc_id", "digest", "n_blocks", "idx", "name", "copies"), "op6-names")
    release(spark)
    return out.unionByName(tops).select("doc_id", "digest", "n_blocks", "name", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_")).drop("_")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the largest ``doc_id`` stays.
    """
    names = document_names(docs, block_bytes)
    groups = names.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # One row a group on the other side: a group that holds a third of all rows is split by AQE's skew join.
    out = names.join(groups, ["n_blocks", "name"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
