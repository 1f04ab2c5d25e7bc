"""Token ids as Parquet list columns, written in doc_id order and read back.

The files hold one row per document: its ids as a list column and, beside it,
columns that can be read without the ids.  Ids and metadata are dictionary or
delta encoded; row groups and pages have set sizes, and the page indexes that
the writer adds let a reader skip to the rows and columns it wants.

Defined results: a null text counts as empty and has only its end id.  Rows with
a null ``doc_id`` come first; rows that repeat a ``doc_id`` are in the order of a
hash of their texts, then of those.  An empty table gives a file set without rows.  Other input
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.llm.common import partitions, shared_dir
from docflow.llm.tokens import encoded, vocabulary_path

FILE_SCHEMA = "shard int, doc_id long, local_start long, n_tokens long, ids array<int>"
#: Bytes of a row group and of a page, rows of a page at most.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
#: Input bytes (as Spark estimates them) of a file.
FILE_INPUT_BYTES = 512 << 20
#: Files whose first starts (16 bytes each) may be broadcast; beyond, they are joined by shuffle.
BROADCAST_FILES = 1 << 17
#: Ids of one output batch.
_BATCH_IDS = 1 << 20


def _rows(path: str):
    def batch(shard: int, ids: list, starts: list, lists: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        values = pa.array(np.concatenate(lists).astype(np.int32))
        columns = [pa.array([shard] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), values)]
        return pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "local_start", "n_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, at, held = context.partitionId() if context else 0, 0, 0
        ids: list = []
        starts: list = []
        lists: list[np.ndarray] = []
        for b in batches:
            for doc_id, tokens in zip(b.column(0).to_pylist(), encoded(b.column(1), path), strict=True):
                ids.append(doc_id)
                starts.append(at)
                lists.append(tokens)
                at += len(tokens)
                held += len(tokens)
                if held >= _BATCH_IDS:
                    yield batch(shard, ids, starts, lists)
                    ids, starts, lists, held = [], [], [], 0
        if ids:
            yield batch(shard, ids, starts, lists)

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, row_group_bytes: int = ROW_GROUP_BYTES, encoding: str = "dictionary") -> None:
    """Tokenize ``docs`` and write them in ascending doc_id order to ``folder``.

    Texts are range-partitioned before they are tokenized: the sampling pass of
    the range partitioner then costs a scan, not a second tokenization.
    ``encoding``: ``dictionary``, or ``delta`` for delta-packed ids.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The hash lets a range cut fall between rows that repeat a doc_id.
    key = F.xxhash64("text")
    placed = rows.repartitionByRange(partitions(rows, FILE_INPUT_BYTES), "doc_id", key).sortWithinPartitions("doc_id", key, "text")
    tokens = placed.mapInArrow(_rows(vocabulary or vocabulary_path()), FILE_SCHEMA)
    (
        tokens.write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "v2")
        .option("compression", "zstd")
        .parquet(folder)
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document in ``folder``.

    ``start`` counts the ids of all documents before it: each file's first start
    comes from a sum per file, which is one small row a file.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    # One row a file, and a running sum over those.
    running = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("shard", F.coalesce(F.sum("held").over(running), F.lit(0)).alias("before"))
    if len(files.inputFiles()) <= BROADCAST_FILES:
        before = F.broadcast(before)
    return files.join(before, "shard").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        at = np.asarray(lists.offsets)
        values = np.asarray(lists.values).astype("<i4", copy=False).view("<u4")  # no copy of a batch's ids
        sums = [zlib.crc32(values[at[k] : at[k + 1]].data) for k in range(len(lists))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as read."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/op3-tokens-{uuid.uuid4().hex}"
