"""Readers and listings of document files; all read through Spark's file systems."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

JSONL_SUFFIXES = ["jsonl", "json", "jsonl.gz", "jsonl.zst", "jsonl.ztd", "jsonl.zstd"]


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType | str, strict: bool = False, recursive: bool = True) -> DataFrame:
    """Documents, one a line.  Blank lines are skipped; bad lines too unless ``strict``.  Unreadable files give no rows."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(["jsonl", "json", "gz", "zst", "zstd"]) + "}")
    return reader.option("ignoreCorruptFiles", str(not strict).lower()).json(paths)


def read_zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of zstd files of any suffix, with their file; for codecs that Hadoop does not know by suffix."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True) as stream:
                    lines = stream.read().decode().splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], ["file", "line_index", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, line_index long, line string")


def ragged_csv(lines: DataFrame, column: str = "line") -> DataFrame:
    """Rows of a first field and the array of the others, quoted fields with commas included."""
    cells = F.regexp_extract_all(column, F.lit(r'(?:^|,)(?:"((?:[^"]|"")*)"|([^",]*))'), F.lit(0))
    clean = F.transform(cells, lambda x: F.replace(F.regexp_replace(F.regexp_replace(x, r"^,", ""), r'^"|"$', ""), F.lit('""'), F.lit('"')))
    return lines.where(F.length(F.trim(column)) > 0).select(F.get(clean, F.lit(0)).alias("key"), F.slice(clean, 2, F.size(clean)).alias("items"))


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length and modification time of files under a glob."""
    if not any(x in pattern for x in "*?[{"):
        pattern = pattern.rstrip("/") + "/*"
    return spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime")


def read_range(spark: SparkSession, pattern: str, start: int = 0, end: int | None = None) -> DataFrame:
    """path and the bytes [start, end) of files under a glob; to their end where that is None."""
    part = F.substring("content", start + 1, 2**31 - 1 if end is None else end - start)
    return spark.read.format("binaryFile").load(pattern).select("path", part.alias("content"))


def with_backoff[R](read: Callable[[], R], attempts: int = 8, factor: float = 2, fatal: tuple[type[Exception], ...] = (PermissionError, FileNotFoundError), sleep: Callable[[float], None] = time.sleep) -> R:
    """What ``read`` gives; errors but the ``fatal`` ones are tried again, after factor ** k seconds each.

    For clients of services outside.  Spark retries its own reads by task.
    """
    for k in range(attempts):
        try:
            return read()
        except fatal:
            raise
        except Exception as error:  # noqa: BLE001  any other failure may pass
            last = error
            sleep(factor**k)
    raise RuntimeError(f"gave up after {attempts} attempts") from last


def pdf_pages(content: Column) -> Column:
    """Pages of a PDF by its plain page objects; those in compressed object streams are not seen."""
    return F.size(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"/Type\s*/Page(?![A-Za-z])"), F.lit(0)))


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Whole Markdown files with their relative paths."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    full = F.col("_metadata.file_path")
    return rows.select(F.regexp_replace(full, r"^.*?" + root.rstrip("/").split(":")[-1] + "/", "").alias("rel"), F.col("value").alias("md"))


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.trim("value").alias("path"))
    return rows.where("path != ''").distinct()


def file_kind(content: Column) -> Column:
    """pdf, png or jpeg by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg")


def attributes_folder(documents: str, name: str) -> str:
    """The attribute folder that belongs to a documents folder."""
    head, part, tail = documents.rstrip("/").rpartition("/documents")
    return f"{head}/attributes/{name}{tail}" if part else f"{documents.rstrip('/')}/attributes/{name}"


def assert_unique(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, or an error that names a repeated key."""
    twice = rows.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]!r} is there {twice[0]['count']} times")
    return rows


def pairs_of_files(markdown: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Markdown files that have a PDF of the same stem and one page."""
    a = markdown.withColumn("stem", F.regexp_replace("rel", r"\.md$", ""))
    b = pdfs.where("pages = 1").select(F.regexp_replace("path", r"\.pdf$", "").alias("stem"), F.col("path").alias("pdf"))
    return a.join(b, "stem").orderBy("rel")
