"""Writers: JSON lines by work item, aligned attributes, front-matter pages, tarballs, caches."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators.packs import bin_rows


def write_results(docs: DataFrame, path: str, work: str = "work_hash", compression: str = "none") -> None:
    """One folder of JSON lines a work item."""
    docs.write.partitionBy(work).option("compression", compression).json(path)


def aligned_attributes(source: DataFrame, attributes: DataFrame) -> DataFrame:
    """A row for every source line (file, line_index), with a placeholder id where none was made."""
    rows = source.select("file", "line_index").join(attributes, ["file", "line_index"], "left")
    made = F.concat(F.lit("placeholder_"), "file", F.lit("_"), F.col("line_index").cast("string"))
    return rows.withColumn("id", F.coalesce("id", made)).repartition("file").sortWithinPartitions("file", "line_index")


def write_aligned_attributes(source: DataFrame, attributes: DataFrame, path: str, compression: str = "gzip") -> None:
    aligned_attributes(source, attributes).write.partitionBy("file").option("compression", compression).json(path)


def write_packaged(rows: DataFrame, path: str, compression: str = "snappy") -> None:
    """Parquet with the id first."""
    rows.select("id", *[c for c in rows.columns if c != "id"]).write.option("compression", compression).parquet(path)


def write_text_files(pages: DataFrame, path: str, name: str, text: str, per_file: int = 10_000) -> None:
    """Pages with their names as JSON lines, ``per_file`` a file at most: one file a page would be millions of tiny ones."""
    pages.select(F.col(name).alias("name"), F.col(text).alias("value")).write.option("maxRecordsPerFile", per_file).json(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """name and value of pages that :func:`write_text_files` wrote."""
    return spark.read.schema("name string, value string").json(path)


def concat_by_source(docs: DataFrame, source: str, order: str, text: str) -> DataFrame:
    """The texts that share a source file, joined in order."""
    rows = docs.groupBy(source).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("d"))
    return rows.select(source, F.array_join(F.transform("d", lambda x: x[text]), "\n").alias(text))


def tarballs(records: DataFrame, limit: int, group: str = "chunk", name: str = "name", content: str = "content") -> DataFrame:
    """(group, bin, tar, members): tar files under a byte limit, and what they hold."""
    sized = records.withColumn("_size", F.octet_length(content).cast("long"))
    placed = bin_rows(sized, group, name, "_size", limit)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(name)
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w") as tar:
            for n, body in zip(rows[name], rows[content], strict=True):
                info = tarfile.TarInfo(n)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(bytes(body)))
        return pd.DataFrame({group: [rows[group].iloc[0]], "bin": [rows["bin"].iloc[0]], "tar": [buffer.getvalue()], "members": [list(rows[name])]})

    kinds = dict(records.dtypes)
    return placed.groupBy(group, "bin").applyInPandas(pack, f"{group} {kinds[group]}, bin long, tar binary, members array<string>")


def write_tarballs(records: DataFrame, path: str, limit: int, group: str = "chunk", name: str = "name", content: str = "content") -> DataFrame:
    """Write gzipped tar files under a byte limit and a manifest, and read the manifest: chunk, arcname, relpath.

    Files are ``path``/tar/{group}_{bin}.tar.gz; the manifest is JSON lines below ``path``/manifest.
    The same records give the same bytes.  A file over the limit is an error.
    """
    from docflow.sources.store import put_file

    spark, folder = records.sparkSession, f"{path.rstrip('/')}/tar"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tar_name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = gzip.compress(body, mtime=0)
                if len(packed) > limit:
                    raise ValueError(f"{tar_name} exceeds {limit} bytes")
                put_file(folder, tar_name, packed)
            yield batch.select([0, 2])

    bins = tarballs(records, limit, group, name, content)
    tar_name = F.format_string("%s_%05d.tar.gz", F.col(group).cast("string"), F.col("bin"))
    done = bins.select(tar_name.alias("chunk"), "tar", "members").mapInArrow(put, "chunk string, members array<string>")
    rows = done.select("chunk", F.explode("members").alias("arcname")).withColumn("relpath", F.concat_ws(":", "chunk", "arcname"))
    rows.write.json(f"{path.rstrip('/')}/manifest")
    return spark.read.schema("chunk string, arcname string, relpath string").json(f"{path.rstrip('/')}/manifest")


def read_tarballs(spark: SparkSession, path: str) -> DataFrame:
    """chunk, name and size of the members of tar files that :func:`write_tarballs` wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(body), mode="r:gz") as tar:
                    members = tar.getmembers()
                yield pa.RecordBatch.from_arrays([pa.array([file.rsplit("/", 1)[-1]] * len(members)), pa.array([m.name for m in members], pa.string()), pa.array([m.size for m in members], pa.int64())], ["chunk", "name", "size"])

    return spark.read.format("binaryFile").load(f"{path.rstrip('/')}/tar/*.tar.gz").select("path", "content").mapInArrow(run, "chunk string, name string, size long")


def write_report(detail: DataFrame, path: str, label: str) -> None:
    """CSV files of a report; a row of averages, labelled ``average``, is in the first."""
    numbers = [n for n, kind in detail.dtypes if n != label and kind in ("double", "float", "int", "bigint")]
    average = detail.agg(*[F.avg(n).alias(n) for n in numbers]).withColumn(label, F.lit("average"))
    rows = average.unionByName(detail.select(label, *[F.col(n).cast("double") for n in numbers]))
    rows.select(label, *numbers).write.option("header", True).csv(path)


def write_tests(tests: DataFrame, path: str) -> None:
    """Test definitions as JSON lines; fields without a value are left out."""
    tests.write.option("ignoreNullFields", True).json(path)


def _escaped(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def write_html_rows(rows: DataFrame, path: str) -> None:
    """Rows as HTML table rows in text files, all of them: for reports of any size."""
    cells = [F.concat(F.lit("<td>"), _escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in rows.columns]
    rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value")).write.text(path)


def upsert(cache: DataFrame, new: DataFrame, key: str, age: str) -> DataFrame:
    """The latest row of every key of both tables."""
    both = cache.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), age).alias("r")).select("r.*")


def html_report(rows: DataFrame, most: int = 500) -> str:
    """A static page of a small result; larger ones are cut at ``most`` rows, and it says so."""
    found = rows.limit(most + 1).collect()
    head = "".join(f"<th>{c}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in found[:most])
    more = "<p>More rows follow.</p>" if len(found) > most else ""
    return f"<table><tr>{head}</tr>{body}</table>{more}"


def zstd_lines(lines: Iterator[str]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress("".join(x + "\n" for x in lines).encode())


def write_markdown_tree(docs: DataFrame, folder: str, path: str, page: str) -> int:
    """A Markdown file a document: the document's path below ``folder``, its extension replaced by .md; how many files.

    For trees that people read; corpora belong into files of many rows.
    """
    from docflow.sources.store import write_files

    name = F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(".md"))
    return write_files(docs.select(name.alias("name"), F.encode(F.col(page), "utf-8").alias("content")), folder, "name", "content")


def read_markdown_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the Markdown files below a folder; paths are relative to it.  Empty files are left out."""
    from docflow.sources.store import read_files

    return read_files(spark, folder, ".md").select("path", F.decode("content", "utf-8").alias("text"))


def write_summaries(rows: DataFrame, folder: str, key: str, count: str, top: int = 1000, sample: int = 100, seed: str = "0") -> None:
    """Three CSV folders: ``map`` has all rows, ``top`` the most frequent, ``sample`` some by a hash of their key."""
    rows.write.option("header", True).csv(f"{folder}/map")
    rows.orderBy(F.desc(count), key).limit(top).write.option("header", True).csv(f"{folder}/top")
    rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(sample).write.option("header", True).csv(f"{folder}/sample")
