"""Files written one by one from executors, zstd line files, and the flags and locks of a work store.

Paths are of file systems that pyarrow opens (local or mounted, hdfs, s3, gs).  A file
is written under a name of its own and then moved, so a task that runs twice leaves one
whole file.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators.scratch import written
from docflow.sources.files import list_files, ragged_csv, read_zstd_lines

#: Bytes of files that a task holds at a time, beside the last.
HELD = 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(path)


def put_file(folder: str, name: str, content: bytes) -> None:
    system, base = opened(folder)
    system.create_dir(base, recursive=True)
    own = f"{base}/_{uuid.uuid4().hex}"
    with system.open_output_stream(own, compression=None) as out:
        out.write(content)
    if "/" in name:
        system.create_dir(f"{base}/{name.rpartition('/')[0]}", recursive=True)
    system.move(own, f"{base}/{name}")


def write_files(rows: DataFrame, folder: str, name: str, content: str) -> int:
    """One file a row; how many.  For flags and small sets of files: pages belong into files of many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        made: set[str] = set()
        for batch in batches:
            for n, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = base + "/" + n
                above = target.rpartition("/")[0]
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                own = f"{base}/_{uuid.uuid4().hex}"
                with system.open_output_stream(own, compression=None) as out:
                    out.write(body or b"")
                system.move(own, target)
            yield batch.select([0])

    return rows.select(F.col(name).alias("name"), F.col(content).cast("binary")).mapInArrow(run, "name string").count()


def _hidden(name: str) -> bool:
    """Names that Spark's listings leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def read_files(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """(path, content) of files below a folder whose names end so; paths are relative to it.  Hidden and empty files are left out.

    Folders are listed by tasks, one level after the other, so no list of files passes through the driver; files
    are opened by tasks, one after the other, without a reader of Spark's for each.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        base = base.rstrip("/")
        for batch in batches:
            for at in batch.column(0).to_pylist():
                found = [x for x in system.get_file_info(fs.FileSelector(f"{base}/{at}".rstrip("/"))) if not _hidden(x.base_name)]
                found = [x for x in found if x.type == fs.FileType.Directory or (x.size and x.base_name.endswith(ending))]
                for k in range(0, len(found), 10_000):
                    part = found[k : k + 10_000]
                    names = [f"{at}/{x.base_name}".lstrip("/") for x in part]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x.type == fs.FileType.Directory for x in part], pa.bool_())], ["path", "inner"])

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        base = base.rstrip("/")
        rows = lambda names, bodies: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], ["path", "content"])
        for batch in batches:
            names, bodies, held = [], [], 0
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{base}/{name}", compression=None) as file:
                    body = file.read()
                names.append(name)
                bodies.append(body)
                held += len(body)
                if held > HELD:
                    yield rows(names, bodies)
                    names, bodies, held = [], [], 0
            if names:
                yield rows(names, bodies)

    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, files = spark.createDataFrame([("",)], "path string").repartition(1), []
    while True:
        found = written(level.mapInArrow(listed, "path string, inner boolean"), "listed")
        files.append(found.where("not inner").select("path"))
        level = found.where("inner").select("path")
        inner = level.count()
        if not inner:
            break
        level = level.repartition(min(own, inner), "path")
    every = files[0]
    for more in files[1:]:
        every = every.unionByName(more)
    n = every.count()
    # Names are small and files are not: their number is dealt out, which Spark does not put together again.
    tasks = max(1, min(own, -(-n // 500)), -(-n // 2000))
    return every.repartition(tasks, "path").mapInArrow(taken, "path string, content binary")


def write_zstd_lines(lines: DataFrame, folder: str, column: str = "line") -> int:
    """A zstd file of lines a partition, compressed as a stream; how many lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        own, written = f"{base}/_{uuid.uuid4().hex}", 0
        with system.open_output_stream(own, compression=None) as out, zstandard.ZstdCompressor().stream_writer(out, closefd=False) as packed:
            for batch in batches:
                found = batch.column(0).to_pylist()
                packed.write("".join(x + "\n" for x in found).encode())
                written += len(found)
        if written:
            system.move(own, f"{base}/part-{TaskContext.get().partitionId():05d}.csv.zstd")
        else:
            system.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["n"])

    return lines.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def found_or(read, empty: DataFrame) -> DataFrame:
    """What ``read`` gives, or ``empty`` where there are no such files; other errors stay errors."""
    try:
        return read()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return empty
        raise


class WorkStore:
    """Work items of a workspace: an index, flags of finished items, and locks of items in work.

    A flag or lock holds its item's hash, for Spark's listings leave out empty files.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def save_index(self, items: DataFrame) -> int:
        """Items (work_hash, paths) as lines of a hash and its paths, quoted where they need it."""
        quoted = F.transform("paths", lambda p: F.when(p.rlike('[,"]'), F.concat(F.lit('"'), F.replace(p, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(p))
        return write_zstd_lines(items.select(F.concat_ws(",", "work_hash", quoted).alias("line")), f"{self.root}/work_index")

    def index(self) -> DataFrame:
        """work_hash and paths; none where no index was written."""
        empty = self.spark.createDataFrame([], "work_hash string, paths array<string>")
        lines = lambda: ragged_csv(read_zstd_lines(self.spark, f"{self.root}/work_index")).select(F.col("key").alias("work_hash"), F.col("items").alias("paths"))
        return found_or(lines, empty)

    def _listed(self, folder: str, begin: str, end: str) -> DataFrame:
        empty = self.spark.createDataFrame([], "work_hash string, modificationTime timestamp")
        pattern = rf"/{begin}([^/]+)\.{end}$"
        name = F.regexp_extract("path", pattern, 1).alias("work_hash")
        return found_or(lambda: list_files(self.spark, f"{self.root}/{folder}").where(F.col("path").rlike(pattern)).select(name, "modificationTime"), empty)

    def done(self) -> DataFrame:
        """work_hash of finished items, by their flags."""
        return self._listed("done_flags", "done_", "flag").select("work_hash")

    def locked(self, seconds: int = 1800, now: datetime.datetime | None = None) -> DataFrame:
        """work_hash of items with a lock that is not stale."""
        at = F.lit(now) if now else F.current_timestamp()
        return self._listed("worker_locks", "worker_", "lock").where(F.unix_seconds(at) - F.unix_seconds("modificationTime") <= seconds).select("work_hash")

    def lock(self, items: DataFrame) -> int:
        rows = items.select("work_hash", F.concat(F.lit("worker_"), "work_hash", F.lit(".lock")).alias("name"))
        return write_files(rows, f"{self.root}/worker_locks", "name", "work_hash")

    def mark_done(self, items: DataFrame) -> int:
        """Flag items as finished, then take their locks away."""
        rows = items.select("work_hash", F.concat(F.lit("done_"), "work_hash", F.lit(".flag")).alias("name"))
        n, locks = write_files(rows, f"{self.root}/done_flags", "name", "work_hash"), f"{self.root}/worker_locks"

        def unlock(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, base = opened(locks)
            for batch in batches:
                for h in batch.column(0).to_pylist():
                    if system.get_file_info(f"{base}/worker_{h}.lock").type != fs.FileType.NotFound:
                        system.delete_file(f"{base}/worker_{h}.lock")
                yield batch

        items.select("work_hash").mapInArrow(unlock, "work_hash string").count()
        return n

    def pending(self, seconds: int = 1800, now: datetime.datetime | None = None) -> DataFrame:
        """Items of the index that are neither finished nor locked."""
        return self.index().join(self.done(), "work_hash", "left_anti").join(self.locked(seconds, now), "work_hash", "left_anti")
