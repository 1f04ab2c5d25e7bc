"""Tar bundles as a data source: written by tasks, published by one commit, read a bundle a partition.

``df.write.format("docflow_bundles").mode("append").save(folder)`` takes rows (bundle, name, content)
and writes the files of each task and bundle to a bundle of its own in a private folder.  When all
tasks are done, the driver moves the bundles of the attempts that Spark has taken and adds them to the
manifest; a failed job removes what its tasks wrote.  So a folder never shows half a job, nor a bundle twice.
``spark.read.format("docflow_bundles").load(folder)`` gives the rows of the bundles that the
manifest names.

Rows of a bundle should stand together (``repartition("bundle")``) or bundles come in several files.
Null contents are empty files; a null name or bundle is an error.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from docflow.sources.store import opened

FORMAT = "docflow_bundles"
SCHEMA = "bundle string, name string, content binary"
MANIFEST = "manifest"
#: Bytes of a bundle from which on a task begins another.
LIMIT = 512 << 20


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: (file, bundle, members) each."""

    files: list[tuple[str, str, list[str]]]


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, limit: int, overwrite: bool):
        self.folder, self.limit, self.overwrite = folder, limit, overwrite
        self.private = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = opened(self.folder)
        system.create_dir(f"{base}/{self.private}", recursive=True)
        done: list[tuple[str, str, list[str]]] = []
        now: tuple[str, str, list[str]] | None = None
        sink = tar = None

        def close() -> None:
            nonlocal now
            if now:
                tar.close()
                sink.close()
                done.append(now)
                now = None

        held = 0
        for batch in iterator:
            for bundle, name, content in zip(*(batch.column(c) for c in ("bundle", "name", "content")), strict=True):
                bundle, name, content = bundle.as_py(), name.as_py(), content.as_py()
                if bundle is None or name is None:
                    raise ValueError("a file without a bundle or a name")
                if not now or now[1] != bundle or held > self.limit:
                    close()
                    now, held = (f"{uuid.uuid4().hex}.tar", bundle, []), 0
                    sink = system.open_output_stream(f"{base}/{self.private}/{now[0]}", compression=None)
                    tar = tarfile.open(fileobj=sink, mode="w|")
                info = tarfile.TarInfo(name)
                info.size = len(content or b"")
                tar.addfile(info, io.BytesIO(content or b""))
                tar.members.clear()  # tarfile keeps all it has met
                now[2].append(name)
                held += info.size
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = opened(self.folder)
        files = [f for m in messages if m for f in m.files]
        old = _manifests(self.folder) if self.overwrite else []
        for file, _, _ in files:
            system.move(f"{base}/{self.private}/{file}", f"{base}/{file}")
        # One file, moved into place, makes the whole job visible.
        lines = "".join(json.dumps({"file": f, "bundle": b, "members": m}) + "\n" for f, b, m in files)
        system.create_dir(f"{base}/{MANIFEST}", recursive=True)
        system.create_dir(f"{base}/{self.private}", recursive=True)
        with system.open_output_stream(f"{base}/{self.private}/m", compression=None) as out:
            out.write(lines.encode())
        system.move(f"{base}/{self.private}/m", f"{base}/{MANIFEST}/{uuid.uuid4().hex}.json")
        system.delete_dir(f"{base}/{self.private}")
        for manifest, entries in old:
            system.delete_file(manifest)
            for e in entries:
                system.delete_file(f"{base}/{e['file']}")

    def abort(self, messages: list[Written | None]) -> None:
        system, base = opened(self.folder)
        if system.get_file_info(f"{base}/{self.private}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.private}")


def _manifests(folder: str) -> list[tuple[str, list[dict]]]:
    system, base = opened(folder)
    found = system.get_file_info(fs.FileSelector(f"{base}/{MANIFEST}", allow_not_found=True))
    out = []
    for info in sorted((f for f in found if f.path.endswith(".json")), key=lambda f: f.path):
        with system.open_input_stream(info.path, compression=None) as lines:
            out.append((info.path, [json.loads(x) for x in lines.read().decode().splitlines()]))
    return out


@dataclass
class Bundle(InputPartition):
    file: str
    bundle: str


class BundleReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [Bundle(e["file"], e["bundle"]) for _, entries in _manifests(self.folder) for e in entries]

    def read(self, partition: Bundle) -> Iterator[tuple]:
        if not isinstance(partition, Bundle):  # a folder without bundles
            return
        system, base = opened(self.folder)
        with system.open_input_stream(f"{base}/{partition.file}", compression=None) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
            while (info := tar.next()) is not None:
                yield partition.bundle, info.name, tar.extractfile(info).read()
                tar.members.clear()


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BundleReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"], int(self.options.get("limit", LIMIT)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BundleSource)


def manifest(spark: SparkSession, folder: str):
    """(file, bundle, members) of the bundles that a folder shows."""
    return spark.read.schema("file string, bundle string, members array<string>").json(f"{folder.rstrip('/')}/{MANIFEST}")
