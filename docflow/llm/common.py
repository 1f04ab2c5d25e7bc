"""Shared ground: the shared folder, materialised tables and text helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of the contract's words.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names.  Where that is unset, a folder of our
    own is made in local mode (tests); on a cluster there is no such folder to make.
    """
    for read in (
        lambda: spark.conf.get("spark.checkpoint.dir"),
        lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir"),
        lambda: spark.sparkContext.getCheckpointDir(),
    ):
        with contextlib.suppress(Exception):
            if found := read():
                return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="docflow-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    A written table cuts the lineage, outlives lost executors and gives later
    steps exact sizes for their join strategies.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame, bytes_each: int) -> int:
    """How many partitions ``df`` should be dealt to: by its estimated size, and the session's number at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Frames without statistics of their own are said to be huge; they get the session's number.
    return own if size >= 1 << 60 else max(own, -(-size // bytes_each))


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, and finished shuffles.

    Spark removes a shuffle's files when the driver's JVM has collected its
    handle, which a large driver heap may put off for long.
    """
    jvm = spark.sparkContext._jvm
    shared = urlsplit(shared_dir(spark)).path.rstrip("/")
    for table in tables:
        for file in table.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if urlsplit(folder.toString()).path.startswith(f"{shared}/"):  # never a table that is not ours
                fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
                fs.delete(folder, True)
    jvm.System.gc()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst would otherwise inline an expression that a lambda refers to and
    evaluate it again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
