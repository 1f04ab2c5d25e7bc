"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; in local mode a folder of our own where that is unset."""
    for read in (lambda: spark.conf.get("spark.checkpoint.dir"), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir"), lambda: spark.sparkContext.getCheckpointDir()):
        with contextlib.suppress(Exception):
            if found := read():
                return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="docflow-")
    spark.sparkContext.setCheckpointDir(made)
    return made.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later steps see the same rows in the same places, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
