"""State of batches sent to a service outside: init, processing, completed or errored_out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reported states after which a batch gives nothing.
BROKEN = ("failed", "expired", "cancelled")


def advance(state: DataFrame, reports: DataFrame, budget: int) -> DataFrame:
    """``state`` (folder, file, size, state) after one look at ``reports`` (folder, file, status, success).

    Batches in work end as they are reported; a batch that completed without success errs.
    New batches start in order of their files while the sizes in work in their folder, and
    of those started before them, are below the budget.  Finished batches stay as they are,
    as do batches without a report.  Null sizes count as zero.
    """
    size = F.coalesce(F.col("size"), F.lit(0))
    folder = Window.partitionBy("folder")
    before = folder.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum(F.when(F.col("state") == "processing", size)).over(folder), F.lit(0))
    ahead = F.coalesce(F.sum(F.when(F.col("state") == "init", size)).over(before), F.lit(0))
    ended = F.when(F.col("status") == "completed", F.when(F.col("success"), "completed").otherwise("errored_out")).when(F.col("status").isin(*BROKEN), "errored_out")
    new = F.when(F.col("state") == "processing", F.coalesce(ended, "state")).when((F.col("state") == "init") & (held + ahead < budget), "processing").otherwise(F.col("state"))
    return state.join(reports, ["folder", "file"], "left").withColumn("state", new).drop("status", "success")
