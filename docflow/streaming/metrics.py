"""Counter streams: windowed sums with watermarks, rates and worker states.

Windows follow event time: a silent metric decays as time passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, keys: list[str], length: str, step: str | None = None, late: str | None = None, value: Column | None = None) -> DataFrame:
    """Sums and counts by tumbling or sliding window; the same on batches and streams."""
    if late and events.isStreaming:
        events = events.withWatermark(ts, late)
    span = F.window(F.col(ts), length, step) if step else F.window(F.col(ts), length)
    out = events.groupBy(span.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value if value is not None else F.lit(1)).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """Runs of events of a key with no pause of ``gap`` inside."""
    if late and events.isStreaming:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.session_window(F.col(ts), gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def rolling_sums(events: DataFrame, ts: str, key: str, value: str, seconds: int = 300) -> DataFrame:
    """Each event with its key's sum over the seconds up to it (batch only)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.sum(value).over(w))


def rates(events: DataFrame, ts: str, key: str, value: str, now: Column, start: Column, seconds: int = 300) -> DataFrame:
    """Lifetime and recent rates of every key at ``now``."""
    age = F.unix_micros(now) / 1e6 - F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    life = F.unix_micros(now) / 1e6 - F.unix_micros(start) / 1e6
    return events.groupBy(key).agg((F.sum(value) / life).alias("lifetime"), (F.coalesce(F.sum(F.when(age <= seconds, F.col(value))), F.lit(0)) / F.least(F.lit(seconds), life)).alias("recent"))


def without_repeats(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Events once: on a stream within the watermark, on a batch at all."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def run_available(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Write what a stream has now to a Parquet folder, and read it.

    Complete results replace each other.  Update results have the last row of every
    key in ``keys``: each batch writes a table of its own from the one before, so a batch
    that is run again gives the same.
    """
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(folder)
    if mode == "update" and not keys:
        raise ValueError("update results are merged by keys")
    last = [-1]

    def put(df: DataFrame, batch: int) -> None:
        if mode == "update" and batch:
            before = spark.read.schema(stream.schema).parquet(f"{folder}/batch={batch - 1}")
            df = before.join(df.select(*keys), keys, "left_anti").unionByName(df)
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        last[0] = batch

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/batch={last[0]}")
