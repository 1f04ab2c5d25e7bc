"""Counts by key that can be cleared and that end after a silence: state with timers on a stream."""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State by key on disk, with snapshots and changes in the checkpoint; keeps more keys than memory does.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key string, ended string, first timestamp, last timestamp, n long"


class Runs(StatefulProcessor):
    """Counts events of a key; a run ends when the clearing event comes or the key is silent for too long.

    The state is the open run.  Events of a batch are taken in time order; a silence inside a
    batch ends a run as the timer does between batches.
    """

    def __init__(self, clear: str, silence_ms: int):
        self.clear, self.silence_ms = clear, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, n long")

    def _ended(self, key: tuple, why: str, run: tuple[int, int, int]) -> Row:
        at = lambda us: datetime.datetime.fromtimestamp(us / 1e6, datetime.timezone.utc)
        return Row(key=key[0], ended=why, first=at(run[0]), last=at(run[1]), n=run[2])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        run = tuple(self.open.get()) if self.open.exists() else None
        for row in sorted(rows, key=lambda r: (r["at"], r["event"] == self.clear)):
            if run and row["at"] - run[1] > self.silence_ms * 1000:
                yield self._ended(key, "silence", run)
                run = None
            if row["event"] == self.clear:
                if run:
                    yield self._ended(key, "clear", run)
                run = None
            else:
                run = (run[0], max(run[1], row["at"]), run[2] + 1) if run else (row["at"], row["at"], 1)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if run:
            self.open.update(run)
            self.handle.registerTimer(run[1] // 1000 + self.silence_ms)
        else:
            self.open.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.open.exists():
            yield self._ended(key, "silence", tuple(self.open.get()))
            self.open.clear()

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def runs(events: DataFrame, key: str, ts: str, event: str, clear: str, silence_ms: int, late: str) -> DataFrame:
    """Runs of events of a key on a stream: see :data:`OUTPUT`.

    A run ends at an event named ``clear`` or when ``silence_ms`` pass without another, as the
    watermark (``late``) tells.  Rows without a time or key are dropped; what is open when the
    stream stops stays in its checkpoint and goes on with the next start.
    """
    rows = events.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.coalesce(event, F.lit("")).alias("event"))
    return rows.withWatermark("ts", late).groupBy("key").transformWithState(Runs(clear, silence_ms), OUTPUT, "Append", "EventTime")
