"""Sharding by minimax contiguous partition.

Documents with equal texts are one atomic group.  Groups are ordered by the
sha256 of their text, with running sums of sizes.  A binary search finds the smallest
capacity with which eight contiguous shards hold all groups; a capacity is tested
greedily, by looking up where each shard would end.  The cuts lie between the
places that packing greedily from the front and from the back allow, as near to
equal shares as that leaves room, so no shard exceeds the capacity and none stays
empty without need.

The driver looks ends up in a table of some thousands, which it refines where a
search depends on more: a round asks Spark for finer ends in the few cells that the
greedy walks at the bounds of the capacity touch, a scan of just their ranges.

The law is ``bytes``: sizes near equal, groups whole.  Running sums take a range
partition and one small row a partition; a group of any share of the rows is
spread over tasks, for the range key ends with ``doc_id``.  All is done with DataFrame
functions.

Defined results: a null text counts as empty, so its size is 1.  Rows that repeat
a ``doc_id`` are placed each; a null ``doc_id`` is placed by its text.  An empty
table gives an empty result; with fewer groups than shards some stay empty.  Other
input columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.common import materialize, partitions, release, text_or_empty

SHARDS = 8
#: Parts into which a cell of the table of ends is split, and the whole at first.
SPLIT = 512
FIRST_SPLIT = 4096
#: Input bytes of a range partition.
RANGE_BYTES = 256 << 20


def running_sums(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, digest, and in digest order upto (bytes) and place (rows before)."""
    text = text_or_empty().cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = materialize(rows, "op10-rows")
    dealt = materialize(rows.repartitionByRange(partitions(docs, RANGE_BYTES), "digest", "doc_id").withColumn("part", F.spark_partition_id()), "op10-ranges")
    order = Window.partitionBy("part").orderBy("digest", "doc_id")
    own = dealt.withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("row", F.row_number().over(order))
    # One row a partition.
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"))
    out = own.join(totals, "part")
    out = out.select("doc_id", "size", "text_crc32", "digest", (F.col("bytes") + F.col("sum")).alias("upto"), (F.col("rows") + F.col("row") - 1).alias("place"))
    out = materialize(out, "op10-sums")
    release(docs.sparkSession, rows, dealt)
    return out


class Ends:
    """Group ends, looked up in a sorted table of some of them that is refined on demand."""

    def __init__(self, ends: DataFrame, total: int):
        """``ends``: one row a group with its ``end``; 0 and ``total`` count as ends."""
        self.ends, self.total = ends, total
        self.known = [0, total] if total else [0]
        #: Known ends with no unknown one between them and the next.
        self.whole: set[int] = set()
        self.refine([0], FIRST_SPLIT)

    def refine(self, cells: list[int], split: int = SPLIT) -> None:
        """Learn ends inside the cells that begin at the given known ends: two a part of each cell at most."""
        spans = [(x, self.known[bisect_right(self.known, x)]) for x in sorted(set(cells)) if x < self.total]
        if not spans:
            return
        inside = reduce(lambda p, q: p | q, [(F.col("end") > x) & (F.col("end") < y) for x, y in spans])
        cell = reduce(lambda when, z: when.when((F.col("end") > z[1][0]) & (F.col("end") < z[1][1]), z[0]), enumerate(spans), F.when(F.lit(False), 0))
        part = reduce(lambda when, z: when.when(F.col("cell") == z[0], F.floor((F.col("end") - z[1][0]) / max(1, -(-(z[1][1] - z[1][0]) // split)))), enumerate(spans), F.when(F.lit(False), F.lit(0).cast("long")))
        rows = self.ends.where(inside).withColumn("cell", cell).withColumn("part", part)
        found = rows.groupBy("cell", "part").agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count_distinct("end").alias("n")).collect()  # bounded by cells and split
        new = set(self.known)
        open_cells = set()
        for row in found:
            new |= {row["low"], row["high"]}
            if row["n"] > 2:
                open_cells.add(row["low"])
        self.known = sorted(new)
        for x, y in spans:
            at = bisect_left(self.known, x)
            while self.known[at] < y:
                if self.known[at] not in open_cells:
                    self.whole.add(self.known[at])
                at += 1

    def bounds(self, x: int) -> tuple[int, int, int | None]:
        """Between what lies the largest end that is not above ``x``, and the cell to refine if that is not sure."""
        low = self.known[bisect_right(self.known, x) - 1]
        return (low, low, None) if low == x or low in self.whole or low == self.total else (low, x, low)

    def floor(self, x: int) -> int:
        """The largest end that is not above ``x``."""
        while (found := self.bounds(max(x, 0)))[2] is not None:
            self.refine([found[2]])
        return found[0]

    def ceil(self, x: int) -> int:
        """The smallest end that is not below ``x``."""
        below = self.floor(x)
        return below if below >= x else self.known[bisect_right(self.known, below)]

    def resolve(self, places: list[int]) -> None:
        """Make the ends around all the places sure together."""
        while cells := [c for x in places if (c := self.bounds(max(x, 0))[2]) is not None]:
            self.refine(cells)


def _least(fits, low: int, high: int) -> int:
    """The least number in [low, high] that fits, if ``high`` does."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def smallest_capacity(ends: Ends, largest: int, shards: int = SHARDS) -> int:
    """The least capacity with which ``shards`` contiguous shards hold everything."""
    total = ends.total

    def walk(capacity: int, hopeful: bool) -> tuple[bool, list[int]]:
        """Whether the shards reach the end, each unsure place read as high (or low) as it may be; the unsure cells."""
        at, cells = 0, []
        for _ in range(shards):
            low, high, cell = ends.bounds(min(total, at + capacity))
            at = high if hopeful else low
            cells += [] if cell is None else [cell]
        return at >= total, cells

    low = max(largest, -(-total // shards))
    high = low + largest  # always suffices
    while True:
        low, high = _least(lambda c: walk(c, True)[0], low, high), _least(lambda c: walk(c, False)[0], low, high)
        if low == high:
            return low
        ends.refine([cell for c in (low, (low + high) // 2, high) for hopeful in (True, False) for cell in walk(c, hopeful)[1]])


def cuts(ends: Ends, capacity: int, shards: int = SHARDS) -> list[int]:
    """Group ends at which the first ``shards - 1`` shards end."""
    total = ends.total
    earliest = [total]
    for _ in range(shards - 1):
        earliest.append(ends.ceil(earliest[-1] - capacity))
    earliest = earliest[::-1]  # shard k must end at earliest[k] at least
    out: list[int] = []
    at = 0
    for k in range(shards - 1):
        share = at + (total - at) // (shards - k)
        ends.resolve([share, min(total, at + capacity)])
        below, latest, above = ends.floor(share), ends.floor(min(total, at + capacity)), ends.ceil(share)
        near = below if below > at and share - below <= above - share else above
        at = min(max(near, earliest[k]), latest)
        out.append(at)
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = running_sums(docs)
    groups = rows.groupBy("digest").agg(F.max("upto").alias("end"), F.sum("size").alias("bytes"))
    # In order, so that files and row groups outside a range are skipped.
    ends = materialize(groups.select("end", "bytes").repartitionByRange("end").sortWithinPartitions("end"), "op10-ends")
    total, largest = ends.agg(F.max("end"), F.max("bytes")).first()
    table = Ends(ends.select("end"), total or 0) if total else None
    places = cuts(table, smallest_capacity(table, largest, shards), shards) if table else []
    release(docs.sparkSession, ends)
    shard = sum(((F.col("upto") > x).cast("int") for x in places), F.lit(0)).cast("int")
    rows = rows.withColumn("shard", shard)
    firsts = rows.groupBy("shard").agg(F.min("place").alias("first"))  # a row a shard
    out = rows.join(F.broadcast(firsts), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
