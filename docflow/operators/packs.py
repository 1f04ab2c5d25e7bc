"""Order-dependent packing: running sums that start anew, gaps and merged spans."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from docflow.operators.ordered import numbered, same
from docflow.operators.scratch import written

#: Rows of a block whose bins one task finds, and blocks (or groups of them) that are taken together.
BLOCK_ROWS = 1 << 16
FAN = 64


class Passage(NamedTuple):
    """What a stretch of rows does to the bin that is open when it begins.

    The bin closes ahead of the first row whose running sum ``cum`` and what the bin held exceed
    the limit.  If that is row j, the bin that is open behind the stretch holds ``held[j]`` and
    ``closed[j]`` bins have been closed; if there is none, the stretch adds ``total``.  Rows after
    the first whose sum alone exceeds the limit are never the first to close a bin.
    """

    cum: np.ndarray
    held: np.ndarray
    closed: np.ndarray
    total: int

    def leave(self, held: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """What bins that hold ``held`` hold behind the stretch, and how many were closed."""
        j = np.searchsorted(self.cum, limit - held, "right")
        through = j == len(self.cum)
        j = np.minimum(j, len(self.cum) - 1)
        return np.where(through, held + self.total, self.held[j]), np.where(through, 0, self.closed[j])

    def then(self, after: Passage, limit: int) -> Passage:
        """Both stretches as one."""
        held, closed = after.leave(self.held, limit)
        cum = np.concatenate([self.cum, self.total + after.cum])
        keep = min(len(cum), int(np.searchsorted(cum, limit, "right")) + 1)
        return Passage(cum[:keep], np.concatenate([held, after.held])[:keep], np.concatenate([self.closed + closed, after.closed])[:keep], self.total + after.total)


def _starts(cum: np.ndarray, first: int, limit: int) -> list[int]:
    """The rows that begin bins, if ``first`` does."""
    out = []
    while first < len(cum):
        out.append(first)
        first = int(np.searchsorted(cum, (cum[first - 1] if first else 0) + limit, "right"))
    return out


def passage(costs: np.ndarray, limit: int) -> Passage:
    """The passage of a block of rows."""
    if len(costs) and costs.max() > limit:
        raise ValueError("an item exceeds the bin size")
    cum = np.cumsum(costs)
    n, ahead = len(cum), cum - costs
    following = np.searchsorted(cum, ahead + limit, "right")
    closed, last = np.ones(n + 1, np.int64), np.arange(n + 1)
    closed[n] = 0
    step = np.append(following, n)
    last_start = last.copy()
    while (step < n).any():  # follow bins to the last one in the block, doubling the stride
        live = step < n
        last_start = np.where(live, last_start[step], last_start)
        closed = np.where(live, closed + closed[step], closed)
        step = np.where(live, step[step], step)
    held = cum[-1] - ahead[last_start[:n]]
    keep = min(n, int(np.searchsorted(cum, limit, "right")) + 1)
    return Passage(cum[:keep], held[:keep], closed[:n][:keep], int(cum[-1]))


def _as_row(group: pa.Scalar, block: int, p: Passage) -> list[pa.Array]:
    return [pa.array([group.as_py()], group.type), pa.array([block], pa.int64()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (p.cum, p.held, p.closed)), pa.array([p.total], pa.int64())]


def _passages(table: pa.Table) -> list[Passage]:
    cum, held, closed = (table.column(c).to_pylist() for c in ("cum", "held", "closed"))
    return [Passage(*(np.array(x, np.int64) for x in row[:3]), row[3]) for row in zip(cum, held, closed, table.column("total").to_pylist(), strict=True)]


def bin_rows(df: DataFrame, group: str, order: str, size: str, limit: int, overhead: int = 1024) -> DataFrame:
    """``df`` with the ``bin`` of each row, filled in ``order`` within each group.

    A bin closes when the next item would exceed the limit; an item over the limit raises an
    error.  Which bin an item falls into depends on all before it, but what a stretch of rows does
    depends only on how much the open bin holds.  So blocks of rows become such functions in
    parallel, 64 of them at a time are joined into one until a group has one, and what each bin holds
    at a block's begin then goes down the same tree.  A large group spreads over as many tasks as it has blocks; a function has
    at most as many places as items fit into a bin.

    A null group is a group, a null size is 0, and rows of one group and order fall into bins in
    some order, each once.
    """
    rows = written(numbered(df.withColumn("bin_cost", F.coalesce(F.col(size).cast("long"), F.lit(0)) + overhead), [group], [order]), "bin-rows")
    kind = df.schema[group].dataType
    keyed = rows.select(F.col(group).alias("bin_group"), "row", F.expr(f"row div {BLOCK_ROWS}").alias("block"), F.col("bin_cost").cast("long").alias("cost"))
    fields = lambda *more: StructType([StructField("bin_group", kind), *StructType.fromDDL(", ".join(more)).fields])
    layout = fields("block long", "cum array<long>", "held array<long>", "closed array<long>", "total long")
    names = layout.names

    def begin(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        return pa.Table.from_arrays(_as_row(table.column("bin_group")[0], table.column("block")[0].as_py(), passage(table.column("cost").to_numpy(), limit)), names)

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        first, *rest = _passages(table)
        for p in rest:
            first = first.then(p, limit)
        return pa.Table.from_arrays(_as_row(table.column("bin_group")[0], table.column("block")[0].as_py() // FAN, first), names)

    levels = [written(keyed.groupBy("bin_group", "block").applyInArrow(begin, layout), "bin-blocks")]
    while levels[-1].where("block > 0").limit(1).count():
        upper = levels[-1].withColumn("above", F.expr(f"block div {FAN}"))
        levels.append(written(upper.groupBy("bin_group", "above").applyInArrow(lambda t: combine(t.drop_columns(["above"])), layout), "bin-blocks"))

    def descend(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        held, closed = np.array([table.column("open_held")[0].as_py()]), np.array([table.column("open_bin")[0].as_py()])
        out = []
        for block, p in zip(table.column("block").to_pylist(), _passages(table), strict=True):
            out.append((block, int(held[0]), int(closed[0])))
            held, more = p.leave(held, limit)
            closed = closed + more
        columns = [pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)]
        return pa.Table.from_arrays([table.column("bin_group").combine_chunks(), *columns], ["bin_group", "block", "open_held", "open_bin"])

    entry = fields("block long", "open_held long", "open_bin long")
    opened = levels[-1].select("bin_group", "block", F.lit(0).cast("long").alias("open_held"), F.lit(0).cast("long").alias("open_bin"))
    for level in reversed(levels[:-1]):
        above = opened.toDF("g2", "above", "open_held", "open_bin")
        below = level.withColumn("above2", F.expr(f"block div {FAN}")).join(above, same("bin_group", "g2") & (F.col("above") == F.col("above2"))).drop("g2", "above2")
        opened = written(below.groupBy("bin_group", "above").applyInArrow(lambda t: descend(t.drop_columns(["above"])), entry), "bin-open")

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        cum = np.cumsum(table.column("cost").to_numpy())
        held, number = (table.column(c)[0].as_py() for c in ("open_held", "open_bin"))
        bins = np.zeros(len(cum), np.int64)
        bins[_starts(cum, int(np.searchsorted(cum, limit - held, "right")), limit)] = 1
        return pa.Table.from_arrays([table.column("bin_group").combine_chunks(), table.column("row").combine_chunks(), pa.array(number + np.cumsum(bins))], ["bin_group", "bin_row", "bin"])

    blocks = keyed.join(opened.toDF("g2", "block2", "open_held", "open_bin"), same("bin_group", "g2") & (F.col("block") == F.col("block2"))).drop("g2", "block2")
    placed = blocks.groupBy("bin_group", "block").applyInArrow(fill, fields("bin_row long", "bin long"))
    out = rows.join(placed, same(group, "bin_group") & (F.col("row") == F.col("bin_row")))
    return out.select(*df.columns, "bin")


def chunks(df: DataFrame, order: str, size: int, group: str) -> DataFrame:
    """Fixed-size chunks of the sorted rows of each group."""
    return numbered(df, [group], [order]).withColumn("chunk", F.floor(F.col("row") / size)).select(*df.columns, "chunk")


def merge_spans(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Overlapping and touching spans of a group become one.

    Nulls stand last.  A span that does not reach its own start (no start or end, or an end ahead of it) and that
    none before it reaches stays alone, each of its copies too.
    """
    w = Window.partitionBy(group).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = lambda last: F.max(end).over(w.rowsBetween(Window.unboundedPreceding, last))
    marked = df.withColumn("_new", F.when(F.col(start) <= reach(-1), 0).otherwise(1)).withColumn("_alone", ~F.coalesce(F.col(start) <= reach(0), F.lit(False)))
    # Equal spans share a run here, in whatever order they come; those that stay alone share it with nothing else.
    runs = marked.withColumn("_run", F.sum("_new").over(w)).groupBy(group, "_run")
    merged = runs.agg(F.min(start).alias(start), F.max(end).alias(end), F.count_if("_alone").alias("_alone"))
    return merged.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest("_alone", F.lit(1))))).drop("_run", "_alone", "_copy")


def gap_runs(items: Column, gap: str, least: int) -> Column:
    """Runs of ``least`` and more gap tokens in an array, as [start, end).  A null is no gap."""

    def found(items: Column) -> Column:
        other = F.filter(F.transform(items, lambda x, i: F.when(~x.eqNullSafe(F.lit(gap)), i)), lambda i: i.isNotNull())
        # A run lies between neighbours of what is no gap, the array's ends included.
        ahead, behind = F.concat(F.array(F.lit(-1)), other), F.concat(other, F.array(F.size(items)))
        ends = F.zip_with(ahead, behind, lambda a, b: F.struct((a + 1).alias("start"), b.alias("end")))
        return F.filter(ends, lambda r: r["end"] - r["start"] >= least)

    # Bound by a lambda: Catalyst would else make the items anew at every use.
    return F.get(F.transform(F.array(items), found), F.lit(0))
