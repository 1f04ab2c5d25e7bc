"""Ranks, running sums and neighbours in groups of any size.

A window over a group sorts the whole group in one task.  Here rows are range partitioned by
group and order, so a large group spreads over tasks; a window within each partition numbers its
rows, and one row a group and partition tells what lies ahead of the partition.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.operators.scratch import written


def same(left: str, right: str) -> Column:
    """Equal, or both null."""
    return F.col(left).eqNullSafe(F.col(right))


def numbered(df: DataFrame, group: list[str], order: list[str], total: str | None = None, previous: list[str] | None = None) -> DataFrame:
    """``df`` with each row's place in its group, by ``order`` (null first).

    Adds ``row`` (from 0) and ``rows`` (the group's); with ``total`` also ``before``, the sum of
    that column over the rows ahead (null counts 0); with ``previous`` also the struct ``previous``
    of those columns in the row ahead (null in the first).  Rows that tie stand in some order, which
    stays the same as long as the result is used.  Null groups are a group.
    """
    tag = uuid.uuid4().hex
    mark, part, place = f"mark_{tag}", f"part_{tag}", f"place_{tag}"
    # Rows are marked and written first, so that ties spread over partitions and stay where they are.
    own = written(df.withColumn(mark, F.monotonically_increasing_id()), "ordered-rows")
    dealt = own.repartitionByRange(*group, *order, mark).sortWithinPartitions(*group, *order, mark)
    dealt = written(dealt.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()).drop(mark), "ordered-parts")
    within = Window.partitionBy(part, *group).orderBy(place)
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    value = F.coalesce(F.col(total).cast("long"), F.lit(0).cast("long")) if total else F.lit(0).cast("long")
    out = dealt.withColumn("row", (F.row_number().over(within) - 1).cast("long")).withColumn("before", F.coalesce(F.sum(value).over(ahead), F.lit(0).cast("long")))
    last = F.struct(*previous) if previous else F.struct(F.lit(None).cast("int").alias("none"))
    out = out.withColumn("previous", F.lag(last).over(within))
    sums = dealt.groupBy(*group, part).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.max_by(last, place).alias("last"))
    parts = Window.partitionBy(*group).orderBy(part)
    front = parts.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    names = [f"group{k}_{tag}" for k in range(len(group))]
    offsets = sums.select(
        *[F.col(g).alias(x) for g, x in zip(group, names, strict=True)], F.col(part).alias(f"p_{tag}"), F.coalesce(F.sum("n").over(front), zero).alias(f"n_{tag}"), F.coalesce(F.sum("s").over(front), zero).alias(f"s_{tag}"),
        F.lag("last").over(parts).alias(f"last_{tag}"), F.sum("n").over(Window.partitionBy(*group)).alias("rows"),
    )
    meet = reduce(lambda a, b: a & b, [F.col(part) == F.col(f"p_{tag}"), *(same(g, x) for g, x in zip(group, names, strict=True))])
    out = out.join(offsets, meet)
    shown = [*df.columns, (F.col("row") + F.col(f"n_{tag}")).alias("row"), "rows"]
    if total:
        shown.append((F.col("before") + F.col(f"s_{tag}")).alias("before"))
    if previous:
        shown.append(F.when(F.col("row") == 0, F.col(f"last_{tag}")).otherwise(F.col("previous")).alias("previous"))
    return out.select(*shown)
