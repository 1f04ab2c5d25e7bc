"""Spans of texts and boxes of pages that overlap: joins by cells."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.operators.graph import components
from docflow.operators.scratch import written

#: Characters of a cell, about a few sentences.
CELL = 512


def pieces(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, i, start, end, piece) of the pattern's matches, which must cover the text without gaps."""
    rows = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("i", "piece"))
    ahead = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(ahead), F.lit(0))
    return rows.withColumn("start", start).select(key, "i", "start", (F.col("start") + F.length("piece")).alias("end"), "piece")


def overlapping(left: DataFrame, right: DataFrame, key: str, cell: int = CELL) -> DataFrame:
    """Pairs of spans [start, end) of one key that share a character; right columns get the prefix ``r_``.

    A span stands in every cell that it touches, so a long one meets short ones cell by cell, in as
    many tasks as there are cells.  A pair counts in one cell alone, where the later of both begins.
    Empty spans, and those with a null, overlap nothing.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor((b - 1) / cell)))
    one = left.where("start < end").withColumn("cell_", cells(F.col("start"), F.col("end")))
    two = right.where("start < end").select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("r_cell_", cells(F.col("r_start"), F.col("r_end")))
    meet = (F.col(key) == F.col(f"r_{key}")) & (F.col("cell_") == F.col("r_cell_"))
    share = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    once = F.col("cell_") == F.floor(F.greatest("start", "r_start") / cell)
    return one.join(two, meet & share & once).drop("cell_", "r_cell_", f"r_{key}")


def around(gaps: DataFrame, units: DataFrame, key: str, reach: int, cell: int = CELL) -> DataFrame:
    """For each gap (key, start, end) the stretch from ``reach`` units ahead of those it touches to ``reach`` behind.

    ``units`` are (key, i, start, end), numbered without holes in each key.
    """
    touched = overlapping(gaps, units.select(key, "i", "start", "end"), key, cell).groupBy(key, "start", "end").agg(F.min("r_i").alias("low"), F.max("r_i").alias("high"))
    ends = units.groupBy(key).agg(F.max("i").alias("most"))
    asked = touched.join(ends, key).select(key, "start", "end", F.greatest(F.col("low") - reach, F.lit(0)).alias("low"), F.least(F.col("high") + reach, F.col("most")).alias("high"))
    first = units.select(key, F.col("i").alias("low"), F.col("start").alias("from"))
    last = units.select(key, F.col("i").alias("high"), F.col("end").alias("to"))
    return asked.join(first, [key, "low"]).join(last, [key, "high"]).select(key, "start", "end", "low", "high", "from", "to")


#: Boxes up to which a page is grouped in one row.
ROW_BOXES = 64


def _firsts(tolerance: float):
    """For each page, a list of boxes (x0, y0, x1, y1), the number of the first box of each one's group."""

    def run(pages: pa.Array) -> pa.Array:
        flat, sizes = pages.flatten(), pages.value_lengths().to_numpy()
        corners = [flat.field(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in ("x0", "y0", "x1", "y1")]
        fine = ((corners[0] <= corners[2]) & (corners[1] <= corners[3])).tolist()
        x0, y0, x1, y1 = (v.tolist() for v in corners)
        out: list[int] = []
        lo = 0
        for n in sizes.tolist():
            root = list(range(n))
            for i in range(1, n):
                p = lo + i
                if not fine[p]:
                    continue
                for j in range(i):
                    q = lo + j
                    if fine[q] and root[i] != root[j] and max(x0[p], x0[q]) - min(x1[p], x1[q]) <= tolerance and max(y0[p], y0[q]) - min(y1[p], y1[q]) <= tolerance:
                        new, old = sorted((root[i], root[j]))
                        root = [new if r == old else r for r in root]
            out += root
            lo += n
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(out, pa.int32()))

    run.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")


def box_groups(boxes: DataFrame, page: str, box: str, tolerance: float, cell: tuple[float, float]) -> DataFrame:
    """(page, box, group): boxes (x0, y0, x1, y1) of a page that touch up to ``tolerance``, directly or over others.

    The group is the least box in it.  A box whose corners are null or out of order stands alone, as do those
    without a page.  ``box`` is unique in its page.  Pages of up to :data:`ROW_BOXES` boxes are grouped in one
    row each; larger ones spread over tasks.
    """
    large = written(boxes.where(F.col(page).isNotNull()).groupBy(page).count().where(F.col("count") > ROW_BOXES).select(page), "large-pages")
    some = large.limit(1).count() > 0
    few = boxes.where(F.col(page).isNotNull())
    few = few.join(large, page, "left_anti") if some else few
    held = few.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(F.col(box).alias("box"), "x0", "y0", "x1", "y1"))).alias("b"))
    firsts = _firsts(tolerance)(F.transform("b", lambda x: F.struct(*[x[n].alias(n) for n in ("x0", "y0", "x1", "y1")])))
    rows = held.select(page, "b", firsts.alias("f")).select(page, "b", F.posexplode("f").alias("i", "f"))
    at = lambda k: F.get("b", F.col(k))["box"]
    out = rows.select(page, at("i").alias(box), at("f").alias("group")).unionByName(boxes.where(F.col(page).isNull()).select(page, box, F.col(box).alias("group")))
    return out.unionByName(_linked_groups(boxes.join(large, page, "left_semi"), page, box, tolerance, cell)) if some else out


def _linked_groups(boxes: DataFrame, page: str, box: str, tolerance: float, cell: tuple[float, float]) -> DataFrame:
    """The groups of :func:`box_groups` by a join of boxes in cells and the components of its links.

    Boxes stand in the cells of a grid that they touch, grown by half the tolerance; a pair counts in the cell where
    the later corners lie.
    """
    half = tolerance / 2
    node = F.struct(F.col(page).alias("page"), F.col(box).alias("box"))
    sides = lambda axis, size: [F.floor((F.col(f"{axis}0") - half) / size), F.floor((F.col(f"{axis}1") + half) / size)]
    good = boxes.where("x0 <= x1 AND y0 <= y1")
    rows = good.withColumn("cx", F.explode(F.sequence(*sides("x", cell[0])))).withColumn("cy", F.explode(F.sequence(*sides("y", cell[1]))))
    one = rows.select(F.col(page).alias("p"), "cx", "cy", "x0", "y0", "x1", "y1", node.alias("a"))
    two = one.toDF("p2", "cx2", "cy2", "u0", "v0", "u1", "v1", "b")
    apart = lambda a0, a1, b0, b1: F.greatest(a0, b0) - F.least(a1, b1) <= tolerance
    home = lambda a, b, size, c: F.floor((F.greatest(a, b) - half) / size) == F.col(c)
    conditions: list[Column] = [F.col("p") == F.col("p2"), F.col("cx") == F.col("cx2"), F.col("cy") == F.col("cy2"), F.col("a") < F.col("b"), apart("x0", "x1", "u0", "u1"), apart("y0", "y1", "v0", "v1"), home("x0", "u0", cell[0], "cx"), home("y0", "v0", cell[1], "cy")]
    links = one.join(two, reduce(lambda x, y: x & y, conditions)).select("a", "b")
    labels = components(links).select("node", F.col("comp.box").alias("least"))
    own = boxes.select(page, box, node.alias("own"))
    return own.join(labels, F.col("own").eqNullSafe(F.col("node")), "left").select(page, box, F.coalesce("least", box).alias("group"))
