"""Connected components over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.operators.scratch import written


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node that links (a, b) reach; nodes without links are not returned.

    In a round every node and its old label take the least label around the node, then labels
    jump to their own labels; chains shorten by a power in each, and no node meets more than its
    own links.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph-edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    while True:
        near = edges.join(labels.toDF("b", "other"), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("near"))
        own = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("new"))
        pulled = own.select(F.col("comp").alias("node"), "new").unionByName(own.select("node", "new")).groupBy("node").agg(F.min("new").alias("new"))
        moved = labels.join(pulled, "node").select("node", "comp", "new")
        jump = moved.select(F.col("node").alias("new"), F.col("new").alias("far"))
        moved = written(moved.join(jump, "new").select("node", "comp", F.least("new", "far").alias("new")), "graph-labels")
        labels = moved.select("node", F.col("new").alias("comp"))
        if not moved.where("comp != new").limit(1).count():
            return labels
