"""Sampling by hash: seeded, repeatable, and without a driver-side pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(key: Column, seed: str = "0") -> Column:
    """A pseudo-random order of keys that other engines can make too."""
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def sample_n(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """``n`` rows without replacement; a top-k of hashes, so no full sort."""
    return df.orderBy(order_key(F.col(key), seed), key).limit(n)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, first: Column | None = None, seed: str = "0") -> DataFrame:
    """Up to ``n`` rows a group; rows for which ``first`` holds go first."""
    head = [F.desc(first)] if first is not None else []
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*head, order_key(F.col(key), seed), key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def sample_groups(df: DataFrame, group: str, share: float, seed: str = "0") -> DataFrame:
    """All rows of a share of the groups, one group at least."""
    groups = df.select(group).distinct()
    wanted = max(1, int(groups.count() * share))
    return df.join(sample_n(groups, group, wanted, seed), group, "left_semi")


def bootstrap_weights(df: DataFrame, key: str, replicates: int, seed: int = 0) -> DataFrame:
    """Rows repeated for each replicate with a Poisson(1) weight drawn from a hash: a bootstrap without a shuffle of rows."""
    u = (F.pmod(F.xxhash64(F.col(key), F.col("replicate"), F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    weight, mass, total = F.lit(8), 1.0, 0.0
    cases = []
    for k in range(8):
        mass = mass / max(k, 1)
        total += mass * 0.36787944117144233
        cases.append((total, k))
    for bound, k in reversed(cases):
        weight = F.when(F.col("u") < bound, k).otherwise(weight)
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return rows.withColumn("u", u).withColumn("weight", weight).drop("u").where("weight > 0")


def word_segment(text: Column, key: Column, least: int = 7, most: int = 15) -> Column:
    """A run of 7 to 15 words that starts at a hashed place."""
    ws = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    h = F.pmod(F.xxhash64(key.cast("string")), F.lit(1_000_003))
    size = F.least(F.lit(least) + F.pmod(h, F.lit(most - least + 1)), F.size(ws)).cast("int")
    start = (F.pmod(h, F.greatest(F.size(ws) - size + 1, F.lit(1))) + 1).cast("int")
    return F.when(F.size(ws) > 0, F.array_join(F.slice(ws, start, size), " "))
