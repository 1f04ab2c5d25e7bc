"""Scores, reports and statistics over groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.operators.ordered import numbered


def conditional_mean(value: Column, has: Column) -> Column:
    """The mean over rows that have the element, or over all if none has."""
    return F.coalesce(F.avg(F.when(has, value)), F.avg(value))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when((p == 0) | (r == 0), 0.0).otherwise(2 * p * r / (p + r))


def id_iou(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(ratio(F.count_if(a & b), F.count_if(a | b)).alias("iou"))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two [x, y, w, h] boxes."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(F.get(a, F.lit(p)) + F.get(a, F.lit(s)), F.get(b, F.lit(p)) + F.get(b, F.lit(s))) - F.greatest(F.get(a, F.lit(p)), F.get(b, F.lit(p))))
    inter = side(0, 2) * side(1, 3)
    union = F.get(a, F.lit(2)) * F.get(a, F.lit(3)) + F.get(b, F.lit(2)) * F.get(b, F.lit(3)) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def boxes_overlap(a: Column, b: Column, tolerance: float) -> Column:
    """Whether [x0, y0, x1, y1] boxes overlap within a tolerance."""
    g = lambda c, k: F.get(c, F.lit(k))
    return ~((g(a, 2) < g(b, 0) - tolerance) | (g(a, 0) > g(b, 2) + tolerance) | (g(a, 3) < g(b, 1) - tolerance) | (g(a, 1) > g(b, 3) + tolerance))


def affine(x: Column, y: Column, m: list[float]) -> Column:
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def png_size(data: Column) -> Column:
    """Width and height from a base64 PNG header."""
    raw = F.unbase64(data)
    number = lambda at: F.conv(F.hex(F.substring(raw, at, 4)), 16, 10).cast("int")
    return F.struct(number(17).alias("width"), number(21).alias("height"))


def macro_report(scores: DataFrame, candidate: str, category: str, passed: str) -> DataFrame:
    """Pass rates by category, and as ``overall`` the mean of those, not of the tests."""
    by = scores.groupBy(candidate, category).agg(F.avg(F.col(passed).cast("double")).alias("rate"), F.count(F.lit(1)).alias("tests"))
    overall = by.groupBy(candidate).agg(F.avg("rate").alias("rate"), F.sum("tests").alias("tests")).withColumn(category, F.lit("overall"))
    return by.unionByName(overall)


def empirical_cdf(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows with their rank over the count of their group: ties take successive steps."""
    return numbered(df, [group], list(order)).withColumn("cdf", (F.col("row") + 1) / F.col("rows")).select(*df.columns, "cdf")


def elo_expected(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def _bootstrap(batches: Iterator[pd.DataFrame], held: list[tuple[np.ndarray, np.ndarray]], seed: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch["id"]:
            rng = np.random.default_rng([seed, int(r)])
            # Drawing n scores with replacement is drawing how often each value comes.
            out.append(float(np.mean([rng.multinomial(n.sum(), n / n.sum()) @ v / n.sum() for v, n in held])))
        yield pd.DataFrame({"mean": out})


def bootstrap_interval(scores: DataFrame, category: str, score: str, replicates: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval of the macro mean, resampled within categories.

    What is drawn from are counts of each score in each category over all rows: the
    driver holds a row a category and score.  Null scores do not count.
    """
    counts = scores.where(F.col(score).isNotNull()).groupBy(F.col(category).alias("g"), F.col(score).cast("double").alias("v")).count().orderBy("g", "v").toPandas()
    held = [(g["v"].to_numpy(float), g["count"].to_numpy(np.int64)) for _, g in counts.groupby("g", dropna=False)]
    means = scores.sparkSession.range(replicates).mapInPandas(lambda b: _bootstrap(b, held, seed), "mean double")
    tail = (1 - level) / 2
    return means.agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))


def permutation_test(a: list[float], b: list[float], spark, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """Two-sided p value of a difference of means under shuffled labels."""
    both, n = np.array([*a, *b], float), len(a)
    seen = abs(np.mean(a) - np.mean(b))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = 0
            for r in batch["id"]:
                mixed = np.random.default_rng([seed, int(r)]).permutation(both)
                hits += abs(mixed[:n].mean() - mixed[n:].mean()) >= seen - 1e-12
            yield pd.DataFrame({"hits": [hits], "tried": [len(batch)]})

    counts = spark.range(replicates).mapInPandas(run, "hits long, tried long")
    return counts.agg((F.sum("hits") / F.sum("tried")).alias("p"), F.lit(float(np.mean(a) - np.mean(b))).alias("difference"))


def stratified_permutation(scores: DataFrame, first: str, second: str, candidate: str, category: str, score: str, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """Two-sided p value of a difference of means of category means, labels shuffled within categories.

    What is drawn from are counts of each score in each category over all rows, so
    the driver holds a row a category and score.  A category that one candidate
    lacks stays as it is.  A category may have up to 10**9 rows (numpy's limit).
    """
    of = lambda name: F.count(F.when(F.col(candidate) == name, 1))
    rows = scores.where(F.col(candidate).isin(first, second) & F.col(score).isNotNull()).groupBy(category, score)
    counts = rows.agg(of(first).alias("a"), of(second).alias("b")).orderBy(category, score).toPandas()
    strata = [(g[score].to_numpy(float), g["a"].to_numpy(np.int64), g["b"].to_numpy(np.int64)) for _, g in counts.groupby(category, dropna=False)]

    def difference(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> float:
        means = [[v @ (x, y)[k] / (x, y)[k].sum() for v, x, y in parts if (x, y)[k].sum()] for k in (0, 1)]
        return float(np.mean(means[0]) - np.mean(means[1])) if all(means) else 0.0

    seen = difference(strata)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = 0
            for r in batch["id"]:
                rng = np.random.default_rng([seed, int(r)])
                drawn = [(v, x, a + b - x) for v, a, b in strata for x in [rng.multivariate_hypergeometric(a + b, a.sum())]]
                hits += abs(difference(drawn)) >= abs(seen) - 1e-12
            yield pd.DataFrame({"hits": [hits], "tried": [len(batch)]})

    tried = scores.sparkSession.range(replicates).mapInPandas(run, "hits long, tried long")
    return tried.agg((F.sum("hits") / F.sum("tried")).alias("p"), F.lit(seen).alias("difference"))


def elo_arena(pairs: Iterable[tuple[str, str, int, int]], k: float = 32.0, start: float = 1500.0) -> dict[str, float]:
    """Ratings after playing each pair's wins, then its losses, in order."""
    ratings: dict[str, float] = {}
    for a, b, wins, losses in pairs:
        for result in chain(repeat(1.0, wins), repeat(0.0, losses)):
            ra, rb = ratings.setdefault(a, start), ratings.setdefault(b, start)
            expected = 1 / (1 + 10 ** ((rb - ra) / 400))
            ratings[a], ratings[b] = ra + k * (result - expected), rb - k * (result - expected)
    return ratings


#: Games that are unpacked at a time.
_GAMES = 1 << 16


def bootstrap_elo(pairs: list[tuple[str, str, int, int]], spark, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """Mean, deviation and 95 % interval of ratings when pair rows are resampled; replicates are spread over tasks.

    A replicate plays its games in random order.  They are numbers of pair and winner, a byte each up to 128
    pairs, and are shuffled in place.
    """
    kind = np.min_scalar_type(max(2 * len(pairs) - 1, 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch["id"]:
                rng = np.random.default_rng([seed, int(r)])
                drawn = rng.integers(0, len(pairs), len(pairs))
                won, lost = (np.repeat((drawn + side * len(pairs)).astype(kind), [pairs[i][2 + side] for i in drawn]) for side in (0, 1))
                games = np.concatenate([won, lost])
                del won, lost
                rng.shuffle(games)
                single = [(a, b, 1, 0) for a, b, *_ in pairs] + [(a, b, 0, 1) for a, b, *_ in pairs]
                rows += elo_arena(single[g] for lo in range(0, len(games), _GAMES) for g in games[lo : lo + _GAMES].tolist()).items()
            yield pd.DataFrame(rows, columns=["method", "rating"])

    out = spark.range(replicates).mapInPandas(run, "method string, rating double")
    return out.groupBy("method").agg(F.avg("rating").alias("mean"), F.stddev("rating").alias("std"), F.percentile("rating", F.lit(0.025)).alias("low"), F.percentile("rating", F.lit(0.975)).alias("high"))


def pair_means(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(group, key, mean): each text's mean distance to the others of its group; each pair is compared once."""
    a, b = df.select(group, key, text), df.select(F.col(group).alias("g2"), F.col(key).alias("k2"), F.col(text).alias("t2"))
    d = F.levenshtein(F.col(text), F.col("t2")) / F.greatest(F.length(text), F.length("t2"), F.lit(1))
    pairs = a.join(b, (F.col(group) == F.col("g2")) & (F.col(key) < F.col("k2"))).select(group, key, "k2", d.alias("d"))
    both = pairs.select(group, F.explode(F.array(key, "k2")).alias(key), "d")
    return both.groupBy(group, key).agg(F.round(F.avg("d"), 9).alias("mean"))  # equal up to the order of additions is equal


def medoid(df: DataFrame, group: str, key: str, text: str, least: int = 2) -> DataFrame:
    """Each group's text with the least mean distance to the others; the first key wins ties."""
    sized = df.join(df.groupBy(group).count().where(F.col("count") >= least).select(group), group)
    means = pair_means(sized, group, key, text)
    return means.groupBy(group).agg(F.min(F.struct("mean", key)).alias("m")).select(group, F.col(f"m.{key}").alias(key), F.col("m.mean").alias("mean_distance"))


def front_matter_reward(got: dict[str, Column], want: dict[str, Column], parsed: Column) -> Column:
    """0 without front matter, else one half and a tenth for every field that agrees."""
    agree = sum((F.when(got[n].eqNullSafe(want[n]), 0.1).otherwise(0.0) for n in want), F.lit(0.0))
    return F.when(parsed, 0.5 + agree).otherwise(0.0)
