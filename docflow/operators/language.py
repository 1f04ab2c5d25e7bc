"""The language of a text from character trigrams: profiles counted from labelled texts, scored by a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from docflow.operators.scratch import written

#: A trigram is in a language's profile if it is one in so many of the language's: so a profile has that many at most.
PROFILE = 5000
#: Rows of a profile table (trigrams of all languages) up to which it is broadcast, and languages at most.
BROADCAST_ROWS = 500_000
#: Scores of a profile table (trigrams times languages) up to which each task holds it as an array (64 MB).
HELD_SCORES = 8_000_000
LANGUAGES = 256
#: Trigrams that a verdict needs, and the lead of the best language over the next for each of them.
LEAST_GRAMS = 12
LEAST_LEAD = 0.05
UNKNOWN = "unknown"


def words(text: Column) -> Column:
    """Runs of letters in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _grams(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit("_"), w, F.lit("_")), i, F.lit(3)))


def trigrams(text: Column) -> Column:
    """Trigrams of the words of ``text`` with a mark on either side."""
    return F.flatten(F.transform(words(text), _grams))


def profiles(labelled: DataFrame, lang: str = "lang", text: str = "text") -> tuple[DataFrame, list[str]]:
    """(gram, s0, s1, ...): the smoothed log likelihood of each profile trigram by language, and the languages.

    The grams are those that are frequent in some language; each is scored under all.  Rows
    without a language or a text teach nothing.
    """
    # Words count before their trigrams do, so that a word is cut up once; what is left is read four times and small.
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(words(F.col(text))).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    counts = written(rows.select("lang", F.explode(_grams(F.col("w"))).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    names = sorted(r["lang"] for r in totals.select("lang").limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    frequent = counts.join(F.broadcast(totals), "lang").where(F.col("n") * PROFILE >= F.col("total")).select("gram").distinct()
    table = counts.join(frequent, "gram").groupBy("gram").pivot("lang", names or ["none"]).agg(F.first("n"))
    table = table.select("gram", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(f"n{k}") for k, n in enumerate(names)])
    sums = table.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"n{k}").alias(f"t{k}") for k in range(len(names))])
    scores = [F.ln((F.col(f"n{k}") + 1) / (F.col(f"t{k}") + F.col("v"))).alias(f"s{k}") for k in range(len(names))]
    return table.crossJoin(F.broadcast(sums)).select("gram", *scores), names


def _scored(table: pa.Table, fixed: StructType):
    """Sums of the profile's scores over the trigrams of each text; the last column is words between marks, the rest goes by."""
    code = lambda x: x[..., 0] << 42 | x[..., 1] << 21 | x[..., 2]
    points = lambda x: np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.int64)
    grams = code(points("".join(table.column(0).to_pylist())).reshape(-1, 3))
    order = grams.argsort()
    grams, scores = grams[order], np.stack([c.to_numpy() for c in table.columns[1:]], 1)[order] if table.num_columns > 1 else np.zeros((len(grams), 0))
    schema = to_arrow_schema(StructType([*fixed.fields, StructField("grams", LongType()), *(StructField(f"s{k}", DoubleType()) for k in range(scores.shape[1]))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, scores.shape[1]))
            for k, marked in enumerate(batch.column(batch.num_columns - 1)):
                own = np.lib.stride_tricks.sliding_window_view(points(marked.as_py()), 3) if marked.is_valid and len(grams) and len(marked.as_py()) > 2 else None
                if own is None:
                    continue
                mark = own == ord("_")
                found = code(own[~(mark[:, 1] & (mark[:, 0] | mark[:, 2]))])
                at = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
                at = at[grams[at] == found]
                counts[k], sums[k] = len(at), scores[at].sum(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts), *(pa.array(sums[:, k]) for k in range(sums.shape[1]))], schema=schema)

    return run


def detect(docs: DataFrame, key: str, table: DataFrame, names: list[str], text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, grams, language, lead) and the columns ``keep``: the likeliest language of each document.

    ``grams`` counts the profile's trigrams in the text.  The language is "unknown" where they are
    fewer than :data:`LEAST_GRAMS` or the best leads the next by less than
    :data:`LEAST_LEAD` for each.  Keys are unique; a null or empty text has no trigrams.
    A profile of bounded size is looked up where the text lies; a larger one is joined.
    """
    table = written(table, "language-profile")
    sums = [f"s{k}" for k in range(len(names))]
    size = table.limit(max(BROADCAST_ROWS, HELD_SCORES) + 1).count()
    if size * max(len(names), 1) <= HELD_SCORES:
        rows = docs.select(key, *keep, F.concat(F.lit("_"), F.regexp_replace(F.lower(text), r"[^\p{L}]+", "__"), F.lit("_")).alias("marked"))
        fixed = StructType(rows.schema.fields[:-1])
        layout = StructType([*fixed.fields, StructField("grams", LongType()), *(StructField(n, DoubleType()) for n in sums)])
        found = rows.mapInArrow(_scored(table.toArrow(), fixed), layout)
    else:
        near = F.broadcast(table) if size <= BROADCAST_ROWS else table
        rows = docs.select(F.col(key).alias("scored"), F.explode(trigrams(F.col(text))).alias("gram")).join(near, "gram")
        own = rows.groupBy("scored").agg(F.count(F.lit(1)).alias("grams"), *[F.sum(n).alias(n) for n in sums])
        found = docs.select(key, *keep).join(own, F.col(key) == F.col("scored"), "left")
    share = lambda k: -F.round(F.col(f"s{k}") / F.nullif("grams", F.lit(0)), 9)
    ranked = F.array_sort(F.array(*[F.struct(share(k).alias("loss"), F.lit(n).alias("name")) for k, n in enumerate(names)])) if names else F.array().cast("array<struct<loss:double,name:string>>")
    lead = F.get("ranked", F.lit(1))["loss"] - F.get("ranked", F.lit(0))["loss"]
    out = found.withColumn("ranked", ranked).select(key, *keep, F.coalesce("grams", F.lit(0)).alias("grams"), F.get("ranked", F.lit(0))["name"].alias("best"), lead.alias("lead"))
    sure = (F.col("grams") >= LEAST_GRAMS) & (F.coalesce("lead", F.lit(0.0)) >= LEAST_LEAD)
    return out.select(key, *keep, "grams", F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("language"), F.round("lead", 6).alias("lead"))
