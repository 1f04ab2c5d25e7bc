"""Table functions for SQL."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType


@udtf(useArrow=True)
class WordNgrams:
    """``SELECT * FROM word_ngrams(TABLE(SELECT doc_id, text FROM documents), 3)``.

    A row for each run of n words of each text: the table's first column as ``key``, ``place`` (the
    run's first word, from 0) and ``ngram``.  ``analyze`` takes the key's type from the table and
    asks for its partitioning, so a key's rows are in one task; texts are still taken one by one.  Words
    are what ASCII white space parts.  A null text has none.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) < 2:
            raise ValueError("word_ngrams takes a table of a key and a text")
        if n.value is None or n.value < 1:
            raise ValueError("word_ngrams takes a number of words")
        key = rows.dataType.fields[0]
        layout = StructType([StructField("key", key.dataType), StructField("place", LongType()), StructField("ngram", StringType())])
        return AnalyzeResult(schema=layout, partitionBy=[PartitioningColumn(key.name)])

    def eval(self, row: Row, n: int) -> Iterator[tuple]:
        words = [w.decode() for w in (row[1] or "").encode().split()]
        for k in range(len(words) - n + 1):
            yield row[0], k, " ".join(words[k : k + n])


@udtf(useArrow=True)
class WordNgramCounts:
    """``SELECT key, sum(n), sum(distinct_n) + count(DISTINCT ngram), max(last) FROM word_ngram_counts(TABLE(...), 3) GROUP BY key``.

    What :class:`WordNgrams` finds, counted where it is found: a key with one text gives one row, of how many runs
    (``n``), how many different ones and the last in order.  Where a key has more texts, each text's different runs
    are rows of their own, with ``ngram`` and no ``distinct_n``, so no more than one text is held.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) < 2:
            raise ValueError("word_ngram_counts takes a table of a key and a text")
        if n.value is None or n.value < 1:
            raise ValueError("word_ngram_counts takes a number of words")
        key = rows.dataType.fields[0]
        layout = StructType([StructField("key", key.dataType), StructField("n", LongType()), StructField("distinct_n", LongType()), StructField("last", StringType()), StructField("ngram", StringType())])
        return AnalyzeResult(schema=layout, partitionBy=[PartitioningColumn(key.name)])

    def __init__(self) -> None:
        self.key, self.runs, self.texts = None, Counter(), 0

    def _each(self) -> Iterator[tuple]:
        for g, times in self.runs.items():
            run = g.decode()
            yield self.key, times, 0, run, run

    def eval(self, row: Row, n: int) -> Iterator[tuple]:
        words = (row[1] or "").encode().split()
        runs = Counter(map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)))
        if not runs:
            return
        if self.texts:
            yield from self._each()
        self.key, self.runs, self.texts = row[0], runs, self.texts + 1

    def terminate(self) -> Iterator[tuple]:
        if self.texts == 1:
            yield self.key, self.runs.total(), len(self.runs), max(self.runs).decode(), None
        else:
            yield from self._each()


def register(spark: SparkSession) -> None:
    spark.udtf.register("word_ngrams", WordNgrams)
    spark.udtf.register("word_ngram_counts", WordNgramCounts)
