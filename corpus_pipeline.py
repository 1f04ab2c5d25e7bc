"""A corpus pipeline of five stages, each one operator on what its predecessor kept.

Quality rules, exact dedup, near dedup, substring dedup, packing.  All stages but
the last return the columns of ``documents``.

Defined results: rows are judged one by one, also where ids are null or repeat: of
rows with equal texts one stays.  A null text fails the quality rules.  An empty table
gives an empty result.  Extra columns, of any name, are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import materialize
from docflow.llm.exact_dedup import exact_dedup
from docflow.llm.minhash_dedup import near_duplicates
from docflow.llm.packing import pack_documents
from docflow.llm.quality_rules import quality_rules
from docflow.llm.substring_dedup import substring_dedup

#: Percent of their 5-word shingles that near copies share at least.
NEAR_PERCENT = 80


def _only(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps (by doc_id and kept).

    Where ids are null or repeat, rows are judged by numbers of their own, in the
    order of their ids (null first), so that each row has its own verdict.
    """
    key = f"row_{uuid.uuid4().hex}"
    own = F.col("doc_id").cast("long")
    repeated = docs.groupBy(own.alias(key)).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).count()
    if repeated:
        order = [own, F.xxhash64("text")]
        rows = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id())
        rows = materialize(rows, "pipeline-rows")
    else:
        rows = docs.withColumn(key, own)
    kept = judge(rows.withColumn("doc_id", F.col(key))).where("kept").select(F.col("doc_id").alias(f"{key}_kept"))
    return rows.join(kept, F.col(key) == F.col(f"{key}_kept"), "left_semi").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, quality_rules)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, exact_dedup)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, lambda rows: near_duplicates(rows, NEAR_PERCENT))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    changed = substring_dedup(docs, result=f"dedup_{uuid.uuid4().hex}").select(docs.columns)
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("substring_dedup", substrings),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
