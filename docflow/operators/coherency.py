"""How coherent a text is: the likelihood of its words under a bigram model with back-off."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import text as T

#: Words of a chunk, and the weight of a word's own frequency where a pair is not known.
CHUNK = 50
BACK_OFF = 0.4
#: Times that a pair must stand in the model's texts to be known: once is the scored text itself.
KNOWN = 2
#: Characters of the texts of a block, and words that a task counts at a time.
BLOCK = 1 << 25
COUNTED = 1 << 22

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def _hashes(text: Column) -> Column:
    return F.transform(T.words(text), lambda w: F.xxhash64(w))


def _word_keys(words: np.ndarray) -> np.ndarray:
    """Hashes of words as keys: odd ones."""
    return (words.view(np.uint64) | _ONE).view(np.int64)


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of pairs of words, by their hashes: even ones."""
    return ((a.view(np.uint64) * _STEP + b.view(np.uint64)) & ~_ONE).view(np.int64)


def _flat(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, which of them begin a pair, and how many words each text has."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    words = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.ones(len(words), bool)
    begins[np.cumsum(sizes)[sizes > 0] - 1] = False
    return words, np.flatnonzero(begins), sizes


def _keys(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    words, at, _ = _flat(lists)
    return np.concatenate([_word_keys(words), _pair_keys(words[at], words[at + 1])])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, n) of words and pairs; each many times a task at most as it has stretches of :data:`COUNTED` words."""
    held: list[np.ndarray] = []

    def counts() -> Iterator[pa.RecordBatch]:
        k, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        yield from pa.table({"k": k, "n": n.astype(np.int64)}).to_batches(1 << 16)

    for batch in batches:
        held.append(_keys(batch.column(0)))
        if sum(map(len, held)) >= 2 * COUNTED:
            yield from counts()
    if held:
        yield from counts()


def bigram_model(texts: DataFrame, text: str = "text") -> DataFrame:
    """(k, n): how often each word (odd keys) and each pair of neighbours (even keys) stands in the texts.

    Keys are 63-bit hashes.  Words and pairs are counted in their task before they are shuffled.
    """
    words = texts.where(F.col(text).isNotNull()).select(_hashes(F.col(text)).alias("words"))
    return words.mapInArrow(_counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def _asked(table: pa.Table) -> pa.Table:
    """The distinct keys of a block."""
    keys = np.unique(_keys(table.column("words")))
    return pa.table({"_block": pa.repeat(table.column("_block")[0], len(keys)), "k": keys})


def _scored(key: list[str], chunk: int):
    """What the chunks of a block's texts sum up to, with the counts of the block's keys."""

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        words, at, sizes = _flat(texts.column("words"))
        order = np.argsort(counts.column("k").to_numpy())
        # A last row, of no key, stands for what the model does not know.
        keys = counts.column("k").to_numpy()[order]
        known = np.append(counts.column("n").to_numpy()[order], 0)

        def found(asked: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(asked), np.int64)
            place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            return known[np.where(keys[place] == asked, place, len(keys))]

        singles = found(_word_keys(words))
        both, first, second = found(_pair_keys(words[at], words[at + 1])), singles[at], singles[at + 1]
        told, fallen, rare = both > 0, (both == 0) & (second > 0), (both == 0) & (second == 0)
        value = np.zeros(len(at))
        value[told] = np.log(both[told] / first[told])
        value[fallen] = np.log(second[fallen])
        pairs = np.maximum(sizes - 1, 0)
        chunks = -(-pairs // chunk)
        row = np.repeat(np.arange(len(sizes)), chunks)
        number = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        place = np.arange(len(at)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        own = np.repeat(np.cumsum(chunks) - chunks, pairs) + place // chunk
        count = lambda rows: np.bincount(own[rows], minlength=len(row)).astype(np.int64)
        out = texts.select(key).take(pa.array(row))
        sums = {"chunk": number, "value": np.bincount(own, value, len(row)), "fallen": count(fallen), "rare": count(rare), "n": np.bincount(own, minlength=len(row)).astype(np.int64)}
        for name, column in sums.items():
            out = out.append_column(f"_{name}", pa.array(column))
        return out

    return run


def coherency(texts: DataFrame, key: list[str], model: DataFrame, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(key, coherency, chunks, worst, worst_chunk): the mean over chunks of their words' mean log likelihood.

    A pair that the model does not know falls back to its second word; a word that it does not
    know either counts as the rarest.  Texts of fewer than two words give no row.

    Texts are dealt into blocks of bounded size.  A block asks for the count of each of its distinct words and
    pairs once, and its texts are scored where the counts come back to: no occurrence of a pair is shuffled.
    """
    texts = texts.select(*key, F.col(text).alias("_text")).where("_text IS NOT NULL")
    blocks = (texts.agg(F.sum(F.length("_text"))).first()[0] or 0) // BLOCK + 1
    placed = texts.withColumn("_block", F.pmod(F.xxhash64(*key, "_text"), F.lit(blocks))).repartition("_block")
    placed = placed.select(*key, "_block", _hashes(F.col("_text")).alias("words"))
    asked = placed.groupBy("_block").applyInArrow(_asked, "_block long, k long")
    word = F.col("k").bitwiseAND(1) == 1
    found = asked.join(model.where(word | (F.col("n") >= KNOWN)), "k")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*key).schema)
    scored = placed.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(_scored(key, chunk), f"{schema}, _chunk long, _value double, _fallen long, _rare long, _n long")
    whole = model.where(word).agg(F.sum("n").alias("_total"), F.min("n").alias("_least"))
    total = scored.groupBy(*key, "_chunk").agg(*[F.sum(n).alias(n) for n in ("_value", "_fallen", "_rare", "_n")]).crossJoin(F.broadcast(whole))
    fall = lambda n: F.ln(BACK_OFF * F.lit(n) / F.col("_total"))
    value = F.col("_value") + F.col("_fallen") * fall(1) + F.col("_rare") * fall(F.col("_least"))
    chunks = total.select(*key, F.col("_chunk").alias("chunk"), (value / F.col("_n")).alias("mean"))
    worst = F.min(F.struct(F.round("mean", 9).alias("mean"), "chunk"))
    out = chunks.groupBy(*key).agg(F.avg("mean").alias("coherency"), F.count(F.lit(1)).alias("chunks"), F.min("mean").alias("worst"), worst.alias("w"))
    return out.select(*key, "coherency", "chunks", "worst", F.col("w.chunk").alias("worst_chunk"))


def most_coherent(candidates: DataFrame, key: str, name: str, model: DataFrame, text: str = "text") -> DataFrame:
    """(key, name, coherency): the candidate text of each key that reads best; the least name of equals."""
    found = coherency(candidates, [key, name], model, text)
    best = F.min(F.struct((-F.round("coherency", 9)).alias("loss"), F.col(name).alias("name")))
    return found.groupBy(key).agg(best.alias("best")).select(key, F.col("best.name").alias(name), (-F.col("best.loss")).alias("coherency"))
