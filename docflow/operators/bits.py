"""Maps of bits of a fixed size: which rows cannot have a partner, before any of them is shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bit_map(hashes: DataFrame, bits: int) -> np.ndarray:
    """A map of ``2**bits`` bits in which those of the column's hashes (a long) are set.

    Tasks combine the bits of a word, so a word a row at most reaches the driver.
    """
    (name,) = hashes.columns
    word = F.shiftrightunsigned(name, 64 - bits + 6)
    rows = hashes.select(word.alias("word"), F.expr(f"shiftleft(1L, cast({name} & 63 AS INT))").alias("bit"))
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out


def in_map(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes are set: always for those that set them, seldom for others."""
    own = hashes.view(np.uint64)
    shift = np.uint64(64 - (len(words).bit_length() - 1))
    return (words[(own >> shift).astype(np.int64)] >> (own & np.uint64(63))) & np.uint64(1) == 1
