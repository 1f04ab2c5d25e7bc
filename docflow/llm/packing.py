"""Packing by Karmarkar-Karp multiway differencing.

Documents are tokenized and gathered into blocks of bounded size.  Pieces of a
full sequence are cut off long documents first; the rests are cut into parts of about a
third of a sequence (``PART``) and what is left over, of which a large one gives off an eighth.  A block's parts are dealt to ``k`` windows, ``k``
the fewest that could hold them: partial partitions are merged, those with the largest
imbalance first and in opposite order, which evens the windows out.  Wherever a window
exceeds the capacity, ``k`` rises and all parts are dealt anew, until every window fits.

Whole rests, up to a sequence each, would not come out even: two or three of them fill a
window.  Parts of a third do, with the small ones to even them out, so that ``k`` rises by
under one window in a hundred.
Parts of one document that follow each other in a window are one piece.

Defined results: a null text counts as empty and has only its end id.  Rows that
repeat a ``doc_id`` are separate documents; a null ``doc_id`` stays null.  An
empty table gives an empty result.  Texts of any length are cut, never dropped.
The result depends on how rows are dealt to partitions, not on timing: a
recomputed task gives the same rows.  Other input columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.tokens import encoded, vocabulary_path

SEQUENCE_TOKENS = 2048
#: Tokens that one block holds in memory.
BLOCK_TOKENS = 1 << 20
#: The longest part of a rest, as a part of a sequence.
PART = 700 / 2048
#: Sequence numbers that one partition may use.
_PER_PARTITION = 1 << 40

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items to ``k`` windows of near-equal sums; the items of each window.

    A partial partition is held as its non-empty windows' sums above the smallest,
    in descending order, and the item that each window goes by.  Windows that merge
    form a tree of items, so a merge costs no lists of items.
    """
    n = len(sizes)
    if not n:
        return [[] for _ in range(k)]
    into = np.arange(n)
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        # The largest of one meets the smallest of the other; missing windows are empty ones.
        both = max(len(a) + len(b) - k, 0)
        own = len(b) - both
        sums = np.concatenate([a, b[:own]])
        if both:
            into[y[own:][::-1]] = x[len(a) - both :]
            sums[len(a) - both : len(a)] += b[own:][::-1]
        names = np.concatenate([x, y[:own]])
        order = np.argsort(-sums, kind="stable")
        sums, names = sums[order], names[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        count += 1
        heapq.heappush(heap, (-int(sums[0]), count, sums, names))
    while (into[into] != into).any():
        into = into[into]
    found: dict[int, list[int]] = {}
    for i, name in enumerate(into.tolist()):
        found.setdefault(name, []).append(i)
    return [*found.values(), *([] for _ in range(k - len(found)))]


def pack(lengths: list[int], capacity: int = SEQUENCE_TOKENS, part: float = PART) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length), none over ``capacity``."""
    full, parts = [], []
    longest = max(1, int(capacity * part))
    for n, length in enumerate(lengths):
        whole = length // capacity * capacity
        full += [[(n, at, capacity)] for at in range(0, whole, capacity)]
        parts += [(n, at, size) for at, size in _parts(whole, length, longest)]
    sizes = [p[2] for p in parts]
    k = -(-sum(sizes) // capacity)
    windows: list[list[tuple[int, int, int]]] = []
    while parts:
        windows = [sorted(parts[i] for i in own) for own in differencing(sizes, k)]
        top = max(sum(p[2] for p in own) for own in windows)
        if top <= capacity:
            break
        # Half of what would bring the mean down by the excess: fuller windows come down first.
        k += max(1, -(-k * (top - capacity) // (2 * capacity)))
    return full + [_joined(w) for w in windows if w]


def _parts(start: int, end: int, longest: int) -> list[tuple[int, int]]:
    """Parts (start, length) of a rest: the longest, then what is left; an eighth of that apart if it is large."""
    cuts = [*range(start, end, longest), end]
    if len(cuts) > 1 and cuts[-1] - cuts[-2] > max(longest // 2, 8):
        cuts.insert(-1, end - (end - cuts[-2]) // 8)
    return [(a, b - a) for a, b in pairwise(cuts) if b > a]


def _joined(window: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Parts that follow each other in their document as one piece."""
    out = window[:1]
    for n, at, length in window[1:]:
        m, start, have = out[-1]
        if m == n and start + have == at:
            out[-1] = (n, start, have + length)
        else:
            out.append((n, at, length))
    return out


def _packed(path: str, capacity: int, block_tokens: int):
    def emit(block: list[tuple], first: int) -> tuple[list[pa.RecordBatch], int]:
        rows = []
        sequences = pack([len(ids) for _, ids in block], capacity)
        for s, pieces in enumerate(sequences):
            offset = 0
            for n, at, length in pieces:
                doc_id, ids = block[n]
                rows.append((doc_id, at, length, zlib.crc32(ids[at : at + length].data), len(ids), first + s, offset))
                offset += length
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)], first + len(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) * _PER_PARTITION
        block: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), path), strict=True):
                block.append((doc_id, ids))
                held += len(ids)
                if held >= block_tokens:
                    out, first = emit(block, first)
                    yield from out
                    block, held = [], 0
        if block:
            yield from emit(block, first)[0]

    return run


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = SEQUENCE_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece, see :data:`SCHEMA`; no shuffle, each partition packs its own rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packed(vocabulary or vocabulary_path(), capacity, block_tokens), SCHEMA)
