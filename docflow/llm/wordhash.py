"""Vectorised hashes of the words in an Arrow batch of texts.

Words are the runs of bytes outside space and 0x09-0x0D, as in the contract's
``[^\\x20\\x09-\\x0D]+`` (UTF-8 never uses those bytes inside a character).  A
word's hash is the polynomial ``sum(T[byte] * R**k)`` modulo 2**64 over random
byte values ``T``, then mixed.  Two independent hashes make a 128-bit name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time; longer texts, and words, are hashed in parts.
SLICE = 1 << 20

_rng = np.random.default_rng(20240229)
_VALUES = [_rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = [int(x) | 1 for x in _rng.integers(2**62, 2**63, 2, dtype=np.uint64)]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.arange(256, dtype=np.uint8)
_LOWER = _UPPER.copy()
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base % 2**64
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % 2**64
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hashes(data: np.ndarray, first: np.ndarray, table: np.ndarray, both: bool) -> list[np.ndarray]:
    """Unmixed hashes of words that begin at ``first`` (in ``data``) and may have spaces behind."""
    within = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
    space = _IS_SPACE[data]
    longest = int(within[~space].max(initial=0)) + 1
    within[space] = 0
    out = []
    for k in range(1 + both):
        if len(_powers[k]) < longest:
            _powers[k] = powers(_BASES[k], longest)
        values = table[k][data]
        values *= _powers[k][within]
        values[space] = 0
        out.append(np.add.reduceat(values, first))
    return out


def word_hashes(texts: pa.Array, lower: bool = False, both: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (n + 1)."""
    raw, offsets = buffers(texts)
    table = [v[_LOWER if lower else _UPPER] for v in _VALUES]
    parts: list[list[np.ndarray]] = [[] for _ in range(1 + both)]
    counts = np.zeros(len(offsets) - 1, np.int64)
    k = 0
    while k < len(counts):
        last = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, "right")) - 1)
        lo, hi = int(offsets[k]), int(offsets[last])
        at = lo
        length = 0  # of the word that the last part ends in
        while at < hi:
            to = min(hi, at + SLICE)
            data = raw[at:to]
            space = _IS_SPACE[data]
            begins = ~space
            begins[1:] &= space[:-1]
            edges = offsets[k:last]
            edges = edges[(edges >= at) & (edges < to)] - at
            begins[edges] = ~space[edges]
            first = np.flatnonzero(begins)
            if len(first):
                hashes = _hashes(data[first[0] :], first - first[0], table, both)
                tail = len(data) - int(first[-1])
                goes_on = at > lo and length > 0 and first[0] == 0
                if goes_on:  # only one text is cut here, so the last word found is the one that goes on
                    for part, h, base in zip(parts, hashes, _BASES, strict=False):
                        part[-1][-1:] += h[:1] * np.uint64(pow(base, length, 2**64))
                    tail += length if len(first) == 1 else 0
                    first, hashes = first[1:], [h[1:] for h in hashes]
                length = 0 if space[-1] else tail
            else:
                length = 0
            if len(first):
                owner = np.searchsorted(offsets, first + at, "right") - 1
                counts += np.bincount(owner, minlength=len(counts))
                for part, h in zip(parts, hashes, strict=True):
                    part.append(h)
            at = to
        k = last
    return [mix(np.concatenate(p)) if p else np.zeros(0, np.uint64) for p in parts], np.concatenate([[0], np.cumsum(counts)])


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of one text begin and end, in bytes."""
    change = np.diff(np.concatenate([[True], _IS_SPACE[data], [True]]).astype(np.int8))
    return np.flatnonzero(change < 0), np.flatnonzero(change > 0)


def squeezed(text: memoryview) -> Iterator[bytes]:
    """A text's words joined by one space, in pieces; no text is held as a list of words whole."""
    first, inside = True, False
    for at in range(0, len(text), SLICE):
        piece = bytes(text[at : at + SLICE])
        body = b" ".join(piece.split())
        if body:
            yield body if first or (inside and not piece[:1].isspace()) else b" " + body
            first = False
        inside = not piece[-1:].isspace()


def named(text: memoryview, make=hashlib.sha256) -> tuple[bytes, int]:
    """The digest of a text's words joined by one space, and their number."""
    digest, spaces, some = make(), 0, 0
    for piece in squeezed(text):
        digest.update(piece)
        spaces += piece.count(b" ")
        some = 1
    return digest.digest(), spaces + some


def window_hashes(words: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``width`` words, boundaries ignored."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(base)
        out += words[k : k + n]
    return mix(out)


def whole_windows(begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows inside one text start (in all words), and their text."""
    counts = np.diff(begins)
    n = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), n)
    if not len(owner):
        return np.zeros(0, np.int64), owner
    ahead = np.cumsum(n) - n
    return np.arange(len(owner)) - np.repeat(ahead - begins[:-1], n), owner


def groups(texts: pa.Array, limit: int = 4 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together, one text at least."""
    _, at = buffers(texts)
    out, k = [], 0
    while k < len(texts):
        last = max(k + 1, int(np.searchsorted(at, at[k] + limit, "right")) - 1)
        out.append((k, last))
        k = last
    return out


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    at = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
