"""Fuzzy matching, alignment and tree distance in Python, and how to use them on columns.

Spark has no bounded substring search, alignment or tree distance.  The functions
are plain Python over single values; :func:`row_udf` runs them on Arrow batches.
"""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from docflow.functions.text import FOLD_FROM, FOLD_TO, NORMALIZE_STEPS


def row_udf(fn: Callable, kind: DataType) -> Callable[..., Column]:
    """A column function from ``fn``, whose arguments go by name; nulls arrive as None."""
    arrow = to_arrow_type(kind)

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([fn(**r) for r in rows.to_pylist()], arrow)

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return lambda **columns: F.arrow_udf(run, kind)(F.struct(*[c.alias(n) for n, c in columns.items()]))


_STEPS = [(re.compile(p), n) for p, n in NORMALIZE_STEPS]
_FOLDS = list(zip(FOLD_FROM, FOLD_TO, strict=True))
_SPACE = r"\s+"


def _spaced(text: str) -> str:
    """Runs of white space as one space, at the ends too."""
    words = " ".join(text.split())
    return (" " if text[:1].isspace() else "") + words + (" " if words and text[-1].isspace() else "")


def normalize(text: str | None) -> str | None:
    """Canonical text for comparisons, composed (NFC) and folded."""
    if text is None or (text.isascii() and text.isalnum()):  # letters and digits stay as they are
        return text
    for pattern, new in _STEPS:
        text = _spaced(text) if pattern.pattern == _SPACE else pattern.sub(new, text)
    text = unicodedata.normalize("NFC", text)
    if not text.isascii():
        for old, new in _FOLDS:
            text = text.replace(old, new)
    return text


def _trim(a: str | list, b: str | list) -> tuple[int, int]:
    """Lengths of the common front and, behind it, of the common end."""
    most = min(len(a), len(b))
    front = 0
    while front < most and a[front] == b[front]:
        front += 1
    end = 0
    while end < most - front and a[-1 - end] == b[-1 - end]:
        end += 1
    return front, end


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence with one big integer as the row of the table."""
    front, end = _trim(a, b)
    a, b = a[front : len(a) - end], b[front : len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return front + end + len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity: twice the common subsequence over both lengths."""
    return 1.0 if not a and not b else 2 * lcs_length(a, b) / (len(a) + len(b))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def partial_ratio(query: str, text: str) -> float:
    """The best ratio of the shorter text with any window of its length in the other, edges cut short included.

    All windows go through the table at once: each has a row of bits, 64 a word, and
    a step takes the next character of every window.
    """
    if len(query) > len(text):
        query, text = text, query
    if not query:
        return 1.0 if not text else 0.0
    if query in text:
        return 1.0
    n = len(query)
    # Character numbers; 0 stands for what the query lacks, and for places beyond the text.
    kinds, q = np.unique(_codes(query), return_inverse=True)
    codes = _codes(text)
    at = np.minimum(np.searchsorted(kinds, codes), len(kinds) - 1)
    numbers = np.zeros(len(text) + 2 * (n - 1), np.int64)
    numbers[n - 1 : n - 1 + len(text)] = np.where(kinds[at] == codes, at + 1, 0)
    words = -(-n // 64)
    masks = np.zeros((words, len(kinds) + 1), np.uint64)
    for k, kind in enumerate(q.tolist()):
        masks[k // 64, kind + 1] |= np.uint64(1 << k % 64)
    windows = len(text) + n - 1
    best = 0.0
    for lo in range(0, windows, _WINDOWS):
        hi = min(windows, lo + _WINDOWS)
        rows = [np.full(hi - lo, 2**64 - 1, np.uint64) for _ in range(words)]
        for k in range(n):
            own = numbers[lo + k : hi + k]
            carry = np.uint64(0)
            for w in range(words):
                row = rows[w]
                hit = row & masks[w][own]
                total = row + hit
                over = total < row
                if w:
                    total = total + carry
                    over |= (total < carry) & (carry > 0)
                carry = over.astype(np.uint64)
                rows[w] = total | (row & ~hit)
        rest = np.uint64((1 << (n - 1) % 64 + 1) - 1)
        common = n - sum(np.bitwise_count(rows[w] if w < words - 1 else rows[w] & rest).astype(np.int64) for w in range(words))
        starts = np.arange(lo, hi) - (n - 1)
        lengths = np.minimum(starts + n, len(text)) - np.maximum(starts, 0)
        best = max(best, float((2 * common / (n + lengths)).max()))
    return best


#: Windows whose rows are held at a time.
_WINDOWS = 1 << 16

#: Characters that a piece must have to be looked for; shorter ones stand nearly everywhere.
_PIECE = 4


def _places(pattern: str, text: str, edits: int) -> list[int] | None:
    """Where ``pattern`` may begin in ``text``, up to ``edits`` characters off, if it is there with that many edits.

    It is cut into one piece more than there are edits, one of which stands exactly.  None where pieces
    would be too short to tell.
    """
    n = len(pattern)
    if edits < 0 or n // (edits + 1) < _PIECE:
        return None
    cuts = [k * n // (edits + 1) for k in range(edits + 2)]
    found: set[int] = set()
    for a, b in pairwise(cuts):
        at = text.find(pattern[a:b])
        while at >= 0:
            found.add(at - a)
            at = text.find(pattern[a:b], at + 1)
    return sorted(found)


def holds(query: str, text: str, most: int) -> bool:
    """Whether :func:`partial_ratio` is ``1 - most / len(query)`` or more; only windows around exact pieces are compared."""
    n = len(query)
    if query in text:
        return most >= 0
    places = _places(query, text, 2 * most) if n <= len(text) else None
    if places is not None and not most:
        return False
    # A window begins up to 2 * most away from where a piece puts it, and as much again where the text's end cuts it.
    if places is None or len(places) * (8 * most + 1) > 64 + len(text) // 16:
        return partial_ratio(query, text) >= 1 - most / max(n, 1) - 1e-12
    done: set[int] = set()
    for shift in sorted(range(-4 * most, 4 * most + 1), key=abs):
        for place in places:
            start = place + shift
            if 1 - n <= start < len(text) and start not in done:
                done.add(start)
                window = text[max(start, 0) : start + n]
                if 2 * lcs_length(query, window) * n >= (n - most) * (n + len(window)):
                    return True
    return False


def _ends(pattern: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """For each end in ``text`` the least distance of ``pattern`` to a part that ends there, and that part's start."""
    codes = _codes(text)
    row, origin = np.zeros(len(codes) + 1, np.int64), np.arange(len(codes) + 1)
    steps = np.arange(len(codes) + 1)
    for i, c in enumerate(pattern, 1):
        other = np.empty_like(row)
        from_ = np.empty_like(origin)
        other[0], from_[0] = i, 0
        diagonal, above = row[:-1] + (codes != ord(c)), row[1:] + 1
        other[1:] = np.minimum(diagonal, above)
        from_[1:] = np.where(diagonal <= above, origin[:-1], origin[1:])
        # Insertions run along the row: a running minimum of value - place.
        slack = other - steps
        lowest = np.minimum.accumulate(slack)
        at = np.maximum.accumulate(np.where(slack == lowest, steps, 0))
        row, origin = lowest + steps, from_[at]
    return row, origin


def _near_parts(pattern: str, text: str, most: int, back: bool = False) -> Iterator[list[tuple[int, int, int]]]:
    """The matches of :func:`near_matches` by stretches of the text that have some, from its front or from its end."""
    if not pattern:
        return
    places = _places(pattern, text, most) if most else None
    if places is None:
        if found := _near(pattern, text, most) if most else [(m.start(), m.end(), 0) for m in re.finditer(re.escape(pattern), text)]:
            yield found
        return
    # A match begins up to ``most`` from where a piece puts it, and ends so; what lies before its start does not change it.
    reach, spans = 2 * most, []
    for p in places:
        lo, hi = max(p - reach, 0), p + len(pattern) + reach
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    for lo, hi in reversed(spans) if back else spans:
        if found := (_near_held if hi - lo <= _SHORT else _near)(pattern, text[lo:hi], most):
            yield [(lo + a, lo + b, d) for a, b, d in found]


def near_matches(pattern: str, text: str, most: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of the best places where ``pattern`` occurs with up to ``most`` edits.

    Neighbouring ends of one place give one match, the closest.  An empty pattern has none.
    Read are only the stretches of the text around exact pieces of the pattern, where it has long enough ones.
    """
    return [match for found in _near_parts(pattern, text, most) for match in found]


def near_start(pattern: str, text: str, most: int, last: bool = False) -> int | None:
    """The least start of :func:`near_matches`, or the largest; stretches behind the first that has one are not compared."""
    found = next(_near_parts(pattern, text, most, last), None)
    return (max if last else min)(m[0] for m in found) if found else None


#: Stretches up to this length are compared once where they come again, as repeated lines and other outputs of a page do.
_SHORT = 512


def _near(pattern: str, text: str, most: int) -> list[tuple[int, int, int]]:
    """The matches of :func:`near_matches`, from the whole table."""
    row, origin = _ends(pattern, text)
    return _merged((int(origin[j]), j, int(row[j])) for j in (np.flatnonzero(row[1:] <= most) + 1).tolist())


def _merged(ends: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of neighbouring ends of one place the closest."""
    found: list[tuple[int, int, int]] = []
    for match in ends:
        if found and match[0] < found[-1][1]:
            if match[2] < found[-1][2]:
                found[-1] = match
        else:
            found.append(match)
    return found


@lru_cache(4096)
def _near_held(pattern: str, text: str, most: int) -> list[tuple[int, int, int]]:
    """:func:`_near` of a short text, place by place: cells of the table that are over ``most`` are not followed."""
    n, over = len(pattern), most + 1
    value, origin, deepest = [min(i, over) for i in range(n + 1)], [0] * (n + 1), min(most, n)
    ends: list[tuple[int, int, int]] = []
    for j, c in enumerate(text, 1):
        origin[0] = above_from = j
        above, diagonal, diagonal_from, reached, i = 0, 0, j - 1, 0, 0
        for i in range(1, min(deepest + 1, n) + 1):
            left, left_from = value[i], origin[i]
            v, start = diagonal + (pattern[i - 1] != c), diagonal_from
            if above + 1 < v:
                v, start = above + 1, above_from
            if left + 1 < v:
                v, start = left + 1, left_from
            if v <= most:
                reached = i
            else:
                v = over
            value[i] = above = v
            origin[i] = above_from = start
            diagonal, diagonal_from = left, left_from
        while above < most and i < n:
            i += 1
            value[i] = above = above + 1
            origin[i], reached = above_from, i
        deepest = reached
        if reached == n:
            ends.append((origin[n], j, value[n]))
    return _merged(ends)


def best_substring(needle: str, text: str) -> tuple[int, int, float]:
    """The part of ``text`` closest to ``needle``: (start, end, 1 - distance / length)."""
    if not needle:
        return (0, 0, 1.0)
    row, origin = _ends(needle, text)
    end = int(row.argmin())
    return int(origin[end]), end, float(max(0.0, 1 - row[end] / len(needle)))


#: Cells of an alignment's table that are held at a time.
_CELLS = 1 << 22


def _last_row(x: np.ndarray, y: np.ndarray, match: int, mismatch: int, gap: int) -> np.ndarray:
    """Scores of all of ``x`` against each front of ``y``."""
    steps = np.arange(len(y) + 1) * gap
    row = steps.copy()
    for i, c in enumerate(x, 1):
        best = np.empty_like(row)
        best[0] = i * gap
        best[1:] = np.maximum(row[:-1] + np.where(y == c, match, mismatch), row[1:] + gap)
        row = np.maximum.accumulate(best - steps) + steps
    return row


def _path(x: np.ndarray, y: np.ndarray, match: int, mismatch: int, gap: int) -> list[tuple[int, int]]:
    """Steps (1, 1), (1, 0) and (0, 1) of a best alignment; halves ``x`` while the table would be large."""
    n, m = len(x), len(y)
    if (n + 1) * (m + 1) > _CELLS and n > 1:
        half = n // 2
        ahead = _last_row(x[:half], y, match, mismatch, gap)
        behind = _last_row(x[half:][::-1], y[::-1], match, mismatch, gap)[::-1]
        cut = int((ahead + behind).argmax())
        return _path(x[:half], y[:cut], match, mismatch, gap) + _path(x[half:], y[cut:], match, mismatch, gap)
    steps = np.arange(m + 1) * gap
    table = np.zeros((n + 1, m + 1), np.int64)
    table[0] = steps
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int64)
        best[0] = i * gap
        best[1:] = np.maximum(table[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch), table[i - 1, 1:] + gap)
        table[i] = np.maximum.accumulate(best - steps) + steps
    out = []
    i, j = n, m
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (match if x[i - 1] == y[j - 1] else mismatch):
            step = (1, 1)
        else:
            step = (1, 0) if i and table[i, j] == table[i - 1, j] + gap else (0, 1)
        out.append(step)
        i, j = i - step[0], j - step[1]
    return out[::-1]


def _straight(x: np.ndarray, y: np.ndarray, match: int, mismatch: int, gap: int) -> bool:
    """Whether the alignment without gaps is known to be the only best one, from counts alone.

    No alignment has more matches than both lists have tokens in common, and gaps come in pairs
    in lists of equal length; so one that reaches that number without gaps is better than all others.
    """
    if len(x) != len(y) or match <= mismatch or 2 * gap >= mismatch:
        return False
    size = int(max(x.max(initial=-1), y.max(initial=-1))) + 1
    common = np.minimum(np.bincount(x, minlength=size), np.bincount(y, minlength=size)).sum()
    return bool((x == y).sum() == common)


def align(a: list[str], b: list[str], match: int = 1, mismatch: int = -1, gap: int = -1, fill: str = "▁") -> tuple[list[str], list[str]]:
    """Global alignment of token lists; gaps are filled.  Memory grows with the lists, not with their product."""
    front, end = _trim(a, b)  # equal ends are aligned in some best alignment
    kinds = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([kinds[w] for w in s[front : len(s) - end]], np.int64) for s in (a, b))
    straight = _straight(x, y, match, mismatch, gap)
    path = [(1, 1)] * front + ([(1, 1)] * len(x) if straight else _path(x, y, match, mismatch, gap)) + [(1, 1)] * end
    one, two = iter(a), iter(b)
    return [next(one) if i else fill for i, _ in path], [next(two) if j else fill for _, j in path]


_TOKENS = re.compile(r"[^\W_]+|[^\w\s]|_")


def document_similarity(gold: str, pred: str) -> float:
    """Aligned tokens that agree, over the alignment's length."""
    a, b = align(_TOKENS.findall(gold), _TOKENS.findall(pred))
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a) if a else 1.0


def paragraph_similarity(gold: str, pred: str, window: int = 1, least_gap: int = 3, fill: str = "▁") -> float:
    """Like :func:`document_similarity`, but over the parts around long gaps alone; 1 without such gaps."""
    a, b = align(_TOKENS.findall(gold), _TOKENS.findall(pred))
    spans: list[list[int]] = []
    for side in (a, b):
        k = 0
        while k < len(side):
            end = k
            while end < len(side) and side[end] == fill:
                end += 1
            if end - k >= least_gap:
                spans.append([max(0, k - 10 * window), min(len(a), end + 10 * window)])
            k = max(end, k + 1)
    merged: list[list[int]] = []
    for span in sorted(spans):
        if merged and span[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], span[1])
        else:
            merged.append(span)
    if not merged:
        return 1.0
    return float(np.mean([sum(x == y for x, y in zip(a[s:e], b[s:e], strict=True)) / (e - s) for s, e in merged]))


def replacements(a: str, b: str) -> int | None:
    """The Levenshtein distance, where the places at which two texts of one length differ have no character in common.

    Each of those characters must then go and another come, so nothing is better than to replace them in place.
    None where that does not tell.
    """
    if len(a) != len(b):
        return None
    x, y = _codes(a), _codes(b)
    unlike = x != y
    return int(unlike.sum()) if set(x[unlike].tolist()).isdisjoint(y[unlike].tolist()) else None


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; differences of neighbouring cells are the bits of big integers."""
    if (known := replacements(a, b)) is not None:
        return known
    front, end = _trim(a, b)
    a, b = a[front : len(a) - end], b[front : len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, last, distance = (1 << n) - 1, 1 << (n - 1), n
    rises, falls = full, 0
    for c in b:
        hit = places.get(c, 0)
        down = hit | falls
        across = (((hit & rises) + rises) ^ rises) | hit
        up = falls | (full & ~(across | rises))
        drop = rises & across
        distance += bool(up & last) - bool(drop & last)
        up, drop = (up << 1 | 1) & full, drop << 1 & full
        rises, falls = drop | (full & ~(down | up)), up & down
    return distance


def normalized_distance(a: str | None, b: str | None) -> float | None:
    """Edit distance over the longer length; 0 for two empty texts, none for a null."""
    return None if a is None or b is None else edit_distance(a, b) / max(len(a), len(b), 1)


def match_texts(pred: list[str], target: list[str], most: int) -> tuple[dict[int, int], dict[int, int]]:
    """Each side's items matched to the closest free item of the other within a distance, in order."""

    def one_way(a: list[str], b: list[str]) -> dict[int, int]:
        taken: dict[int, int] = {}
        free = set(range(len(b)))
        for i, x in enumerate(a):
            best = min(((edit_distance(x, b[j]), j) for j in sorted(free)), default=None)
            if best and best[0] <= most:
                taken[i] = best[1]
                free.remove(best[1])
        return taken

    return one_way(pred, target), one_way(target, pred)


def heading_scores(pred: list[dict], target: list[dict], most: int = 3) -> dict[str, float]:
    """Precision and recall of headings by text and by text and level; two empty lists agree."""
    if not pred or not target:
        same = float(not pred and not target)
        return dict.fromkeys(("text_p", "text_r", "level_p", "level_r"), same)
    there, back = match_texts([h["text"] for h in pred], [h["text"] for h in target], most)
    hits = (len(there) + len(back)) / 2
    levels = (sum(pred[i]["level"] == target[j]["level"] for i, j in there.items()) + sum(target[i]["level"] == pred[j]["level"] for i, j in back.items())) / 2
    return {"text_p": hits / len(pred), "text_r": hits / len(target), "level_p": levels / len(pred), "level_r": levels / len(target)}


def bleu(pred: str, target: str, order: int = 4) -> float:
    """BLEU of words with a small count in place of none."""
    a, b = pred.split(), target.split()
    if not a or not b:
        return 0.0
    logs = []
    for n in range(1, order + 1):
        x, y = (Counter(tuple(s[k : k + n]) for k in range(len(s) - n + 1)) for s in (a, b))
        total = max(sum(x.values()), 1)
        logs.append(math.log(max(sum((x & y).values()), 0.1) / total))
    return min(1.0, math.exp(1 - len(b) / len(a)) if len(a) < len(b) else 1.0) * math.exp(sum(logs) / order)


def sequence_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def closest(base: list[str], other: list[str], over: float) -> list[tuple[int, float] | None]:
    """For each text of ``base`` the place and :func:`sequence_ratio` of the best of ``other`` over a bound, the first of equals.

    A text of ``other`` is prepared once; pairs whose upper bounds cannot win are not compared.
    """
    matchers = [difflib.SequenceMatcher(None, "", o.lower()) for o in other]
    out: list[tuple[int, float] | None] = []
    for s in base:
        lower, best, most = s.lower(), None, over
        for k, m in enumerate(matchers):
            m.set_seq1(lower)
            if m.real_quick_ratio() > most and m.quick_ratio() > most and (r := m.ratio()) > most:
                best, most = (k, r), r
        out.append(best)
    return out


def _longest(a: str, b: str, i: int, end: int, lo: int, hi: int) -> tuple[int, int, int]:
    """(start in ``a``, start in ``b``, length) of the longest common part of ``a[i:end]`` and ``b[lo:hi]``, the first in ``a``, then in ``b``.

    Each place of ``a`` is asked for one character more than the best so far, so that the search in ``b`` is the string's own.
    """
    best, size = (i, lo), 0
    while i + size < end:
        j = b.find(a[i : i + size + 1], lo, hi)
        if j < 0:
            i += 1
            continue
        best, size = (i, j), size + 1
        while i + size < end and j + size < hi and a[i + size] == b[j + size]:
            size += 1
    return *best, size


def common_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """The longest common part, and so on to its left and right: the blocks of ``difflib`` without its junk, in order."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i, end, lo, hi = open_.pop()
        if i < end and lo < hi:
            x, y, size = _longest(a, b, i, end, lo, hi)
            if size:
                found.append((x, y, size))
                open_ += [(i, x, lo, y), (x + size, end, y + size, hi)]
    return sorted(found)


def diff_marks(a: str, b: str) -> str:
    """``b`` with what it adds in [+ +] and what it lacks in [- -]."""
    out = []
    i = k = 0
    for j, m, size in [*common_blocks(a, b), (len(a), len(b), 0)]:
        out.append((f"[-{a[i:j]}-]" if j > i else "") + (f"[+{b[k:m]}+]" if m > k else "") + b[m : m + size])
        i, k = j + size, m + size
    return "".join(out)


def adjacency_distance(pred: list[str], target: list[str], most: int = 3) -> tuple[float, int]:
    """Mean distance of blocks compared in order, where up to three neighbours may be merged on either side."""
    i = j = 0
    costs: list[float] = []
    while i < len(pred) and j < len(target):
        options = []
        for p in range(1, min(most, len(pred) - i) + 1):
            for g in range(1, min(most, len(target) - j) + 1):
                a, b = "\n".join(pred[i : i + p]), "\n".join(target[j : j + g])
                options.append((edit_distance(a, b) / max(len(a), len(b), 1), p + g, p, g))
        cost, _, p, g = min(options)
        costs.append(cost)
        i, j = i + p, j + g
    costs += [1.0] * (len(pred) - i + len(target) - j)
    return (float(np.mean(costs)) if costs else 0.0), len(costs)


@dataclass
class Tree:
    """An ordered labelled tree."""

    label: str
    children: list[Tree] = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


def tree_distance(a: Tree, b: Tree, replace: Callable[[str, str], float] = lambda x, y: float(x != y), size: Callable[[Tree], float] = Tree.size) -> float:
    """Distance of ordered trees: roots replace each other, child lists are edited like sequences of subtrees."""
    row = [0.0]
    for y in b.children:
        row.append(row[-1] + size(y))
    for x in a.children:
        gone = size(x)
        new = [row[0] + gone]
        for k, y in enumerate(b.children):
            new.append(min(row[k + 1] + gone, new[k] + size(y), row[k] + tree_distance(x, y, replace, size)))
        row = new
    return replace(a.label, b.label) + row[-1]


def markdown_tree(text: str) -> Tree:
    """Headings by level, with lists, tables, code and paragraphs below them."""
    root = Tree("doc")
    path = [(0, root)]
    last, fenced = "", False
    for line in text.splitlines():
        bare = line.strip()
        if bare.startswith("```"):
            fenced = not fenced
            if fenced:
                path[-1][1].children.append(Tree("code"))
            last = "code"
            continue
        if fenced:
            continue
        if m := re.match(r"(#{1,6})\s", bare):
            level = len(m[1])
            while path[-1][0] >= level:
                path.pop()
            node = Tree(f"h{level}")
            path[-1][1].children.append(node)
            path.append((level, node))
            last = ""
            continue
        kind = "list" if re.match(r"[-*+]\s|\d+\.\s", bare) else "table" if bare.startswith(("|", "<table")) else "p" if bare else ""
        if kind and kind != last:
            path[-1][1].children.append(Tree(kind))
        if kind == "list":
            path[-1][1].children[-1].children.append(Tree("item"))
        last = kind
    return root


def code_tree(text: str) -> Tree:
    """Fenced code by indentation: a line's children are the deeper lines below it."""
    root = Tree("code")
    for body in re.findall(r"```[^\n]*\n(.*?)```", text, re.DOTALL):
        block = Tree("block")
        path = [(-1, block)]
        for line in body.splitlines():
            if not line.strip():
                continue
            depth = len(line) - len(line.lstrip())
            while path[-1][0] >= depth:
                path.pop()
            node = Tree(line.strip().split("(")[0].split()[0])
            path[-1][1].children.append(node)
            path.append((depth, node))
        root.children.append(block)
    return root


def tree_similarity(a: Tree, b: Tree) -> float:
    return max(0.0, 1 - tree_distance(a, b) / max(a.size(), b.size(), 1))
