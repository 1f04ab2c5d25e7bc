"""Boxes on a page: groups of neighbours, and whether two formulas are laid out alike."""

from __future__ import annotations

import math
import re

#: Directions in which a symbol has a nearest neighbour, as signs along x and y.
SIDES = ((0, -1), (0, 1), (-1, 0), (1, 0))


def merge_boxes(boxes: list[list[float]], tolerance: float = 0.5) -> list[list[float]]:
    """The hull [x0, y0, x1, y1] of each group of boxes that chains of neighbours connect.

    Neighbours are at most ``tolerance`` apart both ways.  Boxes are swept by x, so only
    those that reach the sweep are compared.
    """
    order, root, open_ = sorted(range(len(boxes)), key=lambda k: boxes[k][0]), list(range(len(boxes))), []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in order:
        x0, y0, _, y1 = boxes[k]
        open_ = [j for j in open_ if x0 - boxes[j][2] <= tolerance]
        for j in open_:
            if max(y0, boxes[j][1]) - min(y1, boxes[j][3]) <= tolerance:
                root[top(k)] = top(j)
        open_.append(k)
    hulls: dict[int, list[float]] = {}
    for k, b in enumerate(boxes):
        h = hulls.setdefault(top(k), list(b))
        hulls[top(k)] = [min(h[0], b[0]), min(h[1], b[1]), max(h[2], b[2]), max(h[3], b[3])]
    return list(hulls.values())


def _symbols(spans: list[dict]) -> list[tuple[str, float, float]]:
    """Each character of the spans with its middle; a span's width is shared among its characters."""
    found = []
    for s in spans:
        if s["text"] != "\u200b":
            step = s["w"] / max(len(s["text"]), 1)
            found += [(char, s["x"] + step * k + step / 2, s["y"] + s["h"] / 2) for k, char in enumerate(s["text"])]
    return found


def _nearest(symbols: list[tuple[str, float, float]], tolerance: float) -> list[list[int | None]]:
    """For each symbol its nearest neighbour on each side, off the axis by the tolerance at most; the first of ties."""
    out: list[list[int | None]] = []
    for _, x, y in symbols:
        row: list[int | None] = [None] * len(SIDES)
        least = [math.inf] * len(SIDES)
        for k, (_, ox, oy) in enumerate(symbols):
            across, down = ox - x, oy - y
            for off, ahead, side in ((across, down, 0), (down, across, 2)):
                if ahead and abs(off) <= tolerance:
                    side += ahead > 0
                    if abs(ahead) < least[side]:
                        row[side], least[side] = k, abs(ahead)
        out.append(row)
    return out


def same_layout(reference: list[dict], other: list[dict], tolerance: float = 5) -> bool:
    """Whether each symbol of ``other`` has its own counterpart in ``reference`` with like neighbours.

    Spans have text, x, y, w and h.  A neighbour placed before its symbol must have the
    symbol's neighbour as its counterpart; one that is not yet placed must look the same.
    The reference may have more symbols.  Nothing is found in anything.
    """
    want, have = _symbols(other), _symbols(reference)
    if want == have:
        return True
    near, around = _nearest(want, tolerance), _nearest(have, tolerance)

    def alike(i: int, r: int) -> bool:
        pairs = [(h, q) for h, q in zip(near[i], around[r], strict=True) if h is not None]
        return want[i][0] == have[r][0] and all(q is not None and want[h][0] == have[q][0] for h, q in pairs)

    domains = [[r for r in range(len(have)) if alike(i, r)] for i in range(len(want))]
    if not all(domains):
        return False
    # Each symbol is tried on its domain in turn; the stack holds what is yet to be tried.
    chosen: list[int] = []
    stack = [iter(domains[0])] if domains else []
    while len(chosen) < len(want):
        i, taken = len(chosen), set(chosen)
        fits = lambda r: r not in taken and all(chosen[h] == q for h, q in zip(near[i], around[r], strict=True) if h is not None and h < i)  # noqa: B023, E731
        r = next((r for r in stack[-1] if fits(r)), None)
        if r is not None:
            chosen.append(r)
            if len(chosen) < len(want):
                stack.append(iter(domains[len(chosen)]))
        else:
            stack.pop()
            if not stack:
                return False
            chosen.pop()
    return True


def _markup(text: str) -> str:
    """What a MathML text shows: its semantics without annotations and white space."""
    inner = re.search(r"(?s)<semantics\b[^>]*>(.*)</semantics>", text or "")
    shown = re.sub(r"(?s)<annotation\b.*?</annotation>", "", inner[1]) if inner else text or ""
    return re.sub(r"\s+", "", shown)


def same_formula(reference: dict, other: dict) -> bool:
    """Whether rendered formulas (mathml, spans) agree: one markup holds the other's, or the layouts match."""
    return _markup(reference["mathml"]) in _markup(other["mathml"]) or same_layout(reference["spans"], other["spans"])
