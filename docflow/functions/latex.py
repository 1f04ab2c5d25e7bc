"""LaTeX marks with nested braces, and page elements as one text."""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_MATH = re.compile(r"\$\$.*?\$\$|\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]", re.DOTALL)


def _closing(text: str, at: int) -> int:
    """The place of the brace that closes the one at ``at``, or -1."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if not depth:
            return k
    return -1


def bold_italic(text: str | None) -> str | None:
    """Bold and italic commands outside formulas as Markdown; their braces may nest."""
    if text is None:
        return None

    def plain(part: str) -> str:
        out, at = [], 0
        for m in iter(lambda: re.compile(r"\\text(bf|it)\{").search(part, at), None):
            end = _closing(part, m.end() - 1)
            if end < 0:
                break
            mark = "**" if m[1] == "bf" else "*"
            out += [part[at : m.start()], mark, plain(part[m.end() : end]), mark]
            at = end + 1
        return "".join(out) + part[at:]

    # Formulas are set aside by place, so that marks around them still find their closing brace.
    held: list[str] = []

    def keep(m: re.Match) -> str:
        held.append(m[0])
        return f"\x00{len(held) - 1}\x00"

    return re.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], plain(_MATH.sub(keep, text)))


def _outermost(xs: np.ndarray, ys: np.ndarray, texts: Callable[[int], str], limit: int, seed: int) -> str:
    line = lambda k: f"[{xs[k]:.0f}x{ys[k]:.0f}]{texts(k)}\n"
    edges = dict.fromkeys(int(k) for k in (xs.argmin(), ys.argmin(), xs.argmax(), ys.argmax()))
    rest = [k for k in range(len(xs)) if k not in edges]
    random.Random(seed).shuffle(rest)
    chosen, used = [], 0
    for k in chain(edges, rest):
        own = line(k)
        if used + len(own) > limit:
            break
        chosen.append((xs[k], ys[k], own))
        used += len(own)
    return "".join(e[2] for e in sorted(chosen, key=lambda e: e[:2]))


def linearize(elements: list[dict], limit: int, seed: int) -> str:
    """Elements (x, y, text) within a length: the outermost first, then others in seeded order, written by place."""
    if not elements:
        return ""
    xs, ys = (np.array([e[k] for e in elements], float) for k in ("x", "y"))
    return _outermost(xs, ys, lambda k: elements[k]["text"], limit, seed)


def linearize_column(elements: Column, limit: int, seed: Column) -> Column:
    """:func:`linearize` of an array column; of the texts only those that are written become Python strings."""

    def run(elements: pa.Array, seeds: pa.Array) -> pa.Array:
        out = []
        for row, seed in zip(elements, seeds.to_pylist(), strict=True):
            if not row.is_valid or not len(row.values):
                out.append("")
                continue
            xs, ys = (row.values.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y"))
            texts = row.values.field("text")
            out.append(_outermost(xs, ys, lambda k: texts[k].as_py(), limit, seed))  # noqa: B023
        return pa.array(out, pa.string())

    run.__annotations__ = {"elements": pa.Array, "seeds": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(elements, seed)
