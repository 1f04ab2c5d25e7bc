"""Tables in Markdown and HTML, their grids, relations and similarity."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from docflow.functions.fuzzy import Tree, edit_distance, normalize, ratio, tree_distance


@dataclass
class Grid:
    """Cell texts by row and column, and which rows and columns are headers."""

    cells: list[list[str]]
    header_rows: set[int] = field(default_factory=set)
    header_cols: set[int] = field(default_factory=set)


_ROW = re.compile(r"^\s*\|?.*\|.*$")
_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-*:?\s*)*\|?\s*$")


def markdown_tables(text: str) -> list[Grid]:
    """Runs of two piped lines and more, the rule left out; the first row and column are headers."""
    out: list[Grid] = []
    run: list[str] = []
    for line in [*text.split("\n"), ""]:
        if "|" in line and _ROW.match(line):
            run.append(line)
            continue
        if len(run) >= 2:
            rows = [[c.strip() for c in re.sub(r"^\s*\||\|\s*$", "", r).split("|")] for r in run if not _RULE.match(r)]
            wide = max(map(len, rows), default=0)
            if rows:
                out.append(Grid([r + [""] * (wide - len(r)) for r in rows], {0}, {0}))
        run = []
    return out


class _Tables(HTMLParser):
    """Collects (text, is header, row span, column span) by row and table."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[dict]]] = []
        self.open: list[list[list[dict]]] = []
        self.cell: dict | None = None
        self.head = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        span = lambda k: int(given[k]) if (given.get(k) or "").isdigit() else 1
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif tag == "thead":
            self.head = True
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = {"tag": tag, "text": "", "head": tag == "th" or self.head, "rowspan": span("rowspan"), "colspan": span("colspan")}
            self.open[-1][-1].append(self.cell)
        elif tag == "br" and self.cell is not None:
            self.cell["text"] += " "

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.open.pop()
            self.cell = None
        elif tag == "thead":
            self.head = False
        elif tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell["text"] += data


def html_rows(html: str) -> list[list[list[dict]]]:
    """Tables as rows of cells, spans not expanded."""
    if "<" not in html or "<table" not in html.lower():
        return []
    parser = _Tables()
    parser.feed(html)
    parser.close()
    for table in parser.tables:
        for row in table:
            for cell in row:
                cell["text"] = " ".join(cell["text"].split())
    return parser.tables


def html_tables(html: str) -> list[Grid]:
    """Tables as grids: a row span repeats its text down its first column, other spanned cells are blank."""
    out = []
    for table in html_rows(html):
        placed: dict[tuple[int, int], str] = {}
        heads: dict[tuple[int, int], bool] = {}
        for r, row in enumerate(table):
            k = 0
            for cell in row:
                while (r, k) in placed:
                    k += 1
                for dr in range(cell["rowspan"]):
                    for dc in range(cell["colspan"]):
                        placed[r + dr, k + dc] = cell["text"] if dc == 0 else ""
                        heads[r + dr, k + dc] = cell["head"]
                k += cell["colspan"]
        if placed:
            high, wide = max(r for r, _ in placed) + 1, max(k for _, k in placed) + 1
            cells = [[placed.get((r, k), "") for k in range(wide)] for r in range(high)]
            rows = {r for r in range(high) if all(heads.get((r, k), False) for k in range(wide))}
            cols = {k for k in range(wide) if all(heads.get((r, k), False) for r in range(high) if r not in rows) and high > len(rows)}
            out.append(Grid(cells, rows or {0}, cols or {0}))
    return out


def grid_cells(text: str) -> list[dict]:
    """All cells of all tables of a text as rows."""
    grids = markdown_tables(text) + html_tables(text)
    return [{"table": n, "row": r, "col": k, "text": x, "header": r in g.header_rows or k in g.header_cols} for n, g in enumerate(grids) for r, row in enumerate(g.cells) for k, x in enumerate(row)]


def table_test(text: str, cell: str, max_diffs: int = 0, **near: str | None) -> bool:
    """Whether some table has ``cell`` with the expected neighbours: up, down, left, right, top_heading, left_heading.

    A neighbour beyond the grid's edge is not missed.  Matches are fuzzy, never below one half.
    """

    def like(want: str, got: str) -> bool:
        least, got = max(0.5, 1 - max_diffs / max(len(want), 1)), normalize(got)
        if least >= 1:  # nothing but equal texts is so much alike
            return least == 1 and got == want
        # No more is common than the shorter one has.
        return 2 * min(len(want), len(got)) >= least * (len(want) + len(got)) - 1e-9 and ratio(want, got) >= least

    def heading(values: list[str], want: str) -> bool:
        filled = [v for v in values if v.strip()]
        return any(like(want, v) for v in filled) if filled else False

    for g in markdown_tables(text) + html_tables(text):
        high, wide = len(g.cells), len(g.cells[0])
        for r in range(high):
            for k in range(wide):
                if not like(cell, g.cells[r][k]):
                    continue
                good = all(not near.get(side) or not (0 <= r + dr < high and 0 <= k + dk < wide) or like(near[side], g.cells[r + dr][k + dk]) for side, dr, dk in (("up", -1, 0), ("down", 1, 0), ("left", 0, -1), ("right", 0, 1)))
                if good and near.get("top_heading"):
                    good = heading([g.cells[h][k] for h in sorted(g.header_rows) if h < r], near["top_heading"])
                if good and near.get("left_heading"):
                    good = heading([g.cells[r][h] for h in sorted(g.header_cols) if h < k], near["left_heading"])
                if good:
                    return True
    return False


def table_tree(rows: list[list[dict]], with_text: bool) -> Tree:
    def cell(c: dict) -> Tree:
        below = [Tree("text:" + c["text"])] if with_text and c["text"] else []
        return Tree(f"{c['tag']}:{c['rowspan']}:{c['colspan']}", below)

    return Tree("table", [Tree("tr", [cell(c) for c in row]) for row in rows])


def _replace(a: str, b: str) -> float:
    if a.startswith("text:") and b.startswith("text:"):
        return edit_distance(a[5:], b[5:]) / max(len(a) - 5, len(b) - 5, 1)
    return float(a != b)


def teds(pred: str, target: str, with_text: bool) -> float:
    """Tree-edit similarity of two HTML tables; an inserted or deleted subtree costs one."""
    a, b = ((html_rows(x) or [[]])[0] if x else [] for x in (pred, target))
    if not a and not b:
        return 1.0
    x, y = table_tree(a, with_text), table_tree(b, with_text)
    return max(0.0, 1 - tree_distance(x, y, _replace, lambda t: 1.0) / max(x.size(), y.size(), 1))


def table_scores(pred: list[str], target: list[str]) -> dict[str, float]:
    """Mean similarity of tables paired by place, by structure and with text; 1 without tables."""
    n = max(len(pred), len(target))
    pairs = [(pred[k] if k < len(pred) else "", target[k] if k < len(target) else "") for k in range(n)]
    mean = lambda text: sum(teds(p, t, text) for p, t in pairs) / n if n else 1.0
    return {"teds_structure": mean(False), "teds_text": mean(True)}


def table_f1(pred: list[str], target: list[str], least: float = 0.5) -> dict[str, float] | None:
    """Tables matched greedily by similarity; None without target tables."""
    if not target:
        return None
    free, hits, total = list(range(len(pred))), 0, 0.0
    for t in target:
        best = max(((teds(pred[k], t, True), -k) for k in free), default=None)
        if best and best[0] >= least:
            free.remove(-best[1])
            hits += 1
            total += best[0]
    p, r = hits / len(pred) if pred else 0.0, hits / len(target)
    return {"p": p, "r": r, "f1": 2 * p * r / (p + r) if p and r else 0.0, "avg_sim": total / len(target)}
