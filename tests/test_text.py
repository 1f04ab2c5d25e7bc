import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from docflow.functions import fuzzy as Z
from docflow.functions import html as H
from docflow.functions import latex as L
from docflow.functions import tables as G
from docflow.functions import text as X
from docflow.operators import filters as P


def column(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


def test_normalize(spark):
    for raw, want in [("a  b\n c", "a b c"), ("“x” — ‘y’", "\"x\" - 'y'"), ("*bold* **b**", "bold b"), ("_italic__", "italic_"), ("a<br>b<br/>c", "a b c"), ("", "")]:
        assert Z.normalize(raw) == want == column(spark, raw, X.normalize_ascii)
    assert Z.normalize(None) is None and Z.normalize("e\u0301") == "é"


def test_repeat_counts(spark):
    for raw, want in [("a", [1, 0, 0]), ("abab", [1, 2, 1]), ("aabaabaa", [2, 1, 2]), ("abc", [1, 1, 1]), ("", [0, 0, 0])]:
        assert column(spark, raw, lambda c: P.trailing_repeats(c, 3)) == want
    assert column(spark, "a" * 10000, P.trailing_repeats) == [10000, 5000, 3333, 2500, 2000]


def test_baseline(spark):
    check = lambda t, n=None: column(spark, t, lambda c: P.baseline_failure(c, F.lit(n).cast("int")))
    assert check("fine text") is None and check("  ") == "no_alnum" and check("ab" * 100) == "repeats" and check("好") == "disallowed_characters"
    assert check("x", 10) is None and check("x" * 20, 10) == "not_blank"


def test_markdown_tables(spark):
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    assert column(spark, table, P.has_markdown_table) and not column(spark, "a | b\n|---|", P.has_markdown_table)
    assert not column(spark, None, lambda c: F.coalesce(P.has_markdown_table(c), F.lit(False)))
    assert column(spark, f"x\n{table}\ny", X.remove_markdown_tables) == "x\ny"


def test_fuzzy():
    assert Z.ratio("abcd", "abcd") == 1 and Z.ratio("", "") == 1 and Z.ratio("ab", "cd") == 0 and Z.ratio("abc", "abd") == pytest.approx(2 / 3)
    assert Z.partial_ratio("fox", "the quick fox") == 1 and Z.partial_ratio("f0x", "the quick fox jumps") == pytest.approx(2 / 3)
    assert Z.near_matches("kitten", "a sitten b", 1) == [(2, 8, 1)] or Z.near_matches("kitten", "a sitten b", 1)[0][2] == 1
    assert Z.near_matches("ab", "ab ab", 0) == [(0, 2, 0), (3, 5, 0)]
    assert Z.edit_distance("kitten", "sitting") == 3 and Z.edit_distance("", "abc") == 3
    start, end, similarity = Z.best_substring("hello", "say helo there")
    assert "say helo there"[start:end] in ("helo", "helo ") and similarity == pytest.approx(0.8)
    assert Z.align(list("abc"), list("ac")) == (["a", "b", "c"], ["a", "▁", "c"])
    assert Z.match_texts(["aa", "bb"], ["bb", "ax"], 1) == ({0: 1, 1: 0}, {0: 1, 1: 0})
    assert Z.heading_scores([], [])["text_p"] == 1 and Z.heading_scores([], [{"text": "a", "level": 1}])["text_r"] == 0
    assert Z.bleu("a b c d e", "a b c d e") == pytest.approx(1) and Z.sequence_ratio("ABC", "abc") == 1
    assert Z.adjacency_distance(["a", "b"], ["a\nb"]) == (0.0, 1)
    assert Z.diff_marks("abc", "abd") == "ab[-c-][+d+]"


def test_diff_marks_search_strings(monkeypatch):
    # The blocks of difflib, without its table of equal characters.
    draw = random.Random(4)
    texts = ["".join(draw.choices(kinds, k=draw.randrange(40))) for kinds in ("ab", "abc", "etaoin \u00e9\U0001f600") for _ in range(200)]
    wanted = [[tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]] for a, b in zip(texts, texts[1:], strict=False)]
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    for a, b, blocks in zip(texts, texts[1:], wanted, strict=False):
        assert Z.common_blocks(a, b) == blocks
        marked = Z.diff_marks(a, b)
        assert re.sub(r"\[-.*?-\]|\[\+|\+\]", "", marked, flags=re.DOTALL) == b
    assert Z.diff_marks("", "") == "" and Z.diff_marks("", "x") == "[+x+]" and Z.diff_marks("x" * 100_000, "x" * 100_000) == "x" * 100_000


def test_trees():
    a = Z.markdown_tree("# A\ntext\n## B\n- x\n- y")
    assert Z.tree_distance(a, a) == 0 and Z.tree_similarity(a, Z.markdown_tree("# A\ntext")) < 1
    assert Z.tree_similarity(Z.code_tree("```\nif a:\n  b\n```"), Z.code_tree("```\nif a:\n  b\n```")) == 1


MD = "| h1 | h2 | h3 |\n|---|---|---|\n| r1 | a | b |\n| r2 | c | d |"
HTML = "<table><tr><th>h1</th><th>h2</th><th>h3</th></tr><tr><td>r1</td><td>a</td><td>b</td></tr><tr><td>r2</td><td>c</td><td>d</td></tr></table>"


@pytest.mark.parametrize("text", [MD, HTML])
def test_table_relations(text):
    test = lambda cell, **near: G.table_test(text, cell, **near)
    assert test("a", up="h2", down="c", left="r1", right="b") and test("a", top_heading="h2", left_heading="r1")
    assert not test("a", up="h3") and not test("zz") and test("d", down="anything", right="anything")


def test_table_grids():
    grid = G.html_tables("<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td><td>d</td></tr></table>")[0]
    assert grid.cells == [["a", "b", ""], ["a", "c", "d"]]
    assert G.teds(HTML, HTML, True) == 1 and G.teds(HTML, HTML.replace("<td>d</td>", ""), False) < 1
    assert G.table_scores([], []) == {"teds_structure": 1.0, "teds_text": 1.0} and G.table_f1([], []) is None and G.table_f1([], [HTML])["f1"] == 0


def test_html_pages():
    page = '<html lang="pt-BR"><body><header>My site name</header><h1>T</h1><p>First sentence here. Second sentence here.</p><p>x<sup>2</sup></p><footer>Page 7 of 9</footer></body></html>'
    text = H.to_page(page)
    assert "primary_language: pt" in text and "# T" in text and "x²" in text and "My site" not in text
    kinds = [t["type"] for t in H.mine_tests(page, "p")]
    assert kinds.count("absent") == 2 and "order" in kinds
    assert H.to_markdown(None) == "" and H.metadata("")["primary_language"] == "en"


def test_latex():
    assert L.bold_italic(r"\textbf{a \textit{b}} $\textbf{x}$ \textbf{open") == r"**a *b*** $\textbf{x}$ \textbf{open"
    assert L.linearize([], 10, 0) == "" and L.linearize([{"x": 1.0, "y": 2.0, "text": "a"}], 100, 0) == "[1x2]a\n"


def test_front_matter(spark):
    parsed = column(spark, "---\nprimary_language: en\nis_table: False\n---\nbody", X.parse_front_matter)
    assert parsed["front"] == {"primary_language": "en", "is_table": "False"} and parsed["body"] == "body"
    assert column(spark, "no front", X.parse_front_matter)["front"] is None
    assert column(spark, "a $x$ and $$y$$", X.normalize_latex_brackets) == r"a \(x\) and \[y\]"
