"""Rules against values typed by hand: repairs, LaTeX symbols, protection, columns, reading order, progress, Markdown joins."""

import pytest
from pyspark.sql import functions as F

from leafwright.functions import protect as PR
from leafwright.functions import quality as Q
from leafwright.functions import text as T
from leafwright.operators import corpus as C
from leafwright.operators import layout as L
from leafwright.operators import state as ST


def _of(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.fix_encoding, "eﬃcient ﬁlm", "efficient film"),
        (T.fix_encoding, "frag-\nment, sub- \nset", "fragment, subset"),
        (T.fix_encoding, "an amplication that is eective", "an amplification that is effective"),
        (T.fix_encoding, "lo�st  twice", "lost twice"),
        (T.fix_encoding, "\\rac{1}{2} and \\ ext{a}", "\\frac{1}{2} and \\text{a}"),
        (T.fix_encoding, "\\expigg(x) 1 2. Method", "\\exp\\bigg(x) 2. Method"),
        (T.unicode_to_latex, "αβ ≤ Γ", "$\\alpha$$\\beta$ $\\leq$ $\\Gamma$"),
        (T.unicode_to_latex, "x₁² – 5°", "x$_1$$^2$ - 5$^\\circ$"),
        (T.unicode_to_latex, "Α\xa0ε plain", "A $\\varepsilon$ plain"),
        (T.unicode_to_latex, "nothing here", "nothing here"),
        (T.unicode_to_latex, None, None),
        (PR.join_markdown, "one\n two\n\n# head\n- item\nthree\nfour", "one two\n\n# head\n- item\nthree four"),
        (PR.join_markdown, "text ## Two", "text\n\n## Two"),
        (PR.join_markdown, "$$\nα =\n\n\n$$", "$$ α =\n\n\n$$"),
        (PR.join_markdown, "", ""),
        (PR.join_markdown, None, None),
    ],
)
def test_texts(spark, f, text, want):
    assert _of(spark, f, text) == want


@pytest.mark.parametrize(
    ("f", "text", "originals"),
    [
        (PR.protect_markdown, "at 5 GHz α", ["α", "_P", "_0", "5 GHz"]),
        (PR.protect_markdown, "\\frac{a}{b} and `x y`", ["\\frac{a}{b}", "_P", "_0", "`x y`"]),
        (PR.protect_markdown, "[a](b) and ![c](d)", ["![c](d)", "[a](b)"]),
        (PR.protect_latex, "\\section{A} % note\n$x$ \\cite{k}", ["$x$", "\\cite{k}", "\\section{", "% note"]),
        (PR.protect_commands, "\\SI{5}{m} \\emph{a}", ["\\emph{a}", "\\SI{5}{m}"]),
    ],
)
def test_protection(spark, f, text, originals):
    got = spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("p")).select("p.*", PR.restore(F.col("p.protected"), F.col("p.spans")).alias("back")).first()
    assert [s.original for s in got.spans] == originals and got.back == text


def test_latex_segments(spark):
    text = "Some \\url{x} text\n\\begin{theorem}no\\end{theorem} end % c"
    got = _of(spark, PR.segments, text)
    assert [s.text for s in got if s.translate] == ["Some ", " text\n", " end "]
    assert "".join(s.text for s in got) == text


def _page(spark, rows):
    return spark.createDataFrame([(1, i, float(x), float(y), float(w), 10.0) for i, (x, y, w) in enumerate(rows)], "page int, block int, x double, y double, width double, height double")


def test_columns_and_order(spark):
    two = _page(spark, [(50, 10, 500), (50, 40, 200), (350, 40, 200), (50, 60, 200), (350, 60, 200)])
    assert L.is_two_column(two, 600.0).first().two_columns
    assert [r.block for r in L.reading_order(two, 600.0).orderBy("place").collect()] == [0, 1, 3, 2, 4]
    assert not L.is_two_column(two.where("block <> 4"), 600.0).first().two_columns  # three narrow blocks only
    touching = _page(spark, [(50, 40, 260), (300, 40, 260), (50, 60, 260), (300, 60, 260)])
    assert not L.is_two_column(touching, 600.0).first().two_columns
    lines = _page(spark, [(200, 14, 50), (50, 10, 50), (100, 30, 50), (300, 15, 50)])  # 10 to 15 is one line, as heights are 10
    assert [r.block for r in L.reading_order(lines, 600.0).orderBy("place").collect()] == [1, 0, 3, 2]
    many = _page(spark, [(10 if i % 2 else 400, 10 * i, 150) for i in range(8)])
    assert L.is_two_column(many, 600.0, "layout").first().two_columns
    assert not L.is_two_column(many.where("block < 7"), 600.0, "layout").first().two_columns  # three on one side


def test_progress(spark):
    rows = [("init", 0, 10, 0.0), ("extraction", 0, 10, 10.0), ("translation", 5, 10, 45.0), ("layout", 10, 10, 95.0), ("output", 10, 10, 98.0), ("complete", 10, 10, 100.0), ("failed", 3, 10, 0.0), ("layout", 0, 0, 0.0)]
    d = spark.createDataFrame(rows, "phase string, done int, pages int, want double")
    got = d.select("want", ST.overall_progress(F.col("phase"), F.col("done"), F.col("pages")).alias("got"), ST.can_resume(F.col("phase")).alias("more"), "phase").collect()
    assert [r.got for r in got] == [r.want for r in got] and {r.phase for r in got if not r.more} == {"complete", "failed"}


def test_checks(spark):
    assert _of(spark, Q.garbage_count, "a�b\x07c\tok\n") == 2
    got = _of(spark, Q.headings_in_order, "1. One\ntext\n2.1. Two\n2. Three")
    assert got.headings == ["1", "2.1", "2"] and got.in_order
    assert not _of(spark, Q.headings_in_order, "2. B\n1. A").in_order and _of(spark, Q.headings_in_order, "none").in_order
    log = "ok\n! Undefined\nError: x\nfine!\n"
    got = _of(spark, Q.build_errors, log)
    assert (got.first, got.lines) == ("! Undefined", ["! Undefined", "Error: x", "fine!"])
    d = spark.createDataFrame([("a b c d", "a b c d"), ("a b c d", "x y")], "o string, b string").select(Q.back_translation_check(F.col("o"), F.col("b")).alias("r")).collect()
    assert [r.r.valid for r in d] == [True, False] and d[0].r.score == 100.0


def test_reports_and_languages(spark):
    pages = spark.createDataFrame([(1, "a"), (1, "b�"), (2, "c"), (2, None), (2, "d"), (2, "e")], "doc_id int, text string")
    sources = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "doc_id int, source_pages int")
    got = {r.doc_id: (r.page_count, r.garbage, r.warnings) for r in C.build_report(pages, sources).collect()}
    assert got == {1: (2, 1, "garbage: 1"), 2: (4, 0, "pages grew: 1 to 4"), 3: (0, 0, "no output")}
    g = spark.createDataFrame([("wave", "de", "Welle"), ("field", "de", "Feld"), ("field", "fr", "champ")], "term string, lang string, translation string")
    assert [tuple(r) for r in C.glossary_prompt(g, ["de"]).collect()] == [("de", "  field → Feld\n  wave → Welle")]
    languages = spark.createDataFrame([("German", "de", ["Noto", "Serif"]), ("Odd", "od", [])], "language string, code string, fonts array<string>")
    names = spark.createDataFrame([("GERMAN",), ("de",), ("odd",), ("none",)], "name string")
    assert {r.name: (r.language, r.font) for r in C.find_language(names, languages).collect()} == {"GERMAN": ("German", "Noto"), "de": ("German", "Noto"), "odd": ("Odd", "sans-serif"), "none": (None, "sans-serif")}
