"""Python functions over columns hold a piece of a batch at a time, whatever the batch."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafwright.functions import batches
from leafwright.functions import protect as PR
from leafwright.functions import quality as Q
from leafwright.functions import rules as R
from leafwright.functions import text as T
from leafwright.operators import corpus


def test_cut():
    assert list(batches.cut(pa.array([3, 3, None, 9, 1, 1]), 6)) == [(0, 3), (3, 1), (4, 2)]
    assert list(batches.cut(pa.array([], "int32"), 6)) == []


def _stages(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces(spark):
    seen = []
    f = batches.over_texts(lambda t: seen.append(t) or t, "string").func
    texts = ["x" * 1000, None] * 2000
    made = f(iter([pa.array(texts), pa.array([], "string")]))
    first = next(made)
    assert 0 < len(seen) <= batches.PIECE_BYTES // 1000 and len(first) < 1000
    assert [t for a in [first, *made] for t in a.to_pylist()] == texts


def test_repair_sees_what_later_matches_left(spark):
    rules = [("pair", "ab", "<long>"), ("callable", "For r", lambda m, t: f"{len(t)}")]
    text = "ab" * 30 + " For r $ab$ ab For r"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(PR.repair(F.col("t"), rules).alias("p")).select("p.*").collect()

    def by_hand(t):
        actions = []
        for name, old, new in rules:
            for at in reversed([i for i in range(len(t)) if t.startswith(old, i)]):
                if t[at - 1 : at] != "$":
                    fixed = new(None, t) if callable(new) else new
                    actions.append((name, old, fixed, t[max(0, at - 20) : at + len(old) + 20]))
                    t = t[:at] + fixed + t[at + len(old) :]
        return t, actions

    assert (got[0].text, [tuple(a) for a in got[0].actions]) == by_hand(text)
    assert (got[1].text, got[1].actions) == (None, [])


@pytest.mark.parametrize("f", [PR.protect, PR.repair, PR.normalize_text, PR.join_markdown], ids=["formula_extract, protect_restore_roundtrip", "damage_repair", "nfkc_normalize", "markdown_joined"])
def test_functions_of_texts_are_cut(spark, f):
    assert "pandas" not in _stages(spark.range(3).select(f(F.col("id").cast("string")))).lower() and "ArrowEvalPython" in _stages(spark.range(3).select(f(F.col("id").cast("string"))))
    texts = [f"{i} $x$ a?b" + "\n# A\n" * 50 for i in range(3000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [tuple(r) for r in frame.coalesce(1).select("i", f(F.col("t"))).collect()] == [tuple(r) for r in frame.repartition(40).select("i", f(F.col("t"))).orderBy("i").collect()]


ODD = ["", None, "$", "$$", "$a$", "$$a$$ $b$$c$ \n$$", "$$$", "$$$$", "$$$x$$$$", "a\\[b\\]\\(c\n\\) \\begin{equation}x\\end{equation}\\begin{align*}\ny\\end{align*}", "αΣ∑²₃ [4, 33] [5] Fig. 3 Figure4 Fig 5 Eq. (2) Eq.(3)", "é😀⁻₋−–", "Α\xa0ε ﬁlm  � -\nx {rac{", "\\α heta 1 2.²"]


def test_formula_inventory_counts(spark):
    frame = spark.createDataFrame(list(enumerate(ODD)), "i int, t string")
    c = F.col("t")
    plan = frame.select(T.formula_count(c).alias("n"), F.size(T.formulas(c)).alias("m"), Q.formula_symbols(c).alias("s"), T.count_any(c, R.PAIR_FORMULAS).alias("u"), Q.references(c).alias("r"), T.count_any(c, R.PAIR_REFERENCES).alias("v"))
    rows = plan.collect()
    assert [(r.n, r.s, r.r) for r in rows] == [(r.m, r.u, r.v) for r in rows]
    assert _stages(frame.select(Q.formula_symbols(c).alias("s"))).count("[αβ") == 1  # one search for all sets of characters


def test_latex_symbols_is_the_chain(spark):
    frame = spark.createDataFrame(list(enumerate([*ODD, "".join(R.LATEX_SYMBOLS), "".join(R.EXTRACTION_DAMAGE)])), "i int, t string")
    rows = frame.select(T.latex_text(F.col("t")).alias("a"), T.fix_encoding(T.unicode_to_latex(F.col("t"))).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_near_duplicate_join_reads_blocks_once(spark, tmp_path):
    import random

    random.seed(3)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(random.choices(words, weights=range(1, 41), k=n))
    rows = lambda n, most: [(i, text(random.randrange(0, most))) for i in range(n)]
    blocks, paragraphs = [*rows(300, 60), (300, None)], rows(30, 25)
    spark.createDataFrame(blocks, "block_id long, text string").write.parquet(str(tmp_path / "b"))
    found = corpus.best_match(spark.read.parquet(str(tmp_path / "b")), spark.createDataFrame(paragraphs, "para_id long, text string"))
    got = {r.block_id: (r.para_id, round(r.score, 9)) for r in found.collect()}
    want = {}
    for i, t in blocks:
        own = set((t or "").split())
        scores = [(len(own & set(p.split())) / max(len(own), len(set(p.split())), 1), -k) for k, p in paragraphs]
        if max(scores)[0] > 0.3:
            want[i] = (-max(scores)[1], round(max(scores)[0], 9))
    assert got == want and len(want) > 20
    final = found._jdf.queryExecution().executedPlan().toString()
    assert final.split("Initial Plan")[0].count("Scan parquet") - final.split("Initial Plan")[0].count("ReusedExchange") <= 1
