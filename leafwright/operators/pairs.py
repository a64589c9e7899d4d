"""Text pairs and document scores: J3, J12, J15, W1-W3, A1-A5, Q, A2, J11, U8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.functions import quality as Q
from leafwright.functions import rules as R
from leafwright.functions import text as T


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """J3 over turns: each user turn with the assistant turn that follows it at once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = conversations.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    return t.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("original"), F.col("next_text").alias("translated"))


def zip_blocks(left: DataFrame, right: DataFrame, doc: str = "doc_id", index: str = "block_idx") -> DataFrame:
    """Blocks of the same place of two versions; the longer side's rest is left out."""
    return left.join(right, [doc, index])


def score_pairs(pairs: DataFrame, semantic: Column | None = None) -> DataFrame:
    """Q11-Q16 of each pair (original, translated)."""
    o, t = F.col("original"), F.col("translated")
    x = pairs.withColumns({"completeness": Q.completeness(o, t), "similarity": Q.similarity(o, t), "formula_score": Q.formula_score(o, t), "n_formulas": F.size(T.formulas(o))})
    s = F.lit(R.UNTESTED_SEMANTIC) if semantic is None else semantic
    x = x.withColumn("overall", Q.overall(F.col("formula_score"), s, F.col("completeness"), F.lit(R.BLOCK_TERMINOLOGY)))
    return x.withColumns({"level": Q.level(F.col("overall")), "passed": F.col("overall") >= 60})


def document_quality(scored: DataFrame, doc: str) -> DataFrame:
    """A1 over scored pairs: means, counts, weighted overall and level of each document."""
    g = scored.groupBy(doc).agg(F.count("*").alias("n_blocks"), *[F.avg(c).alias(c) for c in ("completeness", "similarity", "formula_score")], F.sum("n_formulas").alias("n_formulas"))
    g = g.withColumn("overall", Q.overall(F.col("formula_score"), F.lit(R.UNTESTED_SEMANTIC), F.col("completeness"), F.lit(R.BLOCK_TERMINOLOGY)))
    return g.withColumn("level", Q.level(F.col("overall")))


def term_usage(pairs: DataFrame, doc: str) -> DataFrame:
    """doc, term, kept: whether a term of the original stands in the translation as it is, once for each pair."""
    x = pairs.select(doc, "translated", F.explode(T.technical_terms(F.col("original"))).alias("term"))
    return x.select(doc, "term", F.contains("translated", F.col("term")).alias("kept"))


def term_consistency(pairs: DataFrame, doc: str) -> DataFrame:
    """A2: 100 * (1 - inconsistent / terms) for each document that has terms."""
    terms = term_usage(pairs, doc).groupBy(doc, "term").agg((F.count_distinct("kept") > 1).alias("mixed"))
    return terms.groupBy(doc).agg(F.count("*").alias("terms"), F.count_if("mixed").alias("inconsistent")).withColumn("score", F.lit(100.0) * (1 - F.col("inconsistent") / F.col("terms")))


def inconsistent_terms(pairs: DataFrame) -> DataFrame:
    """A2b over all pairs: terms used both ways, with the number of uses."""
    return term_usage(pairs.withColumn("_all", F.lit(0)), "_all").groupBy("term").agg(F.count("*").alias("uses"), F.count_if("kept").alias("kept")).where("kept > 0 and kept < uses")


#: Terms that go to every task as one array; beyond, Spark joins them.
MOST_TERMS = 10_000


def needs_refinement(pairs: DataFrame) -> DataFrame:
    """Pairs whose original holds an inconsistent term, without regard to case.

    A term may stand inside a word, so this is no join on words: up to MOST_TERMS terms are one array that every row is held against.
    """
    bad = inconsistent_terms(pairs).select(F.lower("term").alias("t")).distinct()
    if bad.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        return pairs.join(bad, F.contains(F.lower("original"), F.col("t")), "left_semi")
    terms = bad.agg(F.collect_list("t").alias("_terms"))
    low = F.lower("original")
    return pairs.crossJoin(F.broadcast(terms)).where(F.exists("_terms", lambda t: F.contains(low, t))).drop("_terms")


def aligned_sentences(pairs: DataFrame) -> DataFrame:
    """Sentence by sentence where both sides have as many; acronym_mappings has what maps to itself."""
    cut = lambda c: F.filter(F.split(c, r"[.!?]+(?:\s+|$)"), lambda s: T.strip(s) != "")
    x = pairs.withColumns({"so": cut(F.col("original")), "st": cut(F.col("translated"))}).where("size(so) = size(st) and size(so) > 0")
    return x.select("conv_id", "turn", F.posexplode(F.arrays_zip("so", "st")).alias("idx", "z")).select("conv_id", "turn", "idx", F.col("z.so").alias("source"), F.col("z.st").alias("target"))


def acronym_mappings(pairs: DataFrame) -> DataFrame:
    """Where both sides have as many sentences, each term in capitals that the translation of its first sentence has as well."""
    x = pairs.withColumns({"so": F.split("original", r"[.!?]\s+"), "st": F.split("translated", r"[.!?]\s+")}).where("size(so) = size(st)")
    x = x.select("*", F.explode(T.technical_terms(F.col("original"), two_pass=True)).alias("term")).where(F.col("term").rlike(r"\p{Lu}") & (F.col("term") == F.upper("term")))
    both = F.filter(F.arrays_zip("so", "st"), lambda z: F.contains(F.lower(z["so"]), F.lower(F.col("term"))))
    return x.where(F.contains(F.get(both, F.lit(0))["st"], F.col("term"))).select("conv_id", "turn", "term", F.col("term").alias("translation"))


def context_window(blocks: DataFrame, doc: str, order: str, n: int = 3) -> DataFrame:
    """N translated neighbours on both sides, 200 characters each, the current block marked, joined by ---."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(-n, n)
    x = blocks.withColumn("w", F.collect_list(F.struct(F.col(order).alias("o"), F.substring("text", 1, 200).alias("x"))).over(w))
    parts = F.transform("w", lambda s: F.when(s["o"] == F.col(order), F.concat(F.lit("[CURRENT] "), s["x"])).otherwise(s["x"]))
    return x.select(doc, order, F.array_join(parts, "\n---\n").alias("context"))


def translation_memory(pairs: DataFrame, doc: str, order: str) -> DataFrame:
    """Of the last five pairs over 20 characters on both sides the last three, 100 characters each."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(-5, -1)
    long_ = pairs.where((F.length("original") > 20) & (F.length("translated") > 20))
    x = long_.withColumn("m", F.collect_list(F.concat(F.substring("original", 1, 100), F.lit(" => "), F.substring("translated", 1, 100))).over(w))
    return x.select(doc, order, F.array_join(F.expr("slice(m, greatest(size(m) - 2, 1), 3)"), "\n").alias("memory"))


def tail_context(blocks: DataFrame, doc: str, order: str, size: int = 400) -> DataFrame:
    """The last characters of the block before."""
    return blocks.select(doc, order, F.coalesce(F.right(F.lag("text").over(Window.partitionBy(doc).orderBy(order)), F.lit(size)), F.lit("")).alias("context"))


def prefer_extraction(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The first text if it has formulas and 60 % of the second's length, else the longer one."""
    x = first.select(key, F.col("text").alias("a")).join(second.select(key, F.col("text").alias("b")), key, "full")
    a, b = F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))
    return x.select(key, F.when(a.rlike(r"[$\\]") & (F.length(a) >= 0.6 * F.length(b)), a).when(F.length(a) >= F.length(b), a).otherwise(b).alias("text"))


def validate_documents(pairs: DataFrame, doc: str) -> DataFrame:
    """A3-A5, Q10: mean block score (after the automatic fix where that is better), and issues by severity."""
    t = F.col("translated")
    issues = F.concat(Q.latex_issues(t), Q.pair_issues(F.col("original"), t))
    fixed = F.concat(Q.latex_issues(T.auto_fix_latex(t)), Q.pair_issues(F.col("original"), T.auto_fix_latex(t)))
    n = lambda c, k: F.size(F.filter(c, lambda x: x.startswith(k)))
    x = pairs.select(doc, n(issues, "error").alias("errors"), n(issues, "warning").alias("warnings"), Q.issue_score(n(issues, "error"), n(issues, "warning")).alias("s"), Q.issue_score(n(fixed, "error"), n(fixed, "warning")).alias("f"))
    score = F.when(F.col("errors") > 0, F.greatest("s", "f")).otherwise(F.col("s"))
    return x.groupBy(doc).agg(F.count("*").alias("n_blocks"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.avg(score).alias("score"))


def lost_formulas(pairs: DataFrame) -> DataFrame:
    """Formulas of the original that the translation lacks, blanks aside."""
    norm = lambda c: F.transform(T.formulas(c), Q.no_blanks)
    return pairs.withColumn("lost", F.array_sort(F.array_except(norm(F.col("original")), norm(F.col("translated")))))
