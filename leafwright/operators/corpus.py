"""Operators on documents and their terms: J9, J10, J19, I21, A13, R4-R9, A19, A20, A27, P19, K5, K7, U1, L9."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions import quality as Q
from leafwright.functions import rules as R
from leafwright.functions import text as T
from leafwright.functions.batches import over_texts

#: Our own small tables: (term, language, translation) and (code, name, script, direction).
GLOSSARY = [
    ("energy", "de", "Energie"), ("energy", "fr", "énergie"), ("field", "de", "Feld"), ("field", "fr", "champ"), ("wave", "de", "Welle"), ("wave", "fr", "onde"),
    ("the", "de", "der"), ("the", "fr", "le"), ("and", "de", "und"), ("and", "fr", "et"), ("of", "de", "von"), ("of", "fr", "de"),
]
LANGUAGES = [
    ("en", "English", "latin", "ltr"), ("de", "German", "latin", "ltr"), ("fr", "French", "latin", "ltr"), ("es", "Spanish", "latin", "ltr"), ("ru", "Russian", "cyrillic", "ltr"), ("uk", "Ukrainian", "cyrillic", "ltr"),
    ("ar", "Arabic", "arabic", "rtl"), ("fa", "Persian", "arabic", "rtl"), ("he", "Hebrew", "hebrew", "rtl"), ("zh", "Chinese", "cjk", "ltr"), ("ja", "Japanese", "cjk", "ltr"), ("ko", "Korean", "cjk", "ltr"),
]
#: Damage by kind.
CORRUPTIONS = [("question", r"[A-Za-z]\?[A-Za-z]"), ("exponent", r"10\?"), ("glyph", r"\?[A-Z]_[a-f0-9]{4,8}_[0-9]+\?"), ("replacement", "�"), ("double", r"\?\?"), ("percent", r"\?%")]

#: R4's patterns by kind, with look-arounds, which SQL and RE2 lack.
SURVEY_CORRUPTIONS = [
    ("replacement_char", "�"), ("question_in_number", r"(?<=[0-9])\?(?=[0-9²³⁴⁵⁶⁷⁸⁹⁰¹⁻⁺])"), ("question_compound", r"(?<=[A-Za-z])\?(?=[A-Z])"), ("font_glyph", r"\?[A-Z]_[a-f0-9]{4,8}_\d+\?"),
    ("font_glyph_bracket", r"\[[A-Z]_[a-f0-9]{4,8}_\d+\]"), ("broken_range", r"(?<=[0-9])\s*[\?]\s*(?=[\-−–]?\d)"), ("soft_hyphen", "\u00ad"), ("zero_width", "[\u200b\u200c\u200d\ufeff]"),
]


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of each text with their place."""
    return docs.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def best_match(blocks: DataFrame, paragraphs: DataFrame, least: float = 0.3) -> DataFrame:
    """For each block (block_id, text) the paragraph (para_id, text) with the largest shared-word count over the larger set's
    size, above least; ties go to the first.

    A pair above least shares one of the n - floor(least * n) first words of each side in one order; the order is rarest first, words
    that no paragraph has before all, so common words seldom meet. Pairs found so are compared on all words that both can have.
    Blocks whose number of words is too far from every paragraph's have no such pair; the others' words that paragraphs have are dealt
    out once, and that exchange serves each use.
    """
    sets = lambda d, k, n: d.where(F.col(k).isNotNull()).select(F.col(k), F.array_distinct(T.tokens(F.col("text"))).alias(f"w{n}")).withColumn(n, F.size(f"w{n}"))
    b = sets(paragraphs, "para_id", "nb")
    sizes = b.agg(F.min("nb").alias("lo"), F.max("nb").alias("hi"))
    a = sets(blocks, "block_id", "na").crossJoin(F.broadcast(sizes)).where((F.col("na") > F.col("lo") * least) & (F.col("hi") > F.col("na") * least))
    known = b.select(F.explode("wnb").alias("word")).distinct()
    each = a.select("block_id", "na", F.explode("wna").alias("word")).join(known, "word").select("block_id", "na", "word").repartition("block_id")
    # count_if and not count, so that this use needs the same columns as the others
    order = known.join(each.groupBy("word").agg(F.count_if(F.col("na") > 0).alias("f")), "word", "left").select("word", F.coalesce("f", F.lit(0)).alias("f"))

    def in_order(d: DataFrame, k: str, n: str) -> DataFrame:
        return d.join(order, "word").groupBy(k, n).agg(F.array_sort(F.collect_list(F.struct("f", "word"))).alias("seq"))

    def first_words(seq: DataFrame, k: str, n: str) -> DataFrame:
        x = seq.withColumn("more", F.size("seq") - F.floor(F.col(n) * least).cast("int"))
        return x.where("more > 0").select(k, n, F.explode(F.slice("seq", 1, F.col("more"))["word"]).alias("word"))

    seq_a = in_order(each, "block_id", "na")
    seq_b = in_order(b.select("para_id", "nb", F.explode("wnb").alias("word")), "para_id", "nb")
    met = first_words(seq_a, "block_id", "na").join(first_words(seq_b, "para_id", "nb"), "word").where(F.least("na", "nb") > F.greatest("na", "nb") * least).select("block_id", "para_id").distinct()
    both = met.join(seq_a.select("block_id", "na", F.col("seq.word").alias("wna")), "block_id").join(b, "para_id")
    s = both.withColumn("score", F.size(F.array_intersect("wna", "wnb")) / F.greatest("na", "nb")).where(F.col("score") > least)
    return s.groupBy("block_id").agg(F.max_by(F.struct("para_id", "score"), F.struct("score", -F.col("para_id"))).alias("m")).select("block_id", "m.para_id", "m.score")


def glossary_coverage(docs: DataFrame, glossary: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct glossary terms of each document's language found among its words (Spark broadcasts the dictionary if it is small)."""
    w = docs.select(key, "lang", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return w.join(glossary.select("term", F.col("lang"), "translation"), ["term", "lang"]).groupBy(key).agg(F.count("*").alias("terms"), F.array_sort(F.collect_set("term")).alias("found"))


def exact_translation(cells: DataFrame, glossary: DataFrame, language: str) -> DataFrame:
    """A whole trimmed cell that is a term becomes its translation, with a capital if the cell has one; else null."""
    g = glossary.where(F.col("lang") == language).select(F.col("term").alias("_t"), "translation")
    x = cells.withColumn("_t", F.lower(T.strip(F.col("text")))).join(g, "_t", "left")
    return x.withColumn("answer", F.when(T.strip(F.col("text")).rlike(r"^\p{Lu}"), F.initcap("translation")).otherwise(F.col("translation"))).drop("_t", "translation")


def dictionary_hook(language: str, glossary: list[tuple[str, str, str]] = GLOSSARY):
    """The default translator, a word-for-word dictionary; a Column -> Column hook."""
    words = {t: v for t, lang, v in glossary if lang == language}

    def hook(c: Column) -> Column:
        for t in sorted(words, key=lambda x: (-len(x), x)):
            c = F.regexp_replace(c, rf"\b{t}\b", words[t])
        return c

    return hook


def corruption_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each damage of our own six kinds; R4 is corruption_places."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.col("text"), F.lit(p), 0).alias("m")) for k, p in CORRUPTIONS])
    return docs.select(key, F.explode(kinds).alias("x")).select(key, "x.kind", F.explode("x.m").alias("original"))


def corruption_places(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each damage of the eight patterns and of our own, with its kind, place [start, end) in characters and context."""
    own = [(k, re.compile(p)) for k, p in [*SURVEY_CORRUPTIONS, *CORRUPTIONS]]

    def find(t: str) -> list:
        return [{"kind": k, "start": m.start(), "end": m.end(), "original": m.group(0), "context": t[max(0, m.start() - 20) : m.end() + 20]} for k, p in own for m in p.finditer(t)]

    x = over_texts(find, "array<struct<kind:string, start:int, end:int, original:string, context:string>>", [])(F.col("text"))
    return docs.select(key, F.explode(x).alias("x")).select(key, "x.*")


def symbol_votes(glyphs: DataFrame) -> DataFrame:
    """The symbol most contexts of a glyph speak for; ties go to the first seen (seq)."""
    v = glyphs.withColumn("symbol", T.infer_glyph(F.col("context"))).where("symbol is not null")
    n = v.groupBy("glyph", "symbol").agg(F.count("*").alias("votes"), F.min("seq").alias("seq"))
    return n.groupBy("glyph").agg(F.max_by("symbol", F.struct("votes", -F.col("seq"))).alias("symbol"), F.max("votes").alias("votes"))


def resolve_glyphs(glyphs: DataFrame) -> DataFrame:
    """By the own context, then by the glyph's vote, else marked as unresolved."""
    x = glyphs.join(symbol_votes(glyphs).select("glyph", F.col("symbol").alias("_v")), "glyph", "left")
    return x.withColumn("resolved", F.coalesce(T.infer_glyph(F.col("context")), "_v", F.concat(F.lit("[[UNRESOLVED_GLYPH:"), "glyph", F.lit("]]")))).drop("_v")


def languages_by_script(languages: DataFrame) -> DataFrame:
    """A27, P19c, O6."""
    return languages.groupBy("script").agg(F.array_sort(F.collect_list("name")).alias("names"), F.count_if(F.col("direction") == "rtl").alias("rtl"))


def table_markdown(cells: DataFrame, table: str) -> DataFrame:
    """K5: cells (row, col, text) of each table as Markdown, with the separator after the first row."""
    rows = cells.groupBy(table, "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("c"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: x["text"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("c")))
    rows = rows.select(table, "row", F.when(F.col("row") == 0, F.concat_ws("\n", line, rule)).otherwise(line).alias("line"))
    return rows.groupBy(table).agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("r")).select(table, F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("markdown"))


def table_latex(cells: DataFrame, table: str) -> DataFrame:
    """K4: cells as a LaTeX tabular; of two cells in one place the later (seq) stays; the first row is bold."""
    one = cells.groupBy(table, "row", "col").agg(F.max_by("text", "seq").alias("text"))
    text = F.when(F.col("row") == 0, F.concat(F.lit("\\textbf{"), T.escape_latex(F.col("text")), F.lit("}"))).otherwise(T.escape_latex(F.col("text")))
    rows = one.select(table, "row", "col", text.alias("text")).groupBy(table, "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("c"))
    rows = rows.select(table, "row", F.size("c").alias("n"), F.concat(F.array_join(F.transform("c", lambda x: x["text"]), " & "), F.lit(" \\\\")).alias("line"))
    g = rows.groupBy(table).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("row", "line"))).alias("r"))
    return g.select(table, F.concat(F.lit("\\begin{tabular}{"), F.repeat(F.lit("l"), F.col("n")), F.lit("}\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.lit("\n\\end{tabular}")).alias("latex"))


def quality_report(scores: DataFrame, key: str) -> DataFrame:
    """K7: a document's scores as Markdown; null if one is missing.

    Three places are rounded from the double's exact value, ties to even, as C's printf does; Java's formatter (format_string) rounds
    its shortest decimal form, ties up. Leading zeros keep format_number off a short cut of Java's; 0.0005 is above the tie, which it
    takes it for.
    """
    shown = lambda c: F.when(F.col(c) == 0.0005, "0.001").otherwise(F.regexp_replace(F.call_function("format_number", F.col(c), F.lit("000.000")), r"^0+(?=[0-9])", ""))
    value = lambda name, c: F.concat(F.lit(f"| {name} | "), shown(c), F.lit(" |\n"))
    rows = [value("overall", "overall"), value("formulas", "formula_score"), value("completeness", "completeness")]
    return scores.select(key, F.concat(F.lit("# Quality\n\n| score | value |\n|---|---|\n"), *rows, F.lit("\nLevel: "), "level").alias("report"))


def html_share(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Q17, A19, Q22 over raw pages: counts of tags, damage and garbage."""
    c = F.col("html")
    return pages.select(key, F.regexp_count(c, F.lit("<[^>]+>")).alias("tags"), F.regexp_count(c, F.lit(R.INLINE_HTML)).alias("inline_tags"), F.contains(c, F.lit("�")).alias("has_lost"))


def build_report(pages: DataFrame, sources: DataFrame, key: str = "doc_id", more: int = 2) -> DataFrame:
    """Of each built document (page texts) pages, garbage characters and warnings, against its number of source pages.

    A document without a page in pages has no output.
    """
    built = pages.groupBy(key).agg(F.count("*").alias("page_count"), F.sum(Q.garbage_count(F.coalesce("text", F.lit("")))).alias("garbage"))
    x = sources.join(built, key, "left").withColumns({"garbage": F.coalesce("garbage", F.lit(0)), "pages": F.coalesce("page_count", F.lit(0))})
    grown = F.when(F.col("pages") > F.col("source_pages") + more, F.concat(F.lit("pages grew: "), F.col("source_pages").cast("string"), F.lit(" to "), F.col("pages").cast("string")))
    warnings = F.array_compact(F.array(F.when(F.col("page_count").isNull(), F.lit("no output")), F.when(F.col("garbage") > 0, F.concat(F.lit("garbage: "), F.col("garbage").cast("string"))), grown))
    return x.select(key, F.col("pages").alias("page_count"), "garbage", F.array_join(warnings, "; ").alias("warnings"))


def glossary_prompt(glossary: DataFrame, languages: list[str]) -> DataFrame:
    """For each language the lines term → translation of a glossary (term, lang, translation), in order of terms."""
    line = F.concat(F.lit("  "), F.col("term"), F.lit(" → "), F.col("translation"))
    return glossary.where(F.col("lang").isin(*languages)).groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


def find_language(names: DataFrame, languages: DataFrame) -> DataFrame:
    """Names with the language of that name or code (case aside), and its first font, else sans-serif."""
    keys = languages.select("language", "code", "fonts", F.explode(F.array_distinct(F.array(F.lower("language"), "code"))).alias("_k"))
    found = names.join(keys, F.lower(F.col("name")) == F.col("_k"), "left").drop("_k")
    return found.withColumn("font", F.coalesce(F.try_element_at("fonts", F.lit(1)), F.lit("sans-serif"))).drop("fonts")
