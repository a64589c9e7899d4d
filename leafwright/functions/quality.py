
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from . import text as T


def no_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def completeness(original: Column, translated: Column) -> Column:
    """Q11, 0-100 by the ratio of word counts; 100 without original words."""
    n, m = F.size(T.tokens(original)).cast("double"), F.size(T.tokens(translated)).cast("double")
    r = m / n
    score = F.when(r < 0.5, r / 0.5 * 80).when(r > 2, 2 / r * 80).otherwise(100 - 20 * F.abs(1 - r))
    return F.when(n == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def similarity(original: Column, back: Column) -> Column:
    """Q12, 0-100: 0.4 Jaccard and 0.6 coverage of word sets; 0 if either is empty."""
    a, b = F.array_distinct(T.tokens(original)), F.array_distinct(T.tokens(back))
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.least(F.lit(100.0), 100 * (0.4 * common / union + 0.6 * common / F.size(a))))


def overlap(original: Column, back: Column) -> Column:
    """Q13b, 0-1: shared words over the original's words; 1 for an empty original."""
    a, b = F.array_distinct(T.tokens(original)), F.array_distinct(T.tokens(back))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def formula_score(original: Column, translated: Column) -> Column:
    """Q14, 0-100: share of formulas kept (blanks aside), 5 less for each extra one; 100 without formulas."""
    f, flat = T.formulas(original), no_blanks(translated)
    kept = F.size(F.filter(f, lambda x: F.contains(translated, x) | F.contains(flat, no_blanks(x))))
    extra = F.size(T.formulas(translated)) - F.size(f)
    score = 100.0 * kept / F.size(f)
    return F.when(F.size(f) == 0, F.lit(100.0)).otherwise(F.when(extra > 0, F.greatest(F.lit(0.0), score - extra * 5)).otherwise(score))


def overall(formula: Column, semantic: Column, complete: Column, terminology: Column) -> Column:
    """Q15: weighted sum."""
    w = R.QA_WEIGHTS
    return formula * w["formula"] + semantic * w["semantic"] + complete * w["completeness"] + terminology * w["terminology"]


def level(score: Column) -> Column:
    """Q16."""
    return reduce(lambda c, x: c.when(score >= x[0], x[1]), R.LEVELS[1:], F.when(score >= R.LEVELS[0][0], R.LEVELS[0][1])).otherwise("failed")


def formula_symbols(c: Column) -> Column:
    """Formulas, Greek letters, signs, super- and subscripts; the last four are sets of characters beyond ASCII without a common one."""
    beyond = F.regexp_replace(c, r"[\x00-\x7F]+", "")
    return T.count_any(T.dollars(c), R.PAIR_FORMULAS[:1]) + T.count_any(beyond, ["[" + "".join(p[1:-1] for p in R.PAIR_FORMULAS[1:]) + "]"])


def references(c: Column) -> Column:
    """Numeric, figure and equation references."""
    return reduce(lambda a, b: a + b, [T.count_if_there(c, sign, [p]) for sign, p in zip(("[", "Fig", "Eq."), R.PAIR_REFERENCES, strict=True)])


def corruption(c: Column) -> Column:
    """Q17: array of severity:finding."""
    return F.array_compact(
        F.array(
            F.when(F.contains(c, F.lit("\ufffd")), F.lit("critical:replacement character")),
            F.when(F.contains(c, F.lit("??")), F.lit("critical:double question mark")),
            F.when(c.rlike(R.PLACEHOLDER), F.lit("critical:placeholder")),
            F.when(c.rlike(R.INLINE_HTML), F.lit("warning:html")),
        )
    )


def is_corrupt(c: Column) -> Column:
    """Q22."""
    return F.contains(c, F.lit("\ufffd")) | F.contains(c, F.lit("??")) | c.rlike(R.PLACEHOLDER)


def pair_loss(original: Column, translated: Column) -> Column:
    """Q18, 0-1: 0.3 less for any lost formula, 0.2 for each critical finding."""
    lost = formula_symbols(original) > formula_symbols(translated)
    critical = F.size(F.filter(corruption(translated), lambda x: x.startswith("critical")))
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.when(lost, 0.3).otherwise(0.0) - critical * 0.2)


def better(original: Column, translated: Column, least: float = 0.8) -> Column:
    """Q19: the translation if its pair_loss score is high enough, else the original."""
    return F.when(pair_loss(original, translated) >= least, translated).otherwise(original)


def brace_depths(c: Column, opening: str = "{", closing: str = "}", escapes: bool = True) -> Column:
    """Q1, Q2 as counts: struct(unclosed, unopened) by a fold over the characters that matter."""
    text = F.regexp_replace(c, r"(?s)\\.", "") if escapes else c
    marks = F.split(F.regexp_replace(text, "[^\\" + opening + "\\" + closing + "]", ""), "")
    start = F.struct(F.lit(0).alias("unclosed"), F.lit(0).alias("unopened"))
    return F.aggregate(
        marks,
        start,
        lambda a, x: F.struct(
            F.when(x == opening, a["unclosed"] + 1).when((x == closing) & (a["unclosed"] > 0), a["unclosed"] - 1).otherwise(a["unclosed"]).alias("unclosed"),
            F.when((x == closing) & (a["unclosed"] == 0), a["unopened"] + 1).otherwise(a["unopened"]).alias("unopened"),
        ),
    )


def environments(c: Column) -> Column:
    """Q4: number of \\begin and \\end names that do not pair up, by a stack of names."""
    found = F.regexp_extract_all(c, F.lit(r"\\(?:begin|end)\{[^}]*\}"), 0)
    name = lambda x: F.regexp_extract(x, r"\{([^}]*)\}", 1)
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("bad"))
    end = F.aggregate(
        found,
        start,
        lambda a, x: F.when(x.startswith("\\begin"), F.struct(F.array_append(a["open"], name(x)).alias("open"), a["bad"].alias("bad")))
        .when((F.size(a["open"]) > 0) & (F.try_element_at(a["open"], F.lit(-1)) == name(x)), F.struct(F.slice(a["open"], F.lit(1), F.size(a["open"]) - 1).alias("open"), a["bad"].alias("bad")))
        .otherwise(F.struct(a["open"].alias("open"), (a["bad"] + 1).alias("bad"))),
    )
    return end["bad"] + F.size(end["open"])


def delimiter_errors(c: Column) -> Column:
    """Q3: array of findings on $, $$, \\[ \\] and \\( \\)."""
    doubles = F.regexp_count(c, F.lit(r"\$\$"))
    singles = F.regexp_count(F.regexp_replace(c, r"\\\$|\$\$", ""), F.lit(r"\$"))
    n = lambda p: F.regexp_count(c, F.lit(r"(?<!\\)\\" + p))
    return F.array_compact(
        F.array(F.when(singles % 2 == 1, F.lit("odd $")), F.when(doubles % 2 == 1, F.lit("odd $$")), F.when(n(r"\[") != n(r"\]"), F.lit("unequal \\[ \\]")), F.when(n(r"\(") != n(r"\)"), F.lit("unequal \\( \\)")))
    )


def common_errors(c: Column) -> Column:
    """Q5: array of severity:finding."""
    return F.array_compact(
        F.array(
            F.when(c.rlike(r"\\ [a-zA-Z]"), F.lit("warning:blank after backslash")),
            F.when(T.strip(c).endswith("\\\\"), F.lit("warning:ends with double backslash")),
            F.when(c.rlike(r"\\[a-zA-Z]+\{\s*\}"), F.lit("info:empty argument")),
            F.when(F.contains(c, F.lit("\ufffd")), F.lit("error:replacement character")),
        )
    )


def issue_score(errors: Column, warnings: Column) -> Column:
    """A5: 1 less 0.2 an error and 0.05 a warning, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - errors * 0.2 - warnings * 0.05))


def latex_issues(c: Column) -> Column:
    """Q1-Q5 as severity:finding."""
    braces, brackets = brace_depths(c), brace_depths(c, "[", "]", escapes=False)
    repeat = lambda n, x: F.array_repeat(F.lit(x), n)
    return F.concat(
        repeat(braces["unclosed"], "error:unclosed brace"),
        repeat(braces["unopened"], "error:unopened brace"),
        repeat(brackets["unclosed"] + brackets["unopened"], "warning:bracket"),
        F.transform(delimiter_errors(c), lambda x: F.concat(F.lit("error:"), x)),
        repeat(environments(c), "error:environment"),
        common_errors(c),
    )


def latex_score(c: Column) -> Column:
    """Q6: struct(score, is_valid)."""
    n = lambda k: F.size(F.filter(latex_issues(c), lambda x: x.startswith(k)))
    return F.struct(issue_score(n("error"), n("warning")).alias("score"), (n("error") == 0).alias("is_valid"))


def pair_issues(original: Column, translated: Column) -> Column:
    """Q7-Q9 as severity:finding."""
    r = F.length(translated) / F.length(original)
    flat = no_blanks(translated)
    changed = F.exists(T.formulas(original), lambda x: ~F.contains(translated, x) & ~F.contains(flat, no_blanks(x)))
    return F.array_compact(
        F.array(
            F.when((F.length(original) > 0) & (r < 0.5), F.lit("warning:incomplete")),
            F.when((F.length(original) > 0) & (r > 2), F.lit("info:long")),
            F.when(changed, F.lit("warning:formula changed")),
            *[F.when(translated.rlike(p), F.lit(f"error:placeholder {i}")) for i, p in enumerate(R.UNRESTORED)],
        )
    )


def gate(original: Column, translated: Column, expected: Column | None = None) -> Column:
    """Q20: the first gate that fails, or ok."""
    g, o, t = R.GATE, T.strip(original), T.strip(translated)
    r = F.when(F.length(o) > 0, F.length(t) / F.length(o)).otherwise(F.lit(0.0))
    so, st = T.sentence_count(original), T.sentence_count(translated)
    first = F.regexp_extract(t, r"\A([^\n]*)", 1)
    c = F.when(F.coalesce(t, F.lit("")) == "", "empty").when(r < g["min_ratio"], "too short").when(r > g["max_ratio"], "too long")
    c = c.when((so > 0) & (st / so < g["min_sentences"]), "missing sentences").when((so > 0) & (st / so > g["max_sentences"]), "extra sentences")
    if expected is not None:
        c = c.when(F.exists(expected, lambda p: ~F.contains(translated, p)), "missing placeholder")
    return c.when(reduce(lambda a, b: a | b, [first.rlike("(?iu)" + p) for p in R.META_RESPONSES]), "meta response").otherwise("ok")


def garbage_gate(source: Column, answer: Column) -> Column:
    """Q25: why an answer is thrown away, or ok."""
    low, words = F.lower(answer), F.filter(F.split(answer, "[ \t\n\r]+"), lambda x: x != "")
    many = F.size(words) > 10
    return (
        F.when(T.contains_any(low, R.REFUSALS), "refusal")
        .when(many & (F.size(F.array_distinct(words)) / F.size(words) < 0.1), "repetitive")
        .when(many & T.contains_any(low, R.LIGATURE_NOISE), "ligatures")
        .when((F.length(answer) < F.length(source) * 0.3) & (F.length(source) > 100), "short")
        .otherwise("ok")
    )


def repeats_itself(c: Column) -> Column:
    """Over 20 words of which under 15 % are distinct."""
    w = T.tokens(c)
    return (F.size(w) > 20) & (F.size(F.array_distinct(w)) / F.size(w) < 0.15)


def regression(original: Column, translated: Column) -> Column:
    """Q21: array of failed checks: corruption, HTML, mojibake, over 10 % formulas lost."""
    a, b = formula_symbols(original), formula_symbols(translated)
    return F.array_compact(
        F.array(
            F.when(F.contains(translated, F.lit("\ufffd")), F.lit("replacement character")),
            F.when(F.contains(translated, F.lit("??")), F.lit("double question mark")),
            F.when(translated.rlike(R.PLACEHOLDER), F.lit("placeholder")),
            F.when(translated.rlike(R.INLINE_HTML), F.lit("html")),
            F.when(F.size(T.utf8_warnings(translated)) > 0, F.lit("encoding")),
            F.when((a > 0) & (b < a * 0.9), F.lit("formulas lost")),
        )
    )


def error_class(message: Column) -> Column:
    """Q23: struct(retryable, error_type), the first class with a matching word."""
    x, c = F.lower(message), None
    for name, retry, words in R.ERROR_CLASSES:
        value = F.struct(F.lit(retry).alias("retryable"), F.lit(name).alias("error_type"))
        c = F.when(T.contains_any(x, words), value) if c is None else c.when(T.contains_any(x, words), value)
    return c.otherwise(F.struct(F.lit(False).alias("retryable"), F.lit("unknown").alias("error_type")))


def retry_delay(attempt: Column, strategy: str = "exponential", initial: float = 1.0, base: float = 2.0, most: float = 60.0, retry_after: Column | None = None) -> Column:
    """Q24 without jitter: the delay before the next attempt."""
    d = {"exponential": initial * F.pow(F.lit(base), attempt), "linear": initial * (attempt + 1), "constant": F.lit(initial)}[strategy]
    return F.least(F.coalesce(retry_after, d) if retry_after is not None else d, F.lit(most))


def garbage_count(c: Column) -> Column:
    """Garbage characters of extraction in a text."""
    return F.regexp_count(c, F.lit("[" + "".join(f"\\x{{{ord(x):x}}}" for x in R.GARBAGE) + "]"))


def headings_in_order(c: Column) -> Column:
    """struct(headings, in_order): lines that begin with a section number, and whether their first numbers never fall."""
    found = F.regexp_extract_all(c, F.lit(r"(?m)^([0-9]+(?:\.[0-9]+)*)\.[ \t\r\n]+[^\n]+"), 1)
    first = F.transform(found, lambda x: F.substring_index(x, ".", 1).cast("decimal(38,0)"))
    return F.struct(found.alias("headings"), (first == F.array_sort(first)).alias("in_order"))


def back_translation_check(original: Column, back: Column, least: float = 50.0) -> Column:
    """Q13: struct(valid, score) of a translation back into the original's language (operators.hooks.once_each makes it)."""
    score = similarity(original, back)
    return F.struct((score >= least).alias("valid"), score.alias("score"))


def build_errors(log: Column, most: int = 5) -> Column:
    """struct(first, lines): the first line that begins with !, and up to most lines with ! or Error."""
    lines = F.split(log, "\n")
    return F.struct(F.element_at(F.filter(lines, lambda x: x.startswith("!")), 1).alias("first"), F.slice(F.filter(lines, lambda x: F.contains(x, F.lit("!")) | F.contains(x, F.lit("Error"))), 1, most).alias("lines"))
