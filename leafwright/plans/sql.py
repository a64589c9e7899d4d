"""DuckDB SQL snippets that the SQL forms of the queries are made of."""

from __future__ import annotations

from leafwright.functions import rules as R


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(replacement: str) -> str:
    """A Java replacement in RE2's notation."""
    out, i = "", 0
    while i < len(replacement):
        c = replacement[i]
        if c == "\\":
            out += "\\\\" if replacement[i + 1] == "\\" else replacement[i + 1]
            i += 1
        elif c == "$":
            out += "\\" + replacement[i + 1]
            i += 1
        else:
            out += c
        i += 1
    return out


def chain(c: str, rules: list[tuple[str, str]]) -> str:
    for p, r in rules:
        c = f"regexp_replace({c}, {lit(p)}, {lit(re2(r))}, 'g')"
    return c


def replace_all(c: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        c = f"replace({c}, {lit(a)}, {lit(b)})"
    return c


def strip(c: str) -> str:
    return f"trim({c}, E' \\t\\n\\r\\x0b\\x0c')"


def count(c: str, *patterns: str) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({c}, {lit(p)}))" for p in patterns) + ")"


def match(c: str, p: str) -> str:
    return f"regexp_matches({c}, {lit(p)})"


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), E'[ \\t\\n\\r]+'), lambda x: x <> '')"


def any_of(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(w)})" for w in words) + ")"


def formulas(c: str) -> str:
    return "flatten([" + ", ".join(f"regexp_extract_all({c}, {lit(p)})" for p in R.QA_FORMULAS) + "])"


def terms(c: str) -> str:
    return "list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all({c}, {lit(p)})" for p in (R.CAPITALISED_PHRASE, R.ACRONYM, R.LATEX_GREEK)) + "])))"


def sentences(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array(regexp_replace({c}, '⟦F_[a-f0-9]+⟧', '', 'g'), E'[.!?]+(\\\\s|$)'), lambda s: length({strip('s')}) > 10))"


def completeness(a: str, b: str) -> str:
    n, m = f"len({tokens(a)})::DOUBLE", f"len({tokens(b)})::DOUBLE"
    r = f"({m} / {n})"
    return f"CASE WHEN {n} = 0 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN {r} < 0.5 THEN {r} / 0.5::DOUBLE * 80 WHEN {r} > 2 THEN 2 / {r} * 80 ELSE 100 - 20 * abs(1 - {r}) END)) END"


def similarity(a: str, b: str) -> str:
    x, y = f"list_distinct({tokens(a)})", f"list_distinct({tokens(b)})"
    common = f"len(list_intersect({x}, {y}))"
    union = f"(len({x}) + len({y}) - {common})"
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, 100 * (0.4::DOUBLE * {common} / {union} + 0.6::DOUBLE * {common} / len({x}))) END"


def no_blanks(c: str) -> str:
    return f"regexp_replace({c}, '\\s+', '', 'g')"


def formula_score(a: str, b: str) -> str:
    f = formulas(a)
    kept = f"len(list_filter({f}, lambda x: contains({b}, x) OR contains({no_blanks(b)}, {no_blanks('x')})))"
    extra = f"(len({formulas(b)}) - len({f}))"
    score = f"(100.0::DOUBLE * {kept} / len({f}))"
    return f"CASE WHEN len({f}) = 0 THEN 100.0::DOUBLE WHEN {extra} > 0 THEN greatest(0.0::DOUBLE, {score} - {extra} * 5) ELSE {score} END"


def overall(f: str, s: str, c: str, t: str) -> str:
    w = R.QA_WEIGHTS
    return f"({f} * {w['formula']}::DOUBLE + {s} * {w['semantic']}::DOUBLE + {c} * {w['completeness']}::DOUBLE + {t} * {w['terminology']}::DOUBLE)"


def level(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} >= {x} THEN {lit(n)}" for x, n in R.LEVELS) + " ELSE 'failed' END"


def is_heading(c: str) -> str:
    x = strip(c)
    return f"({match(x, R.NUMBERED_HEADING)} OR {match(x, R.ROMAN_HEADING)} OR {match(x, '^(' + '|'.join(R.HEADING_WORDS) + ')( |:|$)')} OR starts_with({x}, '#'))"


def is_bullet(c: str) -> str:
    return f"({match(strip(c), R.BULLET)} OR {match(strip(c), R.LIST_ITEM)})"


def is_caption(c: str) -> str:
    return match(strip(c), R.CAPTION)


def is_numeric(c: str) -> str:
    x = f"regexp_replace({c}, {lit(R.CELL_NOISE)}, '', 'g')"
    return f"(length({x}) > 0 AND {count(x, R.CELL_DIGITS)} / nullif(length({x}), 0) > 0.7::DOUBLE)"


PAIRS = """t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, text AS original, next_text AS translated FROM t WHERE role = 'user' AND next_role = 'assistant')"""
