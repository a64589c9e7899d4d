"""Fixed values of text repair: the ordered rules of R1, R2 and R3 as (name, pattern, replacement, words of the context)."""

from __future__ import annotations

import re

_SUPER = "¹²³⁴⁵⁶⁷⁸⁹⁰"


def _mantissa(m: re.Match, text: str) -> str:
    whole = m.group(1)
    return f"{m.group(2) or '1'}.{whole[0] if len(whole) == 2 else '1'} × 10^{{-{whole}}}"


#: Characters that go, then patterns with upper and lower case apart.
UNICODE = [
    ("unicode_char_cleanup", r"[\ufffe\uffff]+", ""),
    ("unicode_compound_word", r"([A-Za-z])(\?+)([A-Z][a-z])", r"\1-\3"), ("unicode_percentage", r"(\d+[,\.]\d+)\?(%)", r"\1\2"), ("unicode_year_range", r"(\d{4})\?(\d{4})", r"\1–\2"),
    ("unicode_numeric_range", r"(\d+)\?(\d+)\s*(GB|MB|KB|cm|mm|m|kg|Hz|MHz|GHz)(?!/)", r"\1–\2 \3"),
    ("replacement_char_range", r"(\d+)�(\d+)", r"\1–\2"), ("replacement_char_compound", r"([A-Za-z])�([A-Z][a-z])", r"\1-\2"), ("replacement_char_percent", r"(\d+[,\.]\d+)�(%)", r"\1\2"),
]

_LESS = ("lower", "less", "<")
#: R2, in any case: a rule with words is applied only where one of them is within 100 characters of the match's beginning.
SAFE = [(name, "(?i)" + p, r, *words) for name, p, r, *words in [
    ("font_glyph_placeholder_hex", r"\?[A-Z]_[a-f0-9A-F]{4,8}_\d+\?", "?"), ("font_glyph_placeholder_numeric", r"\?[A-Z]_\d{4,8}_\d+\?", "?"),
    ("font_glyph_bracket_hex", r"\[[A-Z]_[a-f0-9A-F]{4,8}_\d+\]", "?"), ("font_glyph_bracket_numeric", r"\[[A-Z]_\d{4,8}_\d+\]", "?"),
    ("ssz_hyphen_artifact", r"SSZ\?", "SSZ-"), ("compound_word_hyphen", r"([A-ZÄÖÜ][a-zäöüß]+)\?([A-ZÄÖÜ][a-zäöüß]+)", r"\1-\2"),
    ("table3_mantisse_exponent", r"10\?[²¹⁰³⁴⁵⁶⁷⁸⁹\?\-−]+(\d{1,2})[.,]?(\d)?[×x]", _mantissa),
    ("table3_standard_notation", r"(\d)[.,](\d)\s*[×x]\s*10\?[²¹⁰³⁴⁵⁶⁷⁸⁹\?\-−]*(\d{1,2})", r"\1.\2 × 10^{-\3}"),
    ("table3_drift_exponent", r"10\?(\d{2})\s*s/s", r"10^{-\1} s/s"), ("table3_isolated_exponent", r"\b10\?(\d{2})\b(?!\s*[a-zA-Z])", r"10^{-\1}"),
    ("broken_10_minus19", r"10\?¹\?", "10^{-19}"), ("broken_superscript_10_2", r"10\?([²])\?", "10^{-2}"), ("broken_superscript_10_5", r"10\?([⁵])\?", "10^{-5}"),
    ("broken_ssz_exponent", rf"\((\d),(\d)\?[{_SUPER}]+\?\)", r"(\1.\2 × 10^{-19})"), ("broken_ssz_exponent_noparen", rf"(\d),(\d)\?[{_SUPER}]+\?", r"\1.\2 × 10^{-19}"),
    ("broken_10_exponent_paren_19", r"\(10\?¹\?\)", "(10^{-19})"),
    ("broken_negative_exponent_double", r"10\?[−\-]?\?(\d+)", r"10^{-\1}"), ("broken_negative_exponent", r"10\?-(\d)\?", r"10^{-\1}"),
    ("broken_multiplication_sign", r"(\d)[,.](\d)\s*\?\s*10\^", r"\1.\2 x 10^"), ("broken_multiplication_nospace", r"(\d)[,.](\d)\?10\^", r"\1.\2 x 10^"),
    ("broken_unit_s_s", r"s\?s", "s/s"), ("unit_extra_space", r"s/\s+s", "s/s"),
    ("missing_caret_exponent", r"\(10\{(-?\d+)\}\)", r"(10^{\1})"), ("missing_caret_standalone", r"(?<!\^)10\{(-?\d+)\}", r"10^{\1}"),
    ("broken_scientific_notation_paren", r"\((\d+\.?\d*)\{(-\d+)\}\)", r"(\1×10^{\2})"), ("broken_scientific_notation", r"[×x]\s*10\?\s*(\d+)", r"×10^\1"),
    ("scientific_notation_missing_caret", r"×\s*10-(\d+)", r"×10^{-\1}"), ("broken_math_symbol", r"\?([±∓≈≠≤≥∝∞∂∇∫∑∏√])\?", r"\1"),
    ("broken_range_with_unit", r"(\d+)\?(\d+)\s*(K|Hz|MHz|GHz|nm|μm|mm|cm|m|km|eV|keV|MeV|GeV|TeV)", r"\1–\2 \3"),
    ("broken_latex_fragment_1", r"\[\.\|\{[^\]]{5,80}\]", "[[FORMEL: dΞ/dr]]"), ("broken_latex_fragment_2", r"\[\{[^\]]{10,100}\}\]", "[[FORMEL]]"),
    ("bracket_to_math", r"\[([A-Za-z_]+\s*=\s*[^]]{5,100})\]", r"$\1$"), ("double_dollar_bracket", r"\$\$\[", "$"), ("bracket_double_dollar", r"\]\$\$", "$"),
    ("missing_exponent_base", r"\(\^(\{[^}]+\})\)", r"(10^\1)"), ("unit_broken_exponent", r"([a-zA-Z])\(\{(-?\d+)\}\)", r"\1^{\2}"),
    ("missing_comparison_r_star", r"\bFor\s+r\s+r\*", "For r < r*", _LESS), ("missing_comparison_r_s", r"\bFor\s+r\s+r_s", "For r < r_s", _LESS),
    ("duplicated_word", r"\b(the|a|an|is|are|was|were|in|on|at|to|for|of|and|or|der|die|das|und|oder|ist|sind|war|für|von|mit)\s+\1\b", r"\1"),
    ("missing_space_after_period", r"([a-z])\.([A-Z][a-z]{2,})", r"\1. \2"),
    ("broken_subscript", r"([a-zA-Z])\s*_\s*([a-zA-Z0-9])", r"\1_\2"), ("broken_superscript", r"([a-zA-Z0-9])\s*\^\s*([a-zA-Z0-9{])", r"\1^\2"),
]]

OPERATORS = {"smaller": "<", "less": "<", "below": "<", "under": "<", "lower": "<", "greater": ">", "larger": ">", "above": ">", "over": ">", "higher": ">"}


def near(text: str, at: int, width: int) -> str:
    return text[max(0, at - width) : at + width].lower()


def _operator(m: re.Match, text: str) -> str:
    around = near(text, m.start(), 200)
    return f"For r {next((o for w, o in OPERATORS.items() if w in around), '<')} r{m.group(1)}"


#: The operator of the first keyword within 200 characters, else '<'.
CONTEXT = [("missing_less_than", r"For\s+r\s+r([*_])", _operator)]
