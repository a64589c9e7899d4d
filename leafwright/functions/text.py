
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .batches import over_texts

BLANKS = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Without leading and trailing ASCII blanks; a null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def chain(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression replacements."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def replace_all(c: Column, pairs: dict[str, str]) -> Column:
    """Ordered literal replacements."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs.items(), c)


def count_any(c: Column, patterns: list[str]) -> Column:
    """Sum of the match counts of several patterns."""
    return reduce(lambda a, b: a + b, [F.regexp_count(c, F.lit(p)) for p in patterns])


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def tokens(c: Column) -> Column:
    """Lower-case words between runs of ASCII blanks."""
    return F.filter(F.split(F.lower(c), "[ \t\n\r]+"), lambda x: x != "")


# P: predicates -----------------------------------------------------------------------------------------------------------
def is_heading(line: Column) -> Column:
    """Numbered, roman-numbered, a known section word followed by end, blank or colon, or a leading #."""
    x = strip(line)
    words = "^(" + "|".join(R.HEADING_WORDS) + ")( |:|$)"
    return x.rlike(R.NUMBERED_HEADING) | x.rlike(R.ROMAN_HEADING) | x.rlike(words) | x.startswith("#")


def is_bullet(line: Column) -> Column:
    """A bullet mark or list number, then a blank."""
    x = strip(line)
    return x.rlike(R.BULLET) | x.rlike(R.LIST_ITEM)


def is_caption(line: Column) -> Column:
    """Figure, Fig., Table or Tab. with a number."""
    return strip(line).rlike(R.CAPTION)


def caption_parts(line: Column) -> Column:
    """struct(is_caption, kind, number) in English and German; the table rule comes first."""
    x = strip(line)
    table, figure = r"(?i)^(?:Table|Tab\.|Tabelle)\s*([0-9]+)", r"(?i)^(?:Figure|Fig\.|Abbildung|Abb\.)\s*([0-9]+)"
    kind = F.when(x.rlike(table), "table").when(x.rlike(figure), "figure")
    number = F.when(x.rlike(table), F.regexp_extract(x, table, 1)).when(x.rlike(figure), F.regexp_extract(x, figure, 1))
    return F.struct(kind.isNotNull().alias("is_caption"), kind.alias("kind"), number.cast("int").alias("number"))


def is_table_caption(line: Column) -> Column:
    """A table caption in English, German, French, Spanish, Italian, Portuguese, Russian, Chinese or Japanese."""
    return strip(line).rlike(r"(?iu)^(Table|Tab\.|Tabelle|Tableau|Tabla|Tabella|Tabela|Таблица|表)\s*[0-9]+")


def should_join(prev: Column, curr: Column) -> Column:
    """Whether a line continues the one before."""
    p, c = strip(prev), strip(curr)
    ends = p.rlike(r"[.!?:]$") & c.rlike(r"^\p{Lu}") & ~p.rlike(R.ABBREVIATION_END)
    start = is_heading(c) | is_bullet(c) | is_caption(c)
    return F.when((p == "") | (c == "") | start | ends, False).otherwise(p.endswith("-") | c.rlike(r"^\p{Ll}") | ~p.rlike(r"[.!?:;]$"))


def is_translatable(text: Column, least: int = 3) -> Column:
    """P7 (least 3), P7b (least 2): long enough, with a letter, no address, not only a number or date."""
    x = strip(text)
    return (F.length(x) >= least) & x.rlike(r"\p{L}") & ~x.rlike(r"(https?://|www\.|[^\s@]+@[^\s@]+\.[^\s@]+)") & ~x.rlike(r"^[0-9\s.,:/×-]+$")


def is_formula_text(text: Column) -> Column:
    """LaTeX marks, Greek, maths signs, more than two symbols a word, or a letter with index at the start."""
    symbols = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]"))
    return text.rlike(r"[$\\]") | text.rlike("[α-ωΑ-Ω]") | text.rlike(R.PAIR_FORMULAS[2]) | (symbols > 2 * F.size(tokens(text))) | text.rlike("^[A-Za-z][_^]")


def is_formula_block(text: Column) -> Column:
    """Under 100 characters with more than three maths signs, LaTeX, or a capital before an equals sign."""
    return (F.length(text) < 100) & ((F.regexp_count(text, F.lit("[=+*/^_<>∂∇∫∑∏√∞±≈≠≤≥-]")) > 3) | text.rlike(r"\\[a-zA-Z]+") | text.rlike(r"^[A-Z]\s*="))


def element_type(text: Column) -> Column:
    """P10: image_placeholder, caption, table, formula or text; the first that fits."""
    return (
        F.when(text.rlike(R.PLACEHOLDER) | F.contains(text, F.lit("[IMAGE")), "image_placeholder")
        .when(is_caption(text) & ~F.lower(text).startswith("table"), "caption")
        .when(F.lower(text).startswith("table") | (F.regexp_count(text, F.lit("\t")) > 2), "table")
        .when(is_formula_block(text), "formula")
        .otherwise("text")
    )


def is_numeric_content(cell: Column) -> Column:
    """Over 70 % digits (with super- and subscripts) once separators and currency are gone; empty is not."""
    x = F.regexp_replace(cell, R.CELL_NOISE, "")
    return F.when(F.length(x) == 0, False).otherwise(F.regexp_count(x, F.lit(R.CELL_DIGITS)) / F.length(x) > F.lit(0.7))


def is_header_row(cells: Column) -> Column:
    """Fewer than 30 % numeric cells; no cells is none."""
    n = F.size(F.filter(cells, is_numeric_content))
    return F.when(F.size(cells) == 0, False).otherwise(n < F.size(cells) * F.lit(0.3))


def should_translate_cell(cell: Column) -> Column:
    """Not blank, numeric, only symbols or at most two characters."""
    return (strip(cell) != "") & ~is_numeric_content(cell) & ~cell.rlike(R.CELL_SYMBOLS) & (F.length(strip(cell)) > 2)


def is_placeholder(text: Column) -> Column:
    """P14."""
    return text.rlike("^" + R.PLACEHOLDER)


def has_complex_formulas(pages: Column, most: int = 10) -> Column:
    """Over 10 indicator hits in the first three pages."""
    return F.aggregate(F.slice(pages, 1, 3), F.lit(0), lambda a, p: a + count_any(p, [r"\\[a-zA-Z]+", "[∂∇∫∑∏√∞±≈≠≤≥]", r"\$[^$]+\$"])) > most


def has_significant_text(text: Column) -> Column:
    """Three words or more of over one character."""
    return F.size(F.filter(tokens(text), lambda w: F.length(w) > 1)) >= 3


def should_ocr(width: Column, height: Column) -> Column:
    """P17."""
    return (width >= 50) & (height >= 50)


def is_formula_image(width: Column, height: Column, white: Column, dark: Column) -> Column:
    """P16 on measured shares: small enough, wide enough, mostly white with some ink."""
    return width.between(20, 2000) & height.between(10, 800) & (width / height).between(0.3, 20) & (white >= 0.5) & (dark > 0.01)


def in_regions(position: Column, regions: Column) -> Column:
    """P20: inside any half-open region struct(s, e)."""
    return F.exists(regions, lambda r: (position >= r["s"]) & (position < r["e"]))


def is_passthrough(language: Column) -> Column:
    """P22."""
    return F.upper(language).isin("PASSTHROUGH", "ORIGINAL", "NONE", "ENGLISH")


def mostly_protected(text: Column) -> Column:
    """More placeholders than half the words."""
    return F.regexp_count(text, F.lit(r"(⟦[A-Z]+_|__[A-Z]+_[A-Z_]*[0-9]+__)")) > F.size(tokens(text)) / 2


def is_blank_page(text: Column, images: Column, drawings: Column) -> Column:
    """P24."""
    return (F.length(strip(text)) <= 10) & (images == 0) & (drawings <= 5)


# I: string functions ------------------------------------------------------------------------------------------------------
def normalize_marks(c: Column) -> Column:
    """I1 without NFKC (see protect.nfkc): zero-width, ligatures, dashes (U+2212 stays), spaces, ? repair, blanks."""
    x = F.translate(c, R.ZERO_WIDTH + R.NO_SPACE_DASH, "")
    x = F.translate(replace_all(x, R.LIGATURES), R.DASHES[0] + R.SPACES, R.DASHES[1] + " " * len(R.SPACES))
    x = to_latex_runs(fix_question_marks(x))
    return strip(chain(x, [(r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")]))


def fix_question_marks(c: Column) -> Column:
    """A question mark inside a word is a lost hyphen; after a number before superscripts it goes."""
    return chain(c, [(r"(?U)(\w)\?+(\w)", "$1-$2"), (r"([0-9])\?([⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)\??", "$1$2")])


def superscripts_to_latex(c: Column) -> Column:
    """A run of superscripts becomes ^{...}."""
    plain, up = R.SUPERSCRIPT[0][:13], R.SUPERSCRIPT[1][:13]
    return F.translate(F.regexp_replace(c, f"([{up}]+)", "^{$1}"), up, plain)


def subscripts_to_latex(c: Column) -> Column:
    """I4."""
    plain, low = R.SUBSCRIPT
    return F.translate(F.regexp_replace(c, f"([{low}]+)", "_{$1}"), low, plain)


def to_latex_runs(c: Column) -> Column:
    return subscripts_to_latex(superscripts_to_latex(c))


def fix_encoding(c: Column) -> Column:
    """Ligatures, broken words, numbering and LaTeX commands, literally and in order."""
    return replace_all(c, R.EXTRACTION_DAMAGE)


def sanitize_unicode(c: Column) -> Column:
    """I8."""
    return chain(c, R.QUESTION_MARKS)


def cleanup_llm(c: Column) -> Column:
    """HTML and Markdown to LaTeX, other tags out, blanks in order."""
    return strip(chain(c, R.LLM_CLEANUP))


def drop_lead_in(c: Column) -> Column:
    """Meta lines and code fences at the beginning, echoed prompts, quotes round the whole."""
    x = F.regexp_replace(c, r"(?i)\A(\s*(here is|here's|below is|the following|translation:|translated text:|sure[,!])[^\n]*\n)+", "")
    x = chain(x, [(r"(?m)^```[a-z]*\s*$", ""), (r"(?im)^(translate the following|target language|source text|rules?):.*$", "")])
    return strip(F.regexp_replace(strip(x), r'(?s)^"(.*)"$', "$1"))


def accept_length(answer: Column, source: Column, share: float = 0.3) -> Column:
    """The cleaned answer if it has 30 % of the source's length, else the source."""
    x = drop_lead_in(answer)
    return F.when(F.length(x) >= F.length(source) * F.lit(share), x).otherwise(source)


def german_style(c: Column) -> Column:
    """I12."""
    return chain(c, R.GERMAN_STYLE)


def restore_greek(c: Column) -> Column:
    """Call forms first, then names of letters; names are read without case, so capitals fall to the lower-case rule."""
    return chain(c, R.GREEK_CALLS + [(rf"(?i)\b{n}\b", g) for n, g in R.GREEK_NAMES.items()])


def symbols_to_ascii(c: Column) -> Column:
    """I14."""
    return F.translate(c, "•●◦▪★☆✓✔–—", "***" + "*" + "**" + "vv" + "--")


def to_superscript(c: Column) -> Column:
    """I16."""
    return F.translate(c, *R.SUPERSCRIPT)


def to_subscript(c: Column) -> Column:
    """I16b."""
    return F.translate(c, *R.SUBSCRIPT)


def normalize_output(c: Column, mode: str = "unicode") -> Column:
    """Unicode, latex or plain output. In unicode, sup and sub bodies of digits and signs become characters."""
    if mode == "plain":
        return chain(c, R.PLAIN_OUTPUT)
    if mode == "latex":
        return chain(unicode_to_latex(c), [(r"<sup>([^<]+)</sup>", "^{$1}"), (r"<sub>([^<]+)</sub>", "_{$1}"), (r"<b>([^<]+)</b>", r"\\textbf{$1}"), (r"<i>([^<]+)</i>", r"\\textit{$1}"), (r"</?[a-zA-Z][^>]*>", "")])
    return chain(_raise_tag(_raise_tag(c, "sup", to_superscript), "sub", to_subscript), R.UNICODE_OUTPUT)


def _raise_tag(c: Column, tag: str, f) -> Column:
    """Each body of a tag by f, the tag gone."""
    found = F.regexp_extract_all(c, F.lit(f"<{tag}>([^<]+)</{tag}>"), 1)
    return F.aggregate(found, c, lambda a, x: F.replace(a, F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>")), f(x)))


def unicode_to_latex(c: Column) -> Column:
    """Greek letters, signs, sub- and superscripts to commands between dollars, odd blanks to blanks. No replacement holds
    a source, so the order is of no account; texts without a source are left alone."""
    return F.when(c.rlike("[" + "".join(R.LATEX_SYMBOLS) + "]"), replace_all(c, R.LATEX_SYMBOLS)).otherwise(c)


def latex_text(c: Column) -> Column:
    """fix_encoding of unicode_to_latex, in one Arrow function: a search for any of the symbols, not a pass over the text for each."""
    symbol = re.compile("[" + "".join(R.LATEX_SYMBOLS) + "]")

    def run(t: str) -> str:
        if not t.isascii():
            t = symbol.sub(lambda m: R.LATEX_SYMBOLS[m.group(0)], t)
        for damage, repaired in R.EXTRACTION_DAMAGE.items():
            t = t.replace(damage, repaired)
        return t

    return over_texts(run, "string")(c)


def escape_latex(c: Column, skip_backslash: bool = False) -> Column:
    """I18 (I18b with skip_backslash): nine special characters; texts with maths commands stay as they are."""
    pairs = {} if skip_backslash else {"\\": "\\textbackslash{}"}
    pairs |= {"&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "_": "\\_", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"}
    return F.when(c.rlike(r"\\(frac|sqrt|sum|int|alpha|beta|gamma|mathrm|text)\b"), c).otherwise(replace_all(c, pairs))


def utf8_warnings(c: Column) -> Column:
    """Array of warnings; empty if all is well."""
    many = F.when((F.regexp_count(c, F.lit(r"\?")) > 5) & F.contains(c, F.lit("??")), F.lit("double question marks"))
    lost = F.when(F.contains(c, F.lit("\ufffd")), F.concat(F.lit("replacement characters: "), F.regexp_count(c, F.lit("\ufffd")).cast("string")))
    return F.array_compact(F.array(many, lost, *[F.when(F.contains(c, F.lit(b)), F.lit(f"{b} should be {g}")) for b, g in R.MOJIBAKE.items()]))


def utf8_safe(raw: Column) -> Column:
    """The text of valid bytes; an error for others."""
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.raise_error(F.lit("not UTF-8")))


def sentence_count(c: Column) -> Column:
    """Parts of over ten characters between sentence ends, without ⟦F_hex⟧ marks."""
    return F.size(F.filter(F.split(F.regexp_replace(c, "⟦F_[a-f0-9]+⟧", ""), r"[.!?]+(\s|$)"), lambda s: F.length(strip(s)) > 10))


def technical_terms(c: Column, two_pass: bool = False) -> Column:
    """I30, and I31 with two_pass: distinct capitalised phrases, acronyms and Greek commands (number and hyphen terms too)."""
    patterns = [R.CAPITALISED_PHRASE, R.ACRONYM, R.LATEX_GREEK] + ([R.NUMBER_TERM, R.HYPHEN_TERM] if two_pass else [])
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(p), 0) for p in patterns]))))


def formulas(c: Column) -> Column:
    """matches of six patterns after each other, repeats included."""
    return F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(p), 0) for p in R.QA_FORMULAS]))


def dollars(c: Column) -> Column:
    """A text with each run of characters between dollar signs as one x: as many matches of what dollar signs alone delimit."""
    return F.regexp_replace(c, r"[^$]+", "x")


def count_if_there(c: Column, sign: str, patterns: list[str]) -> Column:
    """count_any of patterns whose matches all hold sign, a plain string, so that texts without it are searched once."""
    return F.when(~F.contains(c, F.lit(sign)), F.lit(0)).otherwise(count_any(c, patterns))


def formula_count(c: Column) -> Column:
    """the size of formulas; the first two patterns are counted over dollars, the rest begin with a backslash."""
    return count_any(dollars(c), R.QA_FORMULAS[:2]) + count_if_there(c, "\\", R.QA_FORMULAS[2:])


def format_duration(seconds: Column) -> Column:
    """Ns, Nm Ns or Nh Nm; negative is Unknown."""
    s = F.floor(seconds).cast("long")
    part = lambda x, u: F.concat(x.cast("string"), F.lit(u))
    h, m = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long")
    return (
        F.when(seconds < 0, "Unknown").when(s < 60, part(s, "s")).when(s < 3600, F.concat(part(m, "m "), part(s % 60, "s"))).otherwise(F.concat(part(h, "h "), part(F.floor((s % 3600) / 60).cast("long"), "m")))
    )


def progress_bar(percent: Column, width: int = 20) -> Column:
    """I35."""
    n = F.floor(F.greatest(F.lit(0), F.least(percent, F.lit(100))) * width / 100).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def language_code(name: Column) -> Column:
    """Code of a language name, else its first two letters."""
    known = {"english": "en", "german": "de", "deutsch": "de", "french": "fr", "spanish": "es", "italian": "it", "portuguese": "pt", "russian": "ru", "chinese": "zh", "japanese": "ja", "korean": "ko", "arabic": "ar", "hebrew": "he", "dutch": "nl", "polish": "pl"}
    x = F.lower(strip(name))
    return F.coalesce(F.create_map(*[F.lit(v) for p in known.items() for v in p])[x], F.substring(x, 1, 2))


def tesseract_language(name: Column) -> Column:
    """I24."""
    c = language_code(name)
    return F.coalesce(F.create_map(*[F.lit(v) for p in {"en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "pt": "por", "ru": "rus", "zh": "chi_sim", "ja": "jpn"}.items() for v in p])[c], F.lit("eng"))


def needs_cjk(name: Column) -> Column:
    """I24c."""
    return language_code(name).isin("zh", "ja", "ko")


def babel_option(name: Column) -> Column:
    """I24b."""
    c = language_code(name)
    return F.coalesce(F.create_map(*[F.lit(v) for p in {"de": "ngerman", "fr": "french", "es": "spanish", "it": "italian", "pt": "portuguese", "ru": "russian", "nl": "dutch", "pl": "polish"}.items() for v in p])[c], F.lit("english"))


def set_babel(latex: Column, name: Column) -> Column:
    """The document's babel option for a language."""
    return F.concat(F.regexp_replace(F.regexp_extract(latex, r"(?s)\A(.*?)\\usepackage\[[^\]]*\]\{babel\}", 0), r"\\usepackage\[[^\]]*\]\{babel\}", ""), F.when(latex.rlike(r"\\usepackage\[[^\]]*\]\{babel\}"), F.concat(F.lit("\\usepackage["), babel_option(name), F.lit("]{babel}"))).otherwise(F.lit("")), F.regexp_replace(latex, r"(?s)\A.*?\\usepackage\[[^\]]*\]\{babel\}", ""))


def _in_list(words: Column, known: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*known)))


def guess_language(c: Column) -> Column:
    """I27 (default hook): the language with most stop words among the words; en where none has any."""
    stop = {"en": "the and of to in is that for with", "de": "der die und das ist von mit den ein", "fr": "le la les et des est une dans pour", "es": "el los las y que del una con por"}
    t = tokens(c)
    votes = [F.struct(_in_list(t, s.split()).alias("n"), F.lit(-i).alias("rank"), F.lit(k).alias("lang")) for i, (k, s) in enumerate(stop.items())]
    return F.array_max(F.array(*votes))["lang"]


def cache_key(text: Column, language: Column, model: Column | None = None) -> Column:
    """language:model:first 16 hex digits of the SHA-256 of the trimmed lower-case text."""
    m = F.lit("any") if model is None else F.coalesce(model, F.lit("any"))
    return F.concat_ws(":", language, m, F.substring(F.sha2(F.lower(strip(text)), 256), 1, 16))


def placeholder(kind: str, content: Column, index: Column) -> Column:
    """⟦KIND_md5-6_index⟧."""
    return F.concat(F.lit(f"⟦{kind}_"), F.substring(F.md5(content), 1, 6), F.lit("_"), index.cast("string"), F.lit("⟧"))


# R: repairs ----------------------------------------------------------------------------------------------------------------
def fix_exponents(c: Column) -> Column:
    """R13."""
    return chain(c, R.EXPONENT_DAMAGE)


def normalize_minus(c: Column, numeric: Column) -> Column:
    """In numbers every minus variant becomes -, in text only between digits."""
    return F.when(numeric, F.translate(c, R.MINUS_VARIANTS, "-----")).otherwise(F.regexp_replace(c, f"([0-9])[{R.MINUS_VARIANTS}](?=[0-9])", "$1-"))


def fix_units(c: Column) -> Column:
    """R15."""
    return chain(c, R.UNIT_DAMAGE)


def infer_glyph(context: Column) -> Column:
    """A symbol from the words around, or null."""
    x = F.lower(context)
    has = lambda w: F.contains(x, F.lit(w))
    return F.when(has("temperature"), "T").when(has("frequency"), "f").when(has("wavelength"), "λ").when(has("plus") & has("minus"), "±").when(has("approximately"), "≈")


def resolve_glyphs(c: Column, context: Column) -> Column:
    """Glyph marks become the inferred symbol, or are marked as unresolved, never dropped."""
    return F.when(infer_glyph(context).isNotNull(), F.regexp_replace(c, F.lit(r"\?[A-Z]_[a-f0-9]{4,8}_\d+\?"), F.coalesce(infer_glyph(context), F.lit("")))).otherwise(F.regexp_replace(c, r"(\?[A-Z]_[a-f0-9]{4,8}_\d+\?)", "[[UNRESOLVED_GLYPH:$1]]"))


def repair_cell(c: Column, numeric: Column, context: Column) -> Column:
    """R13, R14, R15, R16 in this order."""
    return resolve_glyphs(fix_units(normalize_minus(fix_exponents(c), numeric)), context)


def repair_references(c: Column) -> Column:
    """R10."""
    return chain(c, R.FIGURE_REFERENCES)


def auto_fix_latex(c: Column) -> Column:
    """No U+FFFD, no trailing double backslash, an even number of dollar signs."""
    x = F.regexp_replace(F.replace(c, F.lit("\ufffd"), F.lit("")), r"\\\\\s*$", "")
    return F.when(F.regexp_count(x, F.lit(r"(?<!\\)\$")) % 2 == 1, F.concat(x, F.lit("$"))).otherwise(x)
