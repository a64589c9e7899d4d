"""Protection of formulas and other spans, and loss-free restoration: the F family, and functions that are folds over lines or spans.

What depends on the order of overlapping matches or on a stack is an Arrow function (batches.py); restoring, counting and
checking are built-in expressions.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from . import repairs as RP
from . import text as T
from .batches import over_texts

SPAN = "array<struct<original:string, placeholder:string, kind:string, start:int, end:int>>"
PROTECTED = f"struct<protected:string, spans:{SPAN}>"


def _mark(prefix: str, content: str, index: int) -> str:
    return f"⟦{prefix}_{hashlib.md5(content.encode()).hexdigest()[:6]}_{index}⟧"


def _compiled(patterns, flags: int = re.DOTALL):
    return [(re.compile(p, flags), k) for p, k in patterns]


def by_priority(text: str, patterns) -> list[tuple[int, int, str]]:
    """Spans by pattern order: a match that overlaps one of an earlier pattern is lost, even if it encloses it."""
    starts: list[int] = []
    taken: list[tuple[int, int, str]] = []
    for p, kind in patterns:
        for m in p.finditer(text):
            a, b = m.span()
            i = bisect_left(starts, a)
            if a < b and (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                starts.insert(i, a)
                taken.insert(i, (a, b, kind))
    return taken


def leftmost_longest(text: str, patterns) -> list[tuple[int, int, str]]:
    """Spans by start, the longest first; later ones that overlap are lost."""
    found = sorted(((m.start(), -m.end(), k) for p, k in patterns for m in p.finditer(text) if m.end() > m.start()))
    out: list[tuple[int, int, str]] = []
    for a, b, k in found:
        if not out or out[-1][1] <= a:
            out.append((a, -b, k))
    return out


def union(text: str, patterns) -> list[tuple[int, int]]:
    """Regions covered by any pattern; touching ones are one."""
    out: list[list[int]] = []
    for a, b in sorted(m.span() for p, _ in patterns for m in p.finditer(text) if m.end() > m.start()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _substitute(text: str, spans, name: Callable[[str, int], str]) -> dict:
    parts, rows, at = [], [], 0
    for i, (a, b, kind) in enumerate(spans):
        mark = name(text[a:b], i)
        parts += [text[at:a], mark]
        rows.append({"original": text[a:b], "placeholder": mark, "kind": kind, "start": a, "end": b})
        at = b
    return {"protected": "".join(parts) + text[at:], "spans": rows}


def _udf(f: Callable[[str], object], kind: str):
    """f over texts, a piece of a batch at a time; null in, null out (with PROTECTED: no spans)."""
    return over_texts(f, kind, {"protected": None, "spans": []} if kind == PROTECTED else None)


def protect(c: Column, patterns=None, prefix: str = "F") -> Column:
    """priority-greedy protection; struct(protected, spans)."""
    own = _compiled(patterns or P.ALL)
    return _udf(lambda t: _substitute(t, by_priority(t, own), lambda x, i: _mark(prefix, x, i)), PROTECTED)(c)


def protect_longest(c: Column) -> Column:
    """F8: leftmost-longest; the mark has no index, so repeats share one."""
    return _udf(lambda t: _substitute(t, leftmost_longest(t, _compiled(P.FORMULAS[4:])), lambda x, i: f"⟦F_{hashlib.md5(x.encode()).hexdigest()[:8]}⟧"), PROTECTED)(c)


def protect_simple(c: Column) -> Column:
    """one alternation, __FORMULA_n__."""
    return _udf(lambda t: _substitute(t, [(m.start(), m.end(), "formula") for m in re.finditer(P.SIMPLE, t, re.DOTALL)], lambda x, i: f"__FORMULA_{i}__"), PROTECTED)(c)


def _in_turn(text: str, patterns, name: str) -> dict:
    """Each pattern over what the ones before have left, marks included."""
    rows: list[dict] = []
    for p, kind in patterns:

        def put(m, kind=kind):
            rows.append({"original": m.group(0), "placeholder": name.format(len(rows)), "kind": kind, "start": m.start(), "end": m.end()})
            return rows[-1]["placeholder"]

        text = p.sub(put, text)
    return {"protected": text, "spans": rows}


def protect_markdown(c: Column) -> Column:
    """34 patterns in turn, over marks as well, so parts of earlier marks are protected again; restoring undoes the last first."""
    return _udf(lambda t: _in_turn(t, _compiled(P.MARKDOWN, 0), "__PROTECTED_{}__"), PROTECTED)(c)


def protect_latex(c: Column) -> Column:
    """53 patterns in turn for LaTeX sources, over lines."""
    return _udf(lambda t: _in_turn(t, _compiled(P.LATEX_FILE, re.MULTILINE), "__LATEX_PROTECTED_{}__"), PROTECTED)(c)


def protect_commands(c: Column) -> Column:
    """F16: 21 inline commands in turn."""
    return _udf(lambda t: _in_turn(t, _compiled(P.INLINE_COMMANDS, 0), "__LATEX_CMD_{}__"), PROTECTED)(c)


def protect_numbers(c: Column) -> Column:
    """numbers of table cells."""
    from .rules import TABLE_NUMBERS

    return _udf(lambda t: _in_turn(t, _compiled([(p, "number") for p in TABLE_NUMBERS]), "⟦NUM_{}⟧"), PROTECTED)(c)


def restore(text: Column, spans: Column) -> Column:
    """Marks back to originals, the last one first, as later ones may hold earlier marks."""
    return F.aggregate(F.reverse(spans), text, lambda a, s: F.replace(a, s["placeholder"], s["original"]))


def verify(restored: Column, spans: Column) -> Column:
    """struct(leftover marks, originals missing apart from blanks); the text without blanks is made once, as a lambda's variable."""
    flat = lambda c: F.regexp_replace(c, r"\s+", "")
    lost = F.transform(F.array(flat(restored)), lambda t: F.transform(F.filter(spans, lambda s: ~F.contains(t, flat(s["original"]))), lambda s: s["original"]))
    return F.struct(F.regexp_extract_all(restored, F.lit("⟦[A-Z]+_[^⟧]*⟧"), 0).alias("left"), lost[0].alias("missing"))


def safe_apply(df: DataFrame, column: str, hook: Callable[[Column], Column]) -> DataFrame:
    """protect, call the hook on the rest, restore and check: adds answer, left and missing. The protected text is a column
    of its own, so the Python stage runs once before the expressions that use it."""
    x = df.withColumn("_p", protect(F.col(column)))
    x = x.withColumn("answer", restore(hook(F.col("_p.protected")), F.col("_p.spans")))
    v = verify(F.col("answer"), F.col("_p.spans"))
    return x.withColumns({"left": v["left"], "missing": v["missing"]}).drop("_p")


def nested_environments(c: Column) -> Column:
    """outermost \\begin..\\end by depth as ENV marks, then F3; an environment without an end is left as it is."""
    edge = re.compile(r"\\(begin|end)\{([^}]*)\}")

    def run(t: str) -> dict:
        spans, stack = [], []
        for m in edge.finditer(t):
            if m.group(1) == "begin":
                stack.append((m.group(2), m.start()))
            elif any(n == m.group(2) for n, _ in stack):
                while stack[-1][0] != m.group(2):
                    stack.pop()
                _, a = stack.pop()
                spans = [s for s in spans if s[1] <= a] + [(a, m.end(), m.group(2))]
        return _substitute(t, spans, lambda x, i: _mark("ENV", x, i))

    return _udf(run, PROTECTED)(c)


SEGMENT = "array<struct<start:int, end:int, text:string, translate:boolean>>"


def segments(c: Column, patterns=None) -> Column:
    """protected and free parts in order; free parts of blanks only are left out."""
    own = patterns or P.LATEX_PARTS

    def run(t: str) -> list:
        out, at = [], 0
        for a, b in [*union(t, _compiled(own, re.DOTALL | re.MULTILINE)), (len(t), len(t))]:
            if t[at:a].strip():
                out.append({"start": at, "end": a, "text": t[at:a], "translate": True})
            if b > a:
                out.append({"start": a, "end": b, "text": t[a:b], "translate": False})
            at = b
        return out

    return _udf(run, SEGMENT)(c)


def protected_regions(c: Column) -> Column:
    """Union of protected spans as struct(s, e)."""
    return _udf(lambda t: [{"s": a, "e": b} for a, b in union(t, _compiled(P.ALL))], "array<struct<s:int, e:int>>")(c)


def nfkc(c: Column) -> Column:
    """I1's first step, which Spark has no function for."""
    return _udf(lambda t: unicodedata.normalize("NFKC", t), "string")(c)


def normalize_text(c: Column) -> Column:
    """I1."""
    return T.normalize_marks(nfkc(c))


_HEAD = re.compile(r"(\d+(\.\d+)*\.|(I{1,3}|IV|V|VI{0,3}|IX|X)\.)\s|#")


def reflow(c: Column) -> Column:
    """Wrapped lines joined by P6's rules; a trailing hyphen goes; runs of empty lines become one."""
    from . import rules as R

    words = re.compile("(" + "|".join(map(re.escape, R.HEADING_WORDS)) + r")( |:|$)")
    bullet, item, caption, short = re.compile(R.BULLET), re.compile(R.LIST_ITEM), re.compile(R.CAPTION), re.compile(R.ABBREVIATION_END)

    def starts(s: str) -> bool:
        return bool(_HEAD.match(s) or words.match(s) or bullet.match(s) or item.match(s) or caption.match(s))

    def joins(p: str, q: str) -> bool:
        if starts(q) or (p[-1] in ".!?:" and q[0].isupper() and not short.search(p)):
            return False
        return p.endswith("-") or q[0].islower() or p[-1] not in ".!?:;"

    def run(t: str) -> str:
        out: list[str] = []
        for line in t.split("\n"):
            s = line.strip()
            if not s:
                if out and out[-1]:
                    out.append("")
            elif out and out[-1] and joins(out[-1], s):
                out[-1] = out[-1][:-1] + s if out[-1].endswith("-") and s[0].islower() else out[-1] + " " + s
            else:
                out.append(s)
        return "\n".join(out).strip()

    return _udf(run, "string")(c)


def chunk_text(c: Column, most: int = 2000) -> Column:
    """Paragraphs packed up to most characters; a longer one is packed by sentences. Nothing is lost."""

    def pack(parts: list[str], glue: str) -> list[str]:
        out: list[str] = []
        for p in parts:
            if out and len(out[-1]) + len(glue) + len(p) <= most:
                out[-1] += glue + p
            else:
                out.append(p)
        return out

    def run(t: str) -> list[str]:
        small: list[str] = []
        for p in (x.strip() for x in t.split("\n\n")):
            if len(p) > most:
                small += pack(re.split(r"(?<=[.!?])\s+", p), " ")
            elif p:
                small.append(p)
        return pack(small, "\n\n")

    return _udf(run, "array<string>")(c)


def chunk_markdown(c: Column, most: int = 2000) -> Column:
    """Cut at headers, which stay with their section, then as I29."""
    return chunk_text(F.array_join(F.filter(F.split(c, r"(?m)(?=^#{1,6} )"), lambda x: T.strip(x) != ""), "\n\n"), most)


ACTION = "struct<text:string, actions:array<struct<rule:string, original:string, fixed:string, context:string>>>"

#: Repairs of safe mode as (rule, pattern, replacement), in order: R1, R2, R3, R10, then our own for what these leave.
REPAIRS = [
    *RP.UNICODE, *RP.SAFE, *RP.CONTEXT, ("figure reference", r"\b(Figure|Fig\.|Table|Tab\.|Eq\.|Section)(\d)", r"\1 \2"),
    ("percent", r"\?(%)", r"\1"), ("exponent", r"10\?(\d+)\?", r"10^\1"), ("spaced exponent", r"10\s+[−-](\d+)", r"10^-\1"),
    ("number after word", r"([A-Za-zäöüÄÖÜß])\?(\d)", r"\1 \2"), ("compound", r"([^\W\d_])\?+([^\W\d_])", r"\1-\2"), ("spaces", r"[ \t]{2,}", " "),
]


def repair(c: Column, rules=None) -> Column:
    """struct(text, actions). Matches that touch a protected span are left; each rule works on the text the one
    before has left, from right to left, with spans found anew, so offsets are never stale."""
    own = [(name, re.compile(p), r, words) for name, p, r, *words in rules or REPAIRS]
    spans_of = _compiled([*P.FORMULAS[4:], (r"«(?:FORMULA|MATH|EQ)_\d+»", "marker")])

    def run(t: str) -> dict:
        actions, keep = [], None
        for name, p, r, words in own:
            if not (found := list(p.finditer(t))):
                continue
            if keep is None:  # no rule has changed t since
                keep = union(t, spans_of)
                starts = [a for a, _ in keep]
            # From at on, t is repaired; done holds that in pieces, the last one first, and head how it begins.
            done, head, at = [], "", len(t)
            for m in reversed(found):
                if (i := bisect_left(starts, m.end())) and m.start() < keep[i - 1][1]:
                    continue
                now = t[:at] + "".join(reversed(done)) if words or callable(r) else t
                if words and not any(w in RP.near(now, m.start(), 100) for w in words[0]):
                    continue
                fixed = r(m, now) if callable(r) else m.expand(r)
                if fixed == m.group(0):
                    continue
                after = (t[m.end() : min(at, m.end() + 20)] + head)[:20]
                actions.append({"rule": name, "original": m.group(0), "fixed": fixed, "context": t[max(0, m.start() - 20) : m.end()] + after})
                done += [t[m.end() : at], fixed]
                head, at = (fixed + after)[:20], m.start()
            if done:
                t, keep = t[:at] + "".join(reversed(done)), None
        return {"text": t, "actions": actions}

    return over_texts(run, ACTION, {"text": None, "actions": []})(c)


def apply_glossary(c: Column, names: list[str], keep: list[str], terms: dict[str, str]) -> Column:
    """Names, then words to keep, then terms (both longest first) become __GLOSS_KIND_n__; the counter runs on for every term."""

    def run(t: str) -> dict:
        rows, n = [], 0
        for kind, group in (("NAME", [(x, x) for x in names]), ("KEEP", [(x, x) for x in sorted(keep, key=lambda x: (-len(x), x))]), ("TERM", sorted(terms.items(), key=lambda x: (-len(x[0]), x[0])))):
            for word, value in group:
                mark, p = f"__GLOSS_{kind}_{n}__", re.compile(rf"\b{re.escape(word)}\b", re.IGNORECASE if kind == "TERM" else 0)
                if m := p.search(t):
                    rows.append({"original": value, "placeholder": mark, "kind": kind, "start": m.start(), "end": m.end()})
                    t = p.sub(mark, t)
                    n += 1
                elif kind == "TERM":
                    n += 1
        return {"protected": t, "spans": rows}

    return _udf(run, PROTECTED)(c)


def wrap(c: Column, width: float, size: float = 10.0) -> Column:
    """Greedy word wrap with a character width of half the font size."""
    most = max(1, int(width / (size * 0.5)))

    def run(t: str) -> list[str]:
        out: list[str] = []
        for w in t.split():
            if out and len(out[-1]) + 1 + len(w) <= most:
                out[-1] += " " + w
            else:
                out.append(w)
        return out

    return _udf(run, "array<string>")(c)


def error_positions(c: Column, opening: str = "{", closing: str = "}") -> Column:
    """Q1, Q2 with positions: struct(position, kind) of each bracket without a partner; a character after a backslash does not count."""

    def run(t: str) -> list:
        stack, out, i = [], [], 0
        while i < len(t):
            if t[i] == "\\":
                i += 1
            elif t[i] == opening:
                stack.append(i)
            elif t[i] == closing:
                if stack:
                    stack.pop()
                else:
                    out.append({"position": i, "kind": "unopened"})
            i += 1
        return sorted(out + [{"position": p, "kind": "unclosed"} for p in stack], key=lambda x: x["position"])

    return _udf(run, "array<struct<position:int, kind:string>>")(c)


_OWN_LINE = ("#", "- ", "* ", "$$", "\\[", "\\begin{")
#: Characters of a line that is a piece of a formula, and the longest such line.
_MATHS_LINE, _MATHS_LENGTH = re.compile(r"[\s\d+\-=*/()\[\]{}^\\_$α-ωΑ-Ωℏ∂∇∫∑∏√∞±×÷≤≥≠≈→←↔⇒⇐⇔]+"), 20


def _runs(lines: list[str], kind: Callable[[str], str], join: str) -> list[str]:
    """Lines stripped and put together wherever kind is join."""
    out: list[str] = []
    for k, run in groupby(lines, kind):
        out += [" ".join(x.strip() for x in run)] if k == join else [x if k else "" for x in run]
    return out


def join_markdown(c: Column) -> Column:
    """Lines of a paragraph are one line, headings inside a line get their own, pieces of formulas that follow each other are one
    line; blank lines, headings, list items and display maths stay lines."""

    def line(x: str) -> str:
        x = x.strip()
        return "" if not x else "own" if x.startswith(_OWN_LINE) else "text"

    def maths(x: str) -> str:
        x = x.strip()
        return "maths" if x and len(x) < _MATHS_LENGTH and _MATHS_LINE.fullmatch(x) else "other"

    def run(t: str) -> str:
        t = "\n".join(_runs(t.split("\n"), line, "text"))
        for mark in ("###", "##"):
            t = re.sub(rf"(\S)\s*{mark}\s+", rf"\1\n\n{mark} ", t)
        return "\n".join(_runs(t.split("\n"), maths, "maths"))

    return _udf(run, "string")(c)
