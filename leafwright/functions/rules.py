"""Fixed values of the rules: patterns, word lists, weights and limits that results depend on.

Patterns are in Java syntax for Spark; rules that SQL checks also run use only what RE2 shares with it.
"""

from __future__ import annotations

# --- Fixed values: line classes ----------------------------------------------------------------------------------------
NUMBERED_HEADING = r"^([0-9]+(\.[0-9]+)*)\.\s+"
ROMAN_HEADING = r"^(I{1,3}|IV|V|VI{0,3}|IX|X)\.\s+"
HEADING_WORDS = [
    "Abstract", "Introduction", "Background", "Methods", "Methodology", "Results", "Discussion", "Conclusion", "Conclusions",
    "References", "Acknowledgments", "Acknowledgements", "Appendix", "Bibliography", "Summary", "Overview", "Theory", "Analysis",
    "Experiments", "Related Work", "Future Work", "Limitations",
]
BULLET = r"^[•\-*+]\s+"
LIST_ITEM = r"^([0-9]+[.)]\s+|\([0-9]+\)\s+|\([a-z]\)\s+|[a-z][.)]\s+)"
CAPTION = r"(?i)^(Figure|Fig\.|Table|Tab\.)\s*[0-9]+"
ABBREVIATION_END = r"\b(Dr|Mr|Mrs|Ms|Prof|Fig|Tab|Eq|et al|vs|i\.e|e\.g)\.$"

# --- Fixed values: formulas and terms ----------------------------------------------------------------------------------
QA_FORMULAS = [
    r"(?s)\$\$.*?\$\$", r"(?s)\$[^$]+\$", r"(?s)\\\[.*?\\\]", r"(?s)\\\(.*?\\\)",
    r"(?s)\\begin\{equation\*?\}.*?\\end\{equation\*?\}", r"(?s)\\begin\{align\*?\}.*?\\end\{align\*?\}",
]
CAPITALISED_PHRASE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
ACRONYM = r"\b[A-Z]{2,6}\b"
LATEX_GREEK = r"\\(?:alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|pi|rho|sigma|tau|upsilon|phi|chi|psi|omega)\b"
NUMBER_TERM, HYPHEN_TERM = r"\b[A-Za-z]+[0-9]+\b", r"\b[A-Za-z]+-[A-Za-z]+\b"
PAIR_FORMULAS = [
    r"\$[^$]+\$", "[αβγδεζηθικλμνξοπρσςτυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ]", "[∂∇∫∮∑∏√∞±∓≈≠≤≥]", "[⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻]", "[₀₁₂₃₄₅₆₇₈₉₊₋]",
]
PAIR_REFERENCES = [r"\[[0-9]+(?:\s*[-–,]\s*[0-9]+)*\]", r"(?:Fig\.|Figure)\s*[0-9]+", r"Eq\.\s*\([0-9]+\)"]
PLACEHOLDER = r"⟦[A-Z]+_[a-fA-F0-9]+_[0-9]+⟧"
INLINE_HTML = r"<(?:sup|sub|b|i)[^>]*>"
UNRESTORED = [r"__LATEX_[0-9]+__", r"__LATEX_CMD_[0-9]+__", r"__GLOSS_[A-Z]+_[0-9]+__", r"__TERM_.*?__", r"__NAME_.*?__"]

# --- Fixed values: scores ----------------------------------------------------------------------------------------------
QA_WEIGHTS = {"formula": 0.35, "semantic": 0.30, "completeness": 0.20, "terminology": 0.15}
UNTESTED_SEMANTIC, BLOCK_TERMINOLOGY = 80.0, 90.0
LEVELS = [(90, "excellent"), (75, "good"), (60, "acceptable"), (40, "poor")]
GATE = {"min_ratio": 0.7, "max_ratio": 2.0, "min_sentences": 0.85, "max_sentences": 1.3}
META_RESPONSES = [r"^(I'm sorry|I cannot|I apologize|As an AI)", r"^(Here is|Here's|Below is|The following)", r"^(Translation|Translated|Übersetzung):?\s*$", r"^\[.*\]$", r"^I'd be happy to"]
REFUSALS = [
    "lo siento", "i'm sorry", "i cannot", "no puedo", "encrypted", "encriptado", "codificado", "encoded", "not clear",
    "no está claro", "could you please", "podrías proporcionar", "provide more context",
]
LIGATURE_NOISE = ["flfl", "fifi", "ffff", "flffli"]

# --- Fixed values: replacement chains (pattern, Java replacement), in order ---------------------------------------------
LLM_CLEANUP = [
    (r"(?i)<sup>([^<]+)</sup>", r"\$^{$1}\$"), (r"(?i)<sub>([^<]+)</sub>", r"\$_{$1}\$"),
    (r"(?i)<b>([^<]+)</b>", r"\\textbf{$1}"), (r"(?i)<strong>([^<]+)</strong>", r"\\textbf{$1}"),
    (r"(?i)<i>([^<]+)</i>", r"\\textit{$1}"), (r"(?i)<em>([^<]+)</em>", r"\\textit{$1}"),
    (r"<[^>]+>", ""), (r"\$\$([^$]+)\$\$", r"\\[$1\\]"), (r"\\\\", r"\\"),
    (r"\*\*([^*]+)\*\*", r"\\textbf{$1}"), (r"\*([^*]+)\*", r"\\textit{$1}"), (r"\n{3,}", "\n\n"), (r" {2,}", " "),
]
QUESTION_MARKS = [
    (r"\?(%)", "$1"), (r"([a-zA-ZäöüÄÖÜß])\?([0-9])", "$1 $2"), (r"([a-zA-ZäöüÄÖÜß])\?([A-ZÄÖÜ][a-zäöüß])", "$1-$2"),
    (r"([0-9A-Za-z_])\?([0-9A-Za-z_])", "$1 $2"), (r"\?\s+", " "), (r"\s+\?", " "),
]
GERMAN_STYLE = [
    (r"\bFigure\s+([0-9]+)", "Abbildung $1"), (r"\bfigure\s+([0-9]+)", "Abbildung $1"), (r"\bFig\.\s*([0-9]+)", "Abb. $1"), (r"\bfig\.\s*([0-9]+)", "Abb. $1"),
    (r"\bTable\s+([0-9]+)", "Tabelle $1"), (r"\btable\s+([0-9]+)", "Tabelle $1"), (r"\bEquation\s+([0-9]+)", "Gleichung $1"), (r"\bEq\.\s*([0-9]+)", "Gl. $1"),
    (r"\bSection\s+([0-9]+)", "Abschnitt $1"), (r"\bSec\.\s*([0-9]+)", "Abschn. $1"),
]
GREEK_CALLS = [(r"(?i)\bsigma\s*0\b", "σ0"), (r"(?i)\bsigma\s*\(", "σ("), (r"(?i)=\s*sigma\b", "= σ"), (r"(?i)\(\s*sigma\s*\)", "(σ)"), (r"(?i)\bkappa\s*\(", "κ("), (r"(?i)\brho\s*c", "ρc")]
GREEK_NAMES = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ",
    "nu": "ν", "xi": "ξ", "omicron": "ο", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
}
EXPONENT_DAMAGE = [
    (r"10\?([0-9]+)\?", "10^$1"), (r"10\?([²³⁴⁵⁶⁷⁸⁹⁰¹])\?", "10^$1"), (r"10\?[−-]\?([0-9])", "10^-$1"), (r"10\?\^?\?([0-9]+)", "10^$1"),
    (r"10\s+[−-]([0-9]+)", "10^-$1"), (r"([×x])\s*10\?\s*([0-9]+)", "$1\\10^$2"), (r"([0-9]+)\?[−-]\?([0-9]+)", "$1^-$2"),
]
UNIT_DAMAGE = [(r"([a-zA-Z])\?([a-zA-Z])", "$1.$2"), (r"(kg|g|m|s|Hz|eV|K)\?(m|s|Hz|K)", "$1.$2"), (r"(Hz|eV|K|m|s)\?(\s|$)", "$1$2")]
MINUS_VARIANTS = "−–—‐‑"
UNICODE_OUTPUT = [(r"</?[a-zA-Z][^>]*>", ""), (r"\\textbf\{([^}]+)\}", "$1"), (r"\\textit\{([^}]+)\}", "$1"), (r"\\emph\{([^}]+)\}", "$1")]
PLAIN_OUTPUT = [(r"<[^>]+>", ""), (r"\$[^$]+\$", "[formula]"), (r"\\[a-zA-Z]+\{[^}]*\}", "")]
SUPERSCRIPT = ("0123456789+-=ni*,", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼ⁿⁱ∗⸴")
SUBSCRIPT = ("0123456789+-=aeoxn", "₀₁₂₃₄₅₆₇₈₉₊₋₌ₐₑₒₓₙ")
DASHES, NO_SPACE_DASH = ("–—―‐‑", "-----"), "\u00ad"
SPACES = "\u00a0\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"

# --- Fixed values: damage of extracted text, literal, in order (I7) -------------------------------------------------------
EXTRACTION_DAMAGE = {
    "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl",
    "- \n": "", "-\n": "",
    "amplication": "amplification", "instabili ties": "instabilities", "reecting": "reflecting", "eective": "effective", "dierential": "differential", "coecient": "coefficient",
    "\ufffd": "", "  ": " ", "0.0.1 ": "", "1 2.": "2.",
    "\\expigg": "\\exp\\bigg", "\\exp igg": "\\exp\\bigg", "\\ ext{": "\\text{", " ext{": "\\text{", "\\rac{": "\\frac{", " rac{": "\\frac{",
    "\nangle": "\\rangle", " heta": "\\theta", "( heta": "(\\theta",
}

# --- Fixed values: Unicode to LaTeX (I17) ----------------------------------------------------------------------------------
LATEX_SYMBOLS = {
    "Α": "A", "Β": "B", "Γ": r"$\Gamma$", "Δ": r"$\Delta$", "Ε": "E", "Ζ": "Z", "Η": "H", "Θ": r"$\Theta$", "Ι": "I", "Κ": "K", "Λ": r"$\Lambda$", "Μ": "M",
    "Ν": "N", "Ξ": r"$\Xi$", "Ο": "O", "Π": r"$\Pi$", "Ρ": "P", "Σ": r"$\Sigma$", "Τ": "T", "Υ": r"$\Upsilon$", "Φ": r"$\Phi$", "Χ": "X", "Ψ": r"$\Psi$", "Ω": r"$\Omega$",
    "α": r"$\alpha$", "β": r"$\beta$", "γ": r"$\gamma$", "δ": r"$\delta$", "ε": r"$\varepsilon$", "ζ": r"$\zeta$", "η": r"$\eta$", "θ": r"$\theta$",
    "ι": r"$\iota$", "κ": r"$\kappa$", "λ": r"$\lambda$", "μ": r"$\mu$", "ν": r"$\nu$", "ξ": r"$\xi$", "ο": "o", "π": r"$\pi$",
    "ρ": r"$\rho$", "σ": r"$\sigma$", "τ": r"$\tau$", "υ": r"$\upsilon$", "φ": r"$\varphi$", "χ": r"$\chi$", "ψ": r"$\psi$", "ω": r"$\omega$",
    "ϕ": r"$\phi$", "ϵ": r"$\epsilon$", "ϑ": r"$\vartheta$", "ϱ": r"$\varrho$",
    "−": "-", "–": "-", "—": "-", "×": r"$\times$", "÷": r"$\div$", "±": r"$\pm$", "∓": r"$\mp$", "·": r"$\cdot$", "∗": r"$\ast$",
    "≤": r"$\leq$", "≥": r"$\geq$", "≠": r"$\neq$", "≈": r"$\approx$", "≡": r"$\equiv$", "∝": r"$\propto$", "≪": r"$\ll$", "≫": r"$\gg$", "∼": r"$\sim$", "≃": r"$\simeq$",
    "→": r"$\rightarrow$", "←": r"$\leftarrow$", "↔": r"$\leftrightarrow$", "⇒": r"$\Rightarrow$", "⇐": r"$\Leftarrow$", "⇔": r"$\Leftrightarrow$", "↑": r"$\uparrow$", "↓": r"$\downarrow$",
    "∂": r"$\partial$", "∇": r"$\nabla$", "∆": r"$\Delta$", "∫": r"$\int$", "∮": r"$\oint$", "∑": r"$\sum$", "∏": r"$\prod$", "√": r"$\sqrt{}$", "∞": r"$\infty$", "∅": r"$\emptyset$",
    "∈": r"$\in$", "∉": r"$\notin$", "⊂": r"$\subset$", "⊃": r"$\supset$", "⊆": r"$\subseteq$", "⊇": r"$\supseteq$", "∪": r"$\cup$", "∩": r"$\cap$", "∧": r"$\wedge$", "∨": r"$\vee$", "¬": r"$\neg$",
    "ℏ": r"$\hbar$", "ħ": r"$\hbar$", "ℓ": r"$\ell$", "℘": r"$\wp$", "ℜ": r"$\Re$", "ℑ": r"$\Im$", "⊕": r"$\oplus$", "⊗": r"$\otimes$", "⊥": r"$\perp$", "∥": r"$\parallel$",
    "†": r"$\dagger$", "‡": r"$\ddagger$", "°": r"$^\circ$", "′": "$'$", "″": "$''$", "…": "...",
    "₀": "$_0$", "₁": "$_1$", "₂": "$_2$", "₃": "$_3$", "₄": "$_4$", "₅": "$_5$", "₆": "$_6$", "₇": "$_7$", "₈": "$_8$", "₉": "$_9$", "₊": "$_+$", "₋": "$_-$", "₌": "$_=$",
    "ₐ": "$_a$", "ₑ": "$_e$", "ₒ": "$_o$", "ₓ": "$_x$", "ₕ": "$_h$", "ₖ": "$_k$", "ₗ": "$_l$", "ₘ": "$_m$", "ₙ": "$_n$", "ₚ": "$_p$", "ₛ": "$_s$", "ₜ": "$_t$",
    "⁰": "$^0$", "¹": "$^1$", "²": "$^2$", "³": "$^3$", "⁴": "$^4$", "⁵": "$^5$", "⁶": "$^6$", "⁷": "$^7$", "⁸": "$^8$", "⁹": "$^9$", "⁺": "$^+$", "⁻": "$^-$", "⁼": "$^=$", "ⁿ": "$^n$", "ⁱ": "$^i$",
    "\u202f": " ", "\xa0": " ", "\u2009": " ", "\u2003": " ", "\u2002": " ", "\u2004": " ", "\u2005": " ", "\u2006": " ",
}

# --- Fixed values: garbage characters of extraction (A19): U+FFFD-FFFF and the control characters but tab and line ends ------
GARBAGE = "\ufffd\ufffe\uffff" + "".join(chr(i) for i in range(32) if i not in (9, 10, 13))

# --- Fixed values: UTF-8 read as Latin-1 (I20) -----------------------------------------------------------------------------
MOJIBAKE = {"Ã¤": "ä", "Ã¶": "ö", "Ã¼": "ü", "Ã©": "é", "â€™": "'", 'â€"': "–", "â€œ": '"'}

# --- Fixed values: further rules ------------------------------------------------------------------------------------------
FIGURE_REFERENCES = [(r"\b(Figure|Fig\.|Table|Tab\.|Eq\.|Section)([0-9])", "$1 $2")]

# --- Fixed values: errors ----------------------------------------------------------------------------------------------
ERROR_CLASSES = [
    ("timeout", True, ["timeout", "timed out", "deadline exceeded"]), ("rate_limit", True, ["rate limit", "too many requests", "429"]),
    ("overload", True, ["overload", "503", "service unavailable", "busy"]), ("network", True, ["connection", "network", "unreachable", "refused"]),
    ("server_error", True, ["500", "502", "504", "internal server"]), ("context_length", False, ["context length", "too long", "max tokens"]),
    ("invalid_input", False, ["invalid", "malformed", "bad request", "400"]), ("auth_error", False, ["auth", "401", "403", "unauthorized", "forbidden"]),
]

# --- Fixed values: table cells -----------------------------------------------------------------------------------------
CELL_NOISE = r"[,.\s%$€£¥±×·]"
CELL_DIGITS = r"[0-9⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉⁻⁺]"
CELL_SYMBOLS = r"^[0-9\s.,±×·%$€£¥°]+$"
TABLE_NUMBERS = [r"\d+[.,]\d+\s*%", r"[€$£¥]\s*\d+[.,]?\d*", r"\d+[.,]?\d*\s*[€$£¥]", r"[±]?\d+[.,]\d+", r"\d+\s*×\s*10[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+"]
