"""Queries over documents and pages; damage, maths and cells are derived by fixed rules, the same in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwright.functions import protect as PR
from leafwright.functions import quality as Q
from leafwright.functions import rules as R
from leafwright.functions import text as T
from leafwright.operators import corpus as C
from leafwright.operators import pairs as P

from . import sql as S
from .pairs import _pairs

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


_PREFIX = "CASE (doc_id % 6)::INT WHEN 0 THEN '1.2. ' WHEN 1 THEN 'IV. ' WHEN 2 THEN '• ' WHEN 3 THEN '(a) ' WHEN 4 THEN 'Table 3: ' ELSE '' END"
_PREFIX_SPARK = "CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN '1.2. ' WHEN 1 THEN 'IV. ' WHEN 2 THEN '• ' WHEN 3 THEN '(a) ' WHEN 4 THEN 'Table 3: ' ELSE '' END"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split({_PREFIX} || text, E'\\n')) AS line FROM documents)
SELECT CASE WHEN {S.is_heading('line')} THEN 'heading' WHEN {S.is_bullet('line')} THEN 'bullet' WHEN {S.is_caption('line')} THEN 'caption' ELSE 'text' END AS kind, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM l GROUP BY 1""")
def line_classes(spark, d):
    """P1-P3, P10."""
    x = C.lines(_docs(spark, d).select("doc_id", F.concat(F.expr(_PREFIX_SPARK), "text").alias("text")))
    c = F.col("line")
    kind = F.when(T.is_heading(c), "heading").when(T.is_bullet(c), "bullet").when(T.is_caption(c), "caption").otherwise("text")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query(f"SELECT doc_id, {S.sentences('text')}::INTEGER AS sentences, len({S.tokens('text')})::INTEGER AS words FROM documents")
def sentence_counts(spark, d):
    """I28, I33."""
    return _docs(spark, d).select("doc_id", T.sentence_count(F.col("text")).alias("sentences"), F.size(T.tokens(F.col("text"))).alias("words"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 20")
def word_tokens_top(spark, d):
    """A top-k report."""
    return _docs(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(20)


_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')"


@query(f"SELECT term, count(*) AS docs FROM (SELECT unnest({S.terms(_ASCII)}) AS term FROM documents) GROUP BY term ORDER BY docs DESC, term LIMIT 50")
def technical_terms_top(spark, d):
    """A top-k report."""
    t = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    return _docs(spark, d).select(F.explode(T.technical_terms(t)).alias("term")).groupBy("term").agg(F.count("*").alias("docs")).orderBy(F.col("docs").desc(), "term").limit(50)


@query(f"SELECT page_id, {S.strip(S.chain('html', R.LLM_CLEANUP))} AS clean FROM pages")
def html_cleanup(spark, d):
    """I9."""
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.cleanup_llm(F.col("html")).alias("clean"))


@query(f"SELECT page_id, {S.chain('html', R.PLAIN_OUTPUT)} AS plain, {S.chain('html', R.UNICODE_OUTPUT)} AS unicode FROM pages WHERE NOT regexp_matches(html, '<su[bp]>')")
def normalize_output_unicode(spark, d):
    """I15, plain and unicode, where no super- or subscript is: the part of normalize_output_all that SQL checks."""
    x = spark.read.parquet(f"{d}/pages.parquet").where(~F.col("html").rlike("<su[bp]>"))
    return x.select("page_id", T.normalize_output(F.col("html"), "plain").alias("plain"), T.normalize_output(F.col("html")).alias("unicode"))


@query()
def normalize_output_all(spark, d):
    """I15, plain and unicode of every page; rows only (SQL has no function for each body of a tag), tests compare with brute force."""
    x = spark.read.parquet(f"{d}/pages.parquet")
    return x.select("page_id", T.normalize_output(F.col("html"), "plain").alias("plain"), T.normalize_output(F.col("html")).alias("unicode"))


@query(f"SELECT page_id, {S.count('html', '<[^>]+>')}::INTEGER AS tags, {S.count('html', R.INLINE_HTML)}::INTEGER AS inline_tags, contains(html, chr(65533)) AS has_lost FROM pages")
def html_residue_warnings(spark, d):
    """Q17, Q21, A19."""
    return C.html_share(spark.read.parquet(f"{d}/pages.parquet"))


_ESC = {"\\": "\\textbackslash{}", "&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "_": "\\_", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"}


@query(f"SELECT doc_id, {S.replace_all('text', _ESC)} AS escaped FROM documents")
def latex_escape(spark, d):
    """I18."""
    return _docs(spark, d).select("doc_id", T.escape_latex(F.col("text")).alias("escaped"))


_GREEK = R.GREEK_CALLS + [(rf"(?i)\b{n}\b", g) for n, g in R.GREEK_NAMES.items()]


@query(f"SELECT doc_id, {S.chain(chr(40) + chr(39) + 'with Sigma 0, kappa (x), alpha and OMEGA ' + chr(39) + ' || doc_id || ' + chr(39) + ' = sigma of (sigma) ' + chr(39) + ' || lang)', _GREEK)} AS restored FROM documents")
def greek_name_restore(spark, d):
    """I13."""
    t = F.concat(F.lit("with Sigma 0, kappa (x), alpha and OMEGA "), F.col("doc_id").cast("string"), F.lit(" = sigma of (sigma) "), "lang")
    return _docs(spark, d).select("doc_id", T.restore_greek(t).alias("restored"))


_FIG = "'See Figure ' || doc_id || ', Fig. 2, table ' || doc_id % 9 || ' and Eq. ' || doc_id % 5 || '; Section 3, Sec. 4. ' || text"


@query(f"SELECT doc_id, {S.chain('(' + _FIG + ')', R.GERMAN_STYLE)} AS styled FROM documents")
def german_style(spark, d):
    """I12."""
    t = F.concat(F.lit("See Figure "), F.col("doc_id"), F.lit(", Fig. 2, table "), F.col("doc_id") % 9, F.lit(" and Eq. "), F.col("doc_id") % 5, F.lit("; Section 3, Sec. 4. "), "text")
    return _docs(spark, d).select("doc_id", T.german_style(t).alias("styled"))


@query(f"SELECT doc_id, {S.chain('replace(text, ' + chr(39) + 'ti' + chr(39) + ', ' + chr(39) + 't?i' + chr(39) + ')', R.QUESTION_MARKS)} AS repaired FROM documents WHERE lang = 'en'")
def question_mark_repair(spark, d):
    """I8, English documents only; question_mark_repair_all has every language."""
    return _docs(spark, d).where("lang = 'en'").select("doc_id", T.sanitize_unicode(F.replace("text", F.lit("ti"), F.lit("t?i"))).alias("repaired"))


@query(f"SELECT doc_id, {S.chain('replace(text, ' + chr(39) + 'ti' + chr(39) + ', ' + chr(39) + 't?i' + chr(39) + ')', R.QUESTION_MARKS)} AS repaired FROM documents")
def question_mark_repair_all(spark, d):
    """I8 over documents of every language."""
    return _docs(spark, d).select("doc_id", T.sanitize_unicode(F.replace("text", F.lit("ti"), F.lit("t?i"))).alias("repaired"))


_CELL = "CASE (l_linenumber % 4)::INT WHEN 0 THEN l_quantity || '×10?' || l_linenumber || '?' WHEN 1 THEN l_orderkey || ' 10 −' || l_linenumber || ' kg?m' WHEN 2 THEN l_linenumber || '–' || l_suppkey || ' GHz?' ELSE 'Name ' || l_returnflag END"


def _cells(spark, d):
    i = lambda c: F.col(c).cast("int").cast("string")
    n = F.col("l_linenumber") % 4
    t = (
        F.when(n == 0, F.concat(i("l_partkey"), F.lit("×10?"), i("l_linenumber"), F.lit("?")))
        .when(n == 1, F.concat(i("l_orderkey"), F.lit(" 10 −"), i("l_linenumber"), F.lit(" kg?m")))
        .when(n == 2, F.concat(i("l_linenumber"), F.lit("–"), i("l_suppkey"), F.lit(" GHz?")))
        .otherwise(F.concat(F.lit("Name "), "l_returnflag"))
    )
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", t.alias("cell"))


_CELL = "CASE (l_linenumber % 4)::INT WHEN 0 THEN l_partkey || '×10?' || l_linenumber || '?' WHEN 1 THEN l_orderkey || ' 10 −' || l_linenumber || ' kg?m' WHEN 2 THEN l_linenumber || '–' || l_suppkey || ' GHz?' ELSE 'Name ' || l_returnflag END"
_MINUS = f"translate(cell, '{R.MINUS_VARIANTS}', '-----')"


@query(f"WITH c AS (SELECT l_orderkey, l_linenumber, {_CELL} AS cell FROM lineitem), e AS (SELECT l_orderkey, l_linenumber, cell AS original, {S.chain('cell', R.EXPONENT_DAMAGE)} AS cell FROM c) SELECT l_orderkey, l_linenumber, {S.chain(_MINUS, R.UNIT_DAMAGE)} AS repaired FROM e")
def table_artifact_repair(spark, d):
    """R13-R15, R17 for numeric cells."""
    return _cells(spark, d).select("l_orderkey", "l_linenumber", T.fix_units(T.normalize_minus(T.fix_exponents(F.col("cell")), F.lit(True))).alias("repaired"))


@query(f"WITH c AS (SELECT l_orderkey, l_linenumber, {_CELL} AS cell FROM lineitem) SELECT l_orderkey, count(*) AS cells, count(*) FILTER ({S.is_numeric('cell')}) AS numeric_cells, coalesce(count(*) FILTER ({S.is_numeric('cell')}) < count(*) * 0.3, false) AS is_header FROM c GROUP BY l_orderkey")
def header_rows(spark, d):
    """An order is a row of cells."""
    g = _cells(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("cells"), F.count_if(T.is_numeric_content(F.col("cell"))).alias("numeric_cells"))
    return g.withColumn("is_header", F.col("numeric_cells") < F.col("cells") * F.lit(0.3))


@query(f"WITH c AS (SELECT {_CELL} AS cell FROM lineitem) SELECT cell, count(*) AS n, {S.is_numeric('cell')} AS is_numeric, {S.strip('cell')} <> '' AND NOT {S.is_numeric('cell')} AND NOT {S.match('cell', R.CELL_SYMBOLS)} AND length({S.strip('cell')}) > 2 AS translate FROM c GROUP BY ALL")
def numeric_cells(spark, d):
    """P11, P13."""
    return _cells(spark, d).groupBy("cell").agg(F.count("*").alias("n")).withColumns({"is_numeric": T.is_numeric_content(F.col("cell")), "translate": T.should_translate_cell(F.col("cell"))})


_DAMAGE = "replace(text, 'th', 't?h') || ' 10?' || doc_id || ' ?G_abcd_' || doc_id || '? 5?% ??'"


@query("WITH x AS (SELECT doc_id, " + _DAMAGE + " AS text FROM documents) SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, {S.lit(p)})) AS m FROM x" for k, p in C.CORRUPTIONS) + ") GROUP BY kind")
def corruption_counts_by_type(spark, d):
    """Our own six kinds, which SQL checks; corruption_places has all of R4."""
    t = F.concat(F.replace("text", F.lit("th"), F.lit("t?h")), F.lit(" 10?"), F.col("doc_id"), F.lit(" ?G_abcd_"), F.col("doc_id"), F.lit("? 5?% ??"))
    return C.corruption_rows(_docs(spark, d).select("doc_id", t.alias("text"))).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query()
def corruption_places(spark, d):
    """R4, every kind with place and context; rows only (look-arounds), tests compare with brute force."""
    t = F.concat(F.replace("text", F.lit("th"), F.lit("t?h")), F.lit(" 10?"), F.col("doc_id"), F.lit(" ?G_abcd_"), F.col("doc_id"), F.lit("? 5?% ?? [F_abcd_1] 3 ? 4 so\u00adft\u200b"))
    return C.corruption_places(_docs(spark, d).select("doc_id", t.alias("text")))


_GLYPHS = "g AS (SELECT event_id AS seq, 'G' || user_id AS glyph, CASE (event_id % 5)::INT WHEN 0 THEN 'the Temperature is' WHEN 1 THEN 'at frequency' WHEN 2 THEN 'wavelength of' WHEN 3 THEN 'approximately' ELSE 'nothing' END AS context FROM events), i AS (SELECT *, CASE WHEN contains(lower(context), 'temperature') THEN 'T' WHEN contains(lower(context), 'frequency') THEN 'f' WHEN contains(lower(context), 'wavelength') THEN 'λ' WHEN contains(lower(context), 'approximately') THEN '≈' END AS symbol FROM g), n AS (SELECT glyph, symbol, count(*) AS votes, min(seq) AS seq FROM i WHERE symbol IS NOT NULL GROUP BY ALL), v AS (SELECT glyph, arg_max(symbol, (votes, -seq)) AS symbol, max(votes) AS votes FROM n GROUP BY glyph)"


def _glyphs(spark, d):
    c = F.col("event_id") % 5
    context = F.when(c == 0, "the Temperature is").when(c == 1, "at frequency").when(c == 2, "wavelength of").when(c == 3, "approximately").otherwise("nothing")
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.concat(F.lit("G"), "user_id").alias("glyph"), context.alias("context"))


@query(f"WITH {_GLYPHS} FROM v")
def symbol_vote(spark, d):
    """A13, R6."""
    return C.symbol_votes(_glyphs(spark, d))


@query(f"WITH {_GLYPHS} SELECT seq, glyph, coalesce(i.symbol, v.symbol, '[[UNRESOLVED_GLYPH:' || glyph || ']]') AS resolved FROM i LEFT JOIN v USING (glyph)")
def glyph_resolution(spark, d):
    """R5-R8."""
    return C.resolve_glyphs(_glyphs(spark, d)).select("seq", "glyph", "resolved")


_SCI = "text || ' $x_' || doc_id % 7 || '$ and $$a$$ at [4, 33], Eq. (2), α∂² 5.3 GHz'"


def _science(spark, d):
    return _docs(spark, d).select("doc_id", F.concat("text", F.lit(" $x_"), F.col("doc_id") % 7, F.lit("$ and $$a$$ at [4, 33], Eq. (2), α∂² 5.3 GHz")).alias("text"))


@query(f"WITH x AS (SELECT doc_id, {_SCI} AS text FROM documents) SELECT doc_id, len({S.formulas('text')})::INTEGER AS formulas, {S.count('text', *R.PAIR_FORMULAS)}::INTEGER AS symbols, {S.count('text', *R.PAIR_REFERENCES)}::INTEGER AS refs FROM x")
def formula_inventory(spark, d):
    """F17, A16."""
    c = F.col("text")
    return _science(spark, d).select("doc_id", T.formula_count(c).alias("formulas"), Q.formula_symbols(c).alias("symbols"), Q.references(c).alias("refs"))


@query()
def formula_extract(spark, d):
    """rows only, as the priority of patterns needs a scan with state."""
    x = _science(spark, d).withColumn("p", PR.protect(F.col("text")))
    # explode would let Spark test the array first, for which it calls the function again
    return x.select("doc_id", F.explode_outer("p.spans").alias("s")).where("s is not null").groupBy("s.kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, true AS same, 0 AS missing FROM documents")
def protect_restore_roundtrip(spark, d):
    """Restoring what was protected gives the text again."""
    x = _science(spark, d).withColumn("p", PR.protect(F.col("text"))).withColumn("r", PR.restore(F.col("p.protected"), F.col("p.spans")))
    return x.select("doc_id", F.col("r").eqNullSafe(F.col("text")).alias("same"), F.size(PR.verify(F.col("r"), F.col("p.spans"))["missing"]).alias("missing"))


@query()
def latex_segments(spark, d):
    """rows only (union of pattern matches with look-around)."""
    t = F.concat(F.lit("\\documentclass{a} "), "text", F.lit(" $x$ \\cite{k} end"))
    x = _docs(spark, d).select("doc_id", F.explode(PR.segments(t)).alias("s"))
    return x.select("doc_id", "s.start", "s.end", "s.translate", F.length("s.text").alias("chars"))


@query()
def nfkc_normalize(spark, d):
    """Rows only (DuckDB has no NFKC)."""
    return _docs(spark, d).select("doc_id", F.sha2(PR.normalize_text(F.concat(F.lit("ﬁ 10⁻¹⁹ "), "text")), 256).alias("sha256"))


@query()
def reflow(spark, d):
    """Rows only (a fold over lines)."""
    return _docs(spark, d).select("doc_id", F.length(PR.reflow(F.col("text"))).alias("chars"), F.sha2(PR.reflow(F.col("text")), 256).alias("sha256"))


@query()
def chunk_text(spark, d):
    """Rows only (greedy packing)."""
    return _docs(spark, d).select("doc_id", F.posexplode(PR.chunk_text(F.col("text"))).alias("chunk", "t")).select("doc_id", "chunk", F.length("t").alias("chars"))


@query()
def damage_repair(spark, d):
    """Rows only (each rule sees the text that the one before left)."""
    t = F.concat(F.replace("text", F.lit("th"), F.lit("t?h")), F.lit(" 10?5? Figure3 7?%"))
    return _docs(spark, d).select(F.explode(PR.repair(t)["actions"]).alias("a")).groupBy("a.rule").agg(F.count("*").alias("n"))


_WORDS = lambda t, k, n: f"(SELECT {k}, len(w) AS {n}, unnest(w) AS word FROM (SELECT {k}, list_distinct({S.tokens('text')}) AS w FROM {t}))"


@query(f"WITH a AS {_WORDS('documents', 'doc_id AS block_id', 'na')}, b AS {_WORDS('benchmark', 'item_id AS para_id', 'nb')}, p AS (SELECT block_id, para_id, count(*) / greatest(any_value(na), any_value(nb))::DOUBLE AS score FROM a JOIN b USING (word) GROUP BY ALL) SELECT block_id, arg_max(para_id, (score, -para_id)) AS para_id, round(max(score), 6) AS score FROM p WHERE score > 0.3 GROUP BY block_id".replace("SELECT doc_id AS block_id, len", "SELECT block_id, len").replace("SELECT item_id AS para_id, len", "SELECT para_id, len"))
def near_duplicate_join(spark, d):
    """Documents against benchmark passages."""
    blocks = _docs(spark, d).select(F.col("doc_id").alias("block_id"), "text")
    para = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("para_id"), "text")
    return C.best_match(blocks, para).withColumn("score", F.round("score", 6))


_GLOSS_SQL = "g(term, lang) AS (VALUES " + ", ".join(f"('{t}', '{lang}')" for t, lang, _ in C.GLOSSARY) + ", ('the', 'en'), ('of', 'en'), ('and', 'en'))"


@query(f"WITH {_GLOSS_SQL}, w AS (SELECT DISTINCT doc_id, lang, unnest({S.tokens('text')}) AS term FROM documents) SELECT doc_id, count(*) AS terms, list_sort(list(DISTINCT term)) AS found FROM w JOIN g USING (term, lang) GROUP BY doc_id")
def glossary_coverage(spark, d):
    """J10, P19."""
    g = spark.createDataFrame([*C.GLOSSARY, ("the", "en", "the"), ("of", "en", "of"), ("and", "en", "and")], "term string, lang string, translation string")
    return C.glossary_coverage(_docs(spark, d), g)


@query("WITH l(code, name, script, direction) AS (VALUES " + ", ".join(str(x) for x in C.LANGUAGES) + ") SELECT script, list(name ORDER BY name) AS names, count(*) FILTER (direction = 'rtl') AS rtl FROM l GROUP BY script")
def languages_by_script(spark, d):
    """A27, P19."""
    return C.languages_by_script(spark.createDataFrame(C.LANGUAGES, "code string, name string, script string, direction string"))


@query("""WITH c AS (SELECT event_id // 8 AS t, event_id % 8 AS r, unnest([0, 1, 2]) AS col, unnest([user_id::VARCHAR, event_type, event_id::VARCHAR]) AS text FROM events),
r AS (SELECT t, r, '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' || CASE WHEN r = 0 THEN E'\\n|---|---|---|' ELSE '' END AS line FROM c GROUP BY t, r) SELECT t AS table_id, string_agg(line, E'\\n' ORDER BY r) AS markdown FROM r GROUP BY t""")
def table_markdown(spark, d):
    """K5: eight events are a table."""
    x = spark.read.parquet(f"{d}/events.parquet").select(F.floor(F.col("event_id") / 8).alias("table_id"), (F.col("event_id") % 8).alias("row"), F.posexplode(F.array(F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id").cast("string"))).alias("col", "text"))
    return C.table_markdown(x, "table_id")


@query()
def table_latex(spark, d):
    """Rows only (long text); K5 has the SQL check of the same grouping."""
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row"), F.posexplode(F.array(F.col("l_partkey").cast("string"), F.col("l_returnflag"))).alias("col", "text"), F.col("l_linenumber").alias("seq"))
    return C.table_latex(x, "table_id")


@query(f"""WITH {S.PAIRS}, s AS (SELECT conv_id, avg({S.completeness('original', 'translated')}) AS c, avg({S.formula_score('original', 'translated')}) AS f FROM pairs GROUP BY conv_id), o AS (SELECT *, {S.overall('f', '80.0::DOUBLE', 'c', '90.0::DOUBLE')} AS v FROM s)
SELECT conv_id, printf(E'# Quality\\n\\n| score | value |\\n|---|---|\\n| overall | %.3f |\\n| formulas | %.3f |\\n| completeness | %.3f |\\n\\nLevel: %s', v, f, c, {S.level('v')}) AS report FROM o""")
def qa_report_markdown(spark, d):
    """K7."""
    return C.quality_report(P.document_quality(P.score_pairs(_pairs(spark, d)), "conv_id"), "conv_id")


@query()
def dictionary_translate(spark, d):
    """The dictionary hook round protected formulas; rows only (protection is F3)."""
    x = PR.safe_apply(_pairs(spark, d).withColumn("source", F.concat("original", F.lit(" $the$"))), "source", C.dictionary_hook("de"))
    return x.select("conv_id", "turn", F.length("answer").alias("chars"), F.size("left").alias("left"), F.size("missing").alias("missing"))


@query(f"SELECT doc_id, len({S.tokens('text')}) > 20 AND len(list_distinct({S.tokens('text')})) / len({S.tokens('text')})::DOUBLE < 0.15 AS repetitive, len(list_filter({S.tokens('text')}, lambda w: length(w) > 1)) >= 3 AS significant FROM documents")
def text_guards(spark, d):
    """A21, P17b."""
    return _docs(spark, d).select("doc_id", Q.repeats_itself(F.col("text")).alias("repetitive"), T.has_significant_text(F.col("text")).alias("significant"))


_SECTIONS = "concat(coalesce(text, ''), chr(10), (doc_id % 3)::INT + 1, '. One', chr(10), (doc_id % 4)::INT + 1, '.2. Two')"


@query(f"WITH t AS (SELECT doc_id, regexp_extract_all({_SECTIONS}, '(?m)^([0-9]+(?:\\.[0-9]+)*)\\.[ \\t\\r\\n]+[^\\n]+', 1) AS h FROM documents) SELECT doc_id, len(h)::INTEGER AS headings, list_transform(h, lambda x: split_part(x, '.', 1)::HUGEINT) = list_sort(list_transform(h, lambda x: split_part(x, '.', 1)::HUGEINT)) AS in_order FROM t")
def heading_order(spark, d):
    """Two headings are put after each text."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit(". One\n"), (F.col("doc_id") % 4 + 1).cast("string"), F.lit(".2. Two"))
    h = _docs(spark, d).select("doc_id", Q.headings_in_order(text).alias("h"))
    return h.select("doc_id", F.size("h.headings").alias("headings"), F.col("h.in_order").alias("in_order"))


@query("""WITH p AS (SELECT doc_id % 50 AS book, coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN chr(65533) || chr(7) ELSE '' END AS text FROM documents),
b AS (SELECT book, count(*) AS n, sum(len(regexp_extract_all(text, '[' || chr(65533) || chr(65535) || chr(65534) || chr(1) || '-' || chr(8) || chr(11) || chr(12) || chr(14) || '-' || chr(31) || ']')))::BIGINT AS g FROM p GROUP BY book),
s AS (SELECT DISTINCT doc_id % 60 AS book, 17 + doc_id % 60 % 4 AS source_pages FROM documents)
SELECT book, coalesce(n, 0) AS page_count, coalesce(g, 0) AS garbage, concat_ws('; ', CASE WHEN n IS NULL THEN 'no output' END, CASE WHEN g > 0 THEN 'garbage: ' || g END, CASE WHEN n > source_pages + 2 THEN 'pages grew: ' || source_pages || ' to ' || n END) AS warnings FROM s LEFT JOIN b USING (book)""")
def build_reports(spark, d):
    """A document is a page of one of fifty books."""
    docs = _docs(spark, d)
    damaged = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 0, F.lit("\ufffd\u0007")).otherwise(F.lit("")))
    pages = docs.select((F.col("doc_id") % 50).alias("book"), damaged.alias("text"))
    books = docs.select((F.col("doc_id") % 60).alias("book")).distinct().withColumn("source_pages", 17 + F.col("book") % 4)
    return C.build_report(pages, books, "book")


@query()
def markdown_joined(spark, d):
    """Rows only; tests hold it against a version by hand."""
    return _docs(spark, d).select("doc_id", PR.join_markdown(F.concat(F.coalesce("text", F.lit("")), F.lit("\n# A\nα =\n+ β\nend"))).alias("text"))


@query()
def latex_symbols(spark, d):
    """Rows only; tests hold them against values by hand."""
    return _docs(spark, d).select("doc_id", T.latex_text(F.col("text")).alias("latex"))
