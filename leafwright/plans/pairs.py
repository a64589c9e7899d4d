"""Queries over conversation pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwright.functions import quality as Q
from leafwright.functions import rules as R
from leafwright.functions import text as T
from leafwright.operators import pairs as P

from . import sql as S

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


def _pairs(spark, d):
    return P.turn_pairs(_turns(spark, d))


#: Pairs with maths: derived text, the same in Spark and SQL.
_MATHS = "concat(original, ' $x_', CAST(conv_id % 7 AS STRING), '$ and $$y$$')", "CASE WHEN conv_id % 3 = 0 THEN translated WHEN conv_id % 3 = 1 THEN concat(translated, ' $x_', CAST(conv_id % 7 AS STRING), '$ ??') ELSE concat(translated, ' $ x_', CAST(conv_id % 7 AS STRING), '$ and $$y$$ $z$') END"
_MATHS_SQL = S.PAIRS + ", m AS (SELECT conv_id, turn, " + _MATHS[0].replace("STRING", "VARCHAR") + " AS original, " + _MATHS[1].replace("STRING", "VARCHAR") + " AS translated FROM pairs)"


def _maths(spark, d):
    return _pairs(spark, d).selectExpr("conv_id", "turn", f"{_MATHS[0]} AS original", f"{_MATHS[1]} AS translated")


@query(f"""WITH {S.PAIRS}, s AS (SELECT conv_id, {S.completeness('original', 'translated')} AS completeness, {S.similarity('original', 'translated')} AS similarity,
  {S.formula_score('original', 'translated')} AS formula_score, len({S.formulas('original')}) AS n_formulas FROM pairs),
g AS (SELECT conv_id, count(*) AS n_blocks, avg(completeness) AS completeness, avg(similarity) AS similarity, avg(formula_score) AS formula_score, sum(n_formulas)::BIGINT AS n_formulas FROM s GROUP BY conv_id),
o AS (SELECT *, {S.overall('formula_score', '80.0::DOUBLE', 'completeness', '90.0::DOUBLE')} AS overall FROM g)
SELECT conv_id, n_blocks, round(completeness, 4) AS completeness, round(similarity, 4) AS similarity, round(formula_score, 4) AS formula_score, n_formulas, round(overall, 4) AS overall, {S.level('overall')} AS level FROM o""")
def pair_quality_by_conversation(spark, d):
    """A1 over Q11-Q16."""
    x = P.document_quality(P.score_pairs(_pairs(spark, d)), "conv_id")
    return x.withColumns({c: F.round(c, 4) for c in ("completeness", "similarity", "formula_score", "overall")})


@query(f"WITH {_MATHS_SQL} SELECT conv_id, turn, round({S.completeness('original', 'translated')}, 4) AS completeness, round({S.similarity('original', 'translated')}, 4) AS similarity, round({S.formula_score('original', 'translated')}, 4) AS formula_score, len({S.formulas('original')})::INTEGER AS n_formulas FROM m")
def pair_scores(spark, d):
    """Q11, Q12, Q14, F17 of each pair with maths."""
    x = P.score_pairs(_maths(spark, d))
    return x.select("conv_id", "turn", *[F.round(c, 4).alias(c) for c in ("completeness", "similarity", "formula_score")], "n_formulas")


@query(f"""WITH {_MATHS_SQL}, c AS (SELECT *, {S.count('original', *R.PAIR_FORMULAS)} AS fo, {S.count('translated', *R.PAIR_FORMULAS)} AS ft,
  (contains(translated, '??'))::INT + {S.match('translated', R.PLACEHOLDER)}::INT AS critical FROM m)
SELECT conv_id, turn, fo::INTEGER AS formulas_original, ft::INTEGER AS formulas_translated, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - CASE WHEN fo > ft THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END - critical * 0.2::DOUBLE), 4) AS score FROM c""")
def pair_loss_score(spark, d):
    """A16, Q17, Q18."""
    o, t = F.col("original"), F.col("translated")
    return _maths(spark, d).select("conv_id", "turn", Q.formula_symbols(o).alias("formulas_original"), Q.formula_symbols(t).alias("formulas_translated"), F.round(Q.pair_loss(o, t), 4).alias("score"))


@query(f"""WITH {S.PAIRS}, c AS (SELECT *, length({S.strip('translated')}) / length({S.strip('original')})::DOUBLE AS r, {S.sentences('original')} AS so, {S.sentences('translated')} AS st, regexp_extract({S.strip('translated')}, '^([^\\n]*)', 1) AS line FROM pairs)
SELECT conv_id, turn, CASE WHEN {S.strip('translated')} = '' THEN 'empty' WHEN r < 0.7 THEN 'too short' WHEN r > 2.0 THEN 'too long' WHEN so > 0 AND st / so::DOUBLE < 0.85 THEN 'missing sentences' WHEN so > 0 AND st / so::DOUBLE > 1.3 THEN 'extra sentences'
  WHEN {' OR '.join(S.match('line', '(?i)' + p) for p in R.META_RESPONSES)} THEN 'meta response' ELSE 'ok' END AS verdict FROM c""")
def strict_gate(spark, d):
    """I28, Q20."""
    return _pairs(spark, d).select("conv_id", "turn", Q.gate(F.col("original"), F.col("translated")).alias("verdict"))


@query(f"""WITH {S.PAIRS}, c AS (SELECT *, lower(translated) AS low, list_filter(regexp_split_to_array(translated, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM pairs)
SELECT conv_id, turn, CASE WHEN {S.any_of('low', R.REFUSALS)} THEN 'refusal' WHEN len(w) > 10 AND len(list_distinct(w)) / len(w)::DOUBLE < 0.1 THEN 'repetitive' WHEN len(w) > 10 AND {S.any_of('low', R.LIGATURE_NOISE)} THEN 'ligatures'
  WHEN length(translated) < length(original) * 0.3 AND length(original) > 100 THEN 'short' ELSE 'ok' END AS verdict FROM c""")
def response_garbage_gate(spark, d):
    """Q25."""
    return _pairs(spark, d).select("conv_id", "turn", Q.garbage_gate(F.col("original"), F.col("translated")).alias("verdict"))


_TERMS = S.PAIRS + f", d AS (SELECT conv_id, turn, concat('Alpha Beta AB QED ', regexp_replace(original, '[^\\x00-\\x7F]', 'x', 'g')) AS original, CASE WHEN (conv_id + turn) % 4 < 2 THEN concat('Alpha Beta QED ', translated) ELSE concat('QED ', translated) END AS translated FROM pairs), u AS (SELECT conv_id, turn, translated, unnest({S.terms('original')}) AS term FROM d), k AS (SELECT conv_id, term, contains(translated, term) AS kept FROM u)"


def _termed(spark, d):
    return _pairs(spark, d).selectExpr("conv_id", "turn", "concat('Alpha Beta AB QED ', regexp_replace(original, '[^\\\\x00-\\\\x7F]', 'x')) AS original", "CASE WHEN (conv_id + turn) % 4 < 2 THEN concat('Alpha Beta QED ', translated) ELSE concat('QED ', translated) END AS translated")


@query(f"WITH {_TERMS}, g AS (SELECT conv_id, term, count(DISTINCT kept) > 1 AS mixed FROM k GROUP BY ALL) SELECT conv_id, count(*) AS terms, count(*) FILTER (mixed) AS inconsistent, round(100.0::DOUBLE * (1 - count(*) FILTER (mixed) / count(*)), 4) AS score FROM g GROUP BY conv_id")
def term_consistency_score(spark, d):
    """I30, A2."""
    return P.term_consistency(_termed(spark, d), "conv_id").withColumn("score", F.round("score", 4))


@query(f"WITH {_TERMS} SELECT term, count(*) AS uses, count(*) FILTER (kept) AS kept FROM k GROUP BY term HAVING count(*) FILTER (kept) BETWEEN 1 AND count(*) - 1")
def term_consistency_list(spark, d):
    """A2b."""
    return P.inconsistent_terms(_termed(spark, d))


@query(f"WITH {_TERMS}, b AS (SELECT lower(term) AS t FROM k GROUP BY term HAVING count(*) FILTER (kept) BETWEEN 1 AND count(*) - 1) SELECT conv_id, turn FROM d WHERE EXISTS (SELECT 1 FROM b WHERE contains(lower(d.original), b.t))")
def blocks_needing_refinement(spark, d):
    """J11, U8."""
    return P.needs_refinement(_termed(spark, d)).select("conv_id", "turn")


@query(f"""WITH {S.PAIRS}, c AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(original, '[.!?]+(?:\\s+|$)'), lambda s: {S.strip('s')} <> '') AS so, list_filter(regexp_split_to_array(translated, '[.!?]+(?:\\s+|$)'), lambda s: {S.strip('s')} <> '') AS st FROM pairs),
e AS (SELECT conv_id, turn, so, st, unnest(range(len(so)))::INTEGER AS idx FROM c WHERE len(so) = len(st)) SELECT conv_id, turn, idx, so[idx + 1] AS source, st[idx + 1] AS target FROM e""")
def term_acronym_alignment(spark, d):
    """J12, the sentences; acronym_mappings has the terms."""
    return P.aligned_sentences(_pairs(spark, d))


@query()
def acronym_mappings(spark, d):
    """J12, the acronyms that stay the same; rows only, a test compares with brute force."""
    return P.acronym_mappings(_pairs(spark, d))


@query("""WITH w AS (SELECT conv_id, turn, list({'o': turn, 'x': left(text, 200)}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(w, lambda s: CASE WHEN s.o = turn THEN '[CURRENT] ' ELSE '' END || s.x), E'\\n---\\n') AS context FROM w""")
def context_window(spark, d):
    """W1."""
    return P.context_window(_turns(spark, d), "conv_id", "turn")


@query(f"""WITH {S.PAIRS}, l AS (SELECT * FROM pairs WHERE length(original) > 20 AND length(translated) > 20), m AS (SELECT conv_id, turn, coalesce(list(left(original, 100) || ' => ' || left(translated, 100)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS m FROM l)
SELECT conv_id, turn, array_to_string(m[greatest(len(m) - 2, 1):], E'\\n') AS memory FROM m""")
def translation_memory(spark, d):
    """W2, W2b."""
    return P.translation_memory(_pairs(spark, d), "conv_id", "turn")


@query("SELECT conv_id, turn, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 400), '') AS context FROM conversations")
def tail_context(spark, d):
    """W3."""
    return P.tail_context(_turns(spark, d), "conv_id", "turn")


_LATEX = "CASE conv_id % 4 WHEN 0 THEN concat('\\\\begin{a}{', translated, '}\\\\end{a}') WHEN 1 THEN concat('{', translated, ' $x__LATEX_3__') WHEN 2 THEN concat(translated, ' ] \\\\ q') ELSE translated END"


@query()
def pair_issue_score(spark, d):
    """Q1-Q10, A3-A5; rows only: the stacks of braces and environments are folds."""
    x = _pairs(spark, d).select("conv_id", "turn", "original", F.expr(_LATEX).alias("translated"))
    return P.validate_documents(x, "conv_id")


@query()
def latex_findings(spark, d):
    """Q1-Q6: findings of each derived LaTeX text; rows only, as above."""
    x = _pairs(spark, d).select("conv_id", "turn", F.expr(_LATEX).alias("t"))
    return x.select("conv_id", "turn", F.explode(Q.latex_issues(F.col("t"))).alias("finding"))


@query(f"WITH {_MATHS_SQL} SELECT conv_id, turn, list_sort(list_distinct(list_filter(list_transform({S.formulas('original')}, lambda x: {S.no_blanks('x')}), lambda y: NOT list_contains(list_transform({S.formulas('translated')}, lambda x: {S.no_blanks('x')}), y)))) AS lost FROM m")
def lost_formulas(spark, d):
    """J17, X3."""
    return P.lost_formulas(_maths(spark, d)).select("conv_id", "turn", "lost")


@query(f"""WITH {_MATHS_SQL} SELECT conv_id, turn, list_filter([CASE WHEN contains(translated, '??') THEN 'double question mark' END, CASE WHEN {S.match('translated', R.INLINE_HTML)} THEN 'html' END,
  CASE WHEN {S.count('original', *R.PAIR_FORMULAS)} > 0 AND {S.count('translated', *R.PAIR_FORMULAS)} < {S.count('original', *R.PAIR_FORMULAS)} * 0.9::DOUBLE THEN 'formulas lost' END], lambda x: x IS NOT NULL) AS failed FROM m""")
def regression_findings(spark, d):
    """Q21, A20."""
    return _maths(spark, d).select("conv_id", "turn", Q.regression(F.col("original"), F.col("translated")).alias("failed"))


@query(f"""WITH {S.PAIRS} SELECT conv_id, sum(length(original))::BIGINT AS chars_original, sum(length(translated))::BIGINT AS chars_translated, sum({S.count('original', *R.PAIR_REFERENCES)})::BIGINT AS references_original, round(CASE WHEN sum(length(original)) = 0 THEN 0 ELSE sum(length(translated)) / sum(length(original))::DOUBLE END, 6) AS ratio,
  count(*) FILTER (len({S.tokens('translated')}) > 20 AND len(list_distinct({S.tokens('translated')})) / len({S.tokens('translated')})::DOUBLE < 0.15) AS repetitive FROM pairs GROUP BY conv_id""")
def document_totals(spark, d):
    """A17, A21, A16."""
    r = F.sum(F.length("translated")) / F.sum(F.length("original"))
    return _pairs(spark, d).groupBy("conv_id").agg(
        F.sum(F.length("original")).alias("chars_original"), F.sum(F.length("translated")).alias("chars_translated"), F.sum(Q.references(F.col("original"))).alias("references_original"),
        F.round(F.when(F.sum(F.length("original")) == 0, F.lit(0.0)).otherwise(r), 6).alias("ratio"), F.count_if(Q.repeats_itself(F.col("translated"))).alias("repetitive"),
    )


@query(f"WITH {S.PAIRS} SELECT conv_id, turn, round(CASE WHEN len(list_distinct({S.tokens('original')})) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({S.tokens('original')}), list_distinct({S.tokens('translated')}))) / len(list_distinct({S.tokens('original')}))::DOUBLE END, 6) AS overlap FROM pairs")
def back_translation_overlap(spark, d):
    """Q13b, X1."""
    return _pairs(spark, d).select("conv_id", "turn", F.round(Q.overlap(F.col("original"), F.col("translated")), 6).alias("overlap"))


@query(f"WITH {S.PAIRS} SELECT conv_id, turn, CASE WHEN length(original) = 0 OR length(translated) / length(original)::DOUBLE <= 1 THEN 12.0::DOUBLE ELSE round(greatest(12 / sqrt(length(translated) / length(original)::DOUBLE), greatest(6.0::DOUBLE, 0.7::DOUBLE * 12)), 6) END AS font_size FROM pairs")
def scaled_font_size(spark, d):
    """L15."""
    from leafwright.operators import layout as L

    return _pairs(spark, d).select("conv_id", "turn", F.round(L.scaled_font(F.lit(12.0), F.length("original"), F.length("translated")), 6).alias("font_size"))
