"""External models as injected hooks, with retries and fallbacks inside the hook stage: U1-U8, T8, T10, T11, M13.

No model ships with this package; the default translator is the dictionary of operators.corpus. A hook is a plain function of
a text that the workers call; its failures become rows, never task failures.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.functions import quality as Q

#: Own short prompts by kind of block.
PROMPTS = {"text": "Translate into %s. Keep every mark of the form ⟦…⟧ as it is.\n\n%s", "heading": "Translate this heading into %s, without a full stop.\n\n%s", "caption": "Translate this caption into %s; keep its number.\n\n%s", "table": "Translate the words of this table into %s; keep numbers and columns.\n\n%s", "abstract": "Translate this abstract into %s in a formal register.\n\n%s"}
_HOOKS: dict[str, Callable[[str], str]] = {}


def register(name: str, f: Callable[[str], str]) -> None:
    """Make a hook known by name."""
    _HOOKS[name] = f


def hook(name: str) -> Callable[[str], str]:
    return _HOOKS[name]


def prompt(kind: Column, language: str, text: Column) -> Column:
    """The prompt of a block's kind; text's where the kind has none."""
    c = None
    for k, p in PROMPTS.items():
        v = F.format_string(p, F.lit(language), text)
        c = F.when(kind == k, v) if c is None else c.when(kind == k, v)
    return c.otherwise(F.format_string(PROMPTS["text"], F.lit(language), text))


def call(df: DataFrame, text: str, f: Callable[[str], str], attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """F over a column: adds answer, error and attempts; errors that retrying cannot help end at once."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from leafwright.functions import rules as R

    schema = StructType(df.schema.fields + [StructField("answer", StringType()), StructField("error", StringType()), StructField("attempts", LongType())])

    def retryable(message: str) -> bool:
        return next((retry for _, retry, words in R.ERROR_CLASSES if any(w in message.lower() for w in words)), False)

    def one(x):
        for n in range(1, attempts + 1):
            try:
                return (None if x is None else f(x)), None, n
            except Exception as e:  # the hook's failure is data
                message = f"{type(e).__name__}: {e}"
                if n == attempts or not retryable(message):
                    return None, message, n
                time.sleep(min(60.0, pause * 2**n))

    def run(batches):
        for pdf in batches:
            got = [one(x) for x in pdf[text]]
            yield pdf.assign(answer=[g[0] for g in got], error=[g[1] for g in got], attempts=[g[2] for g in got])

    return df.mapInPandas(run, schema)


def best_attempt(attempts: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Of a block's attempts (original, answer, attempt) the first that passes the gate, else the longest of half the
    original's length or more, else the original."""
    x = attempts.withColumn("_ok", Q.gate(F.col("original"), F.col("answer")) == "ok").withColumn("_r", F.length("answer") / F.length("original"))
    w = Window.partitionBy(key).orderBy(F.col("_ok").desc(), F.when(F.col("_ok"), F.col("attempt")), F.col("_r").desc(), "attempt")
    one = x.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return one.select(key, F.when(F.col("_ok") | (F.col("_r") >= least), F.col("answer")).otherwise(F.col("original")).alias("text"), F.col("_ok").alias("passed"))


def two_pass(pairs: DataFrame, refine: Callable[[Column, Column], Column]) -> DataFrame:
    """U8: the second pass over pairs with inconsistent terms; the others stay."""
    from .pairs import needs_refinement

    chosen = needs_refinement(pairs).select("conv_id", "turn", F.lit(True).alias("_r"))
    x = pairs.join(chosen, ["conv_id", "turn"], "left").withColumn("refined", F.coalesce("_r", F.lit(False)))
    return x.withColumn("translated", F.when(F.col("refined"), refine(F.col("original"), F.col("translated"))).otherwise(F.col("translated"))).drop("_r")


def numbered_batch(items: Column) -> Column:
    """Several short texts as one request of [n] lines."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")


def numbered_answers(answer: Column, items: Column, share: float = 0.3) -> Column:
    """The answers of a batch by number; an item keeps its text where its answer is missing or under 30 % of its length."""
    body = lambda n: F.call_function("regexp_extract", answer, F.concat(F.lit(r"(?ms)^\["), n, F.lit(r"\][ ]?(.*?)(?=^\[\d+\]|\z)")), F.lit(1))
    got = F.map_from_entries(F.transform(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"(?m)^\[(\d+)\]"), 1)), lambda n: F.struct(n.cast("int").alias("k"), body(n).alias("v"))))
    clean = lambda c: F.regexp_replace(c, r"\s+\z", "")
    return F.transform(items, lambda x, i: F.coalesce(F.when(F.length(clean(got[i + 1])) >= F.length(x) * share, clean(got[i + 1])), x))


def ocr_confidence(text: Column) -> Column:
    """struct(latex, confidence): one outer pair of dollar signs goes; .8 for over two characters, else .3."""
    x = F.regexp_replace(F.trim(text), r"\A\$(.*)\$\z", "$1")
    return F.struct(x.alias("latex"), F.when(F.length(x) > 2, 0.8).otherwise(0.3).alias("confidence"))
