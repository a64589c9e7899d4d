"""Writers and text renderings: K1-K3, K6, K8-K12, K15, K17. Binary rendering is out of scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions import rules as R
from leafwright.functions import text as T


def in_order(parts: DataFrame, key: str, order: str, text: str = "text", glue: str = "\n\n") -> DataFrame:
    """A key's texts in order, empty ones left out."""
    x = parts.where(F.col(text) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("p"))
    return x.select(key, F.array_join(F.transform("p", lambda s: s["t"]), glue).alias("text"))


def latex_block(content: Column, element_type: Column) -> Column:
    """K2: a block in the environment of its type."""
    return (
        F.when(element_type == "heading", F.concat(F.lit("\\section*{"), content, F.lit("}")))
        .when(element_type == "formula", F.concat(F.lit("\\[\n"), content, F.lit("\n\\]")))
        .when(element_type == "table", F.concat(F.lit("\\begin{verbatim}\n"), content, F.lit("\n\\end{verbatim}")))
        .when(element_type == "caption", F.concat(F.lit("\\emph{"), T.escape_latex(content), F.lit("}")))
        .otherwise(T.escape_latex(content))
    )


def latex_documents(blocks: DataFrame, language: str) -> DataFrame:
    """K2, K3: main.tex of each document from its blocks (doc_id, block_idx, content, element_type)."""
    body = in_order(blocks.select("doc_id", "block_idx", latex_block(F.col("content"), F.col("element_type")).alias("text")), "doc_id", "block_idx")
    head = F.concat(F.lit("\\documentclass{article}\n\\usepackage["), T.babel_option(F.lit(language)), F.lit("]{babel}\n\\begin{document}\n"))
    return body.select("doc_id", F.concat(head, "text", F.lit("\n\\end{document}\n")).alias("latex"))


def figure_latex(image: Column, caption: Column) -> Column:
    """A figure without the caption's own prefix."""
    text = F.regexp_replace(caption, r"(?i)^(Figure|Fig\.|Abbildung|Abb\.)\s*[0-9]+\s*[:.]?\s*", "")
    return F.concat(F.lit("\\begin{figure}\n\\includegraphics{"), image, F.lit("}\n"), F.when(caption.isNotNull(), F.concat(F.lit("\\caption{"), T.escape_latex(text, skip_backslash=True), F.lit("}\n"))).otherwise(F.lit("")), F.lit("\\end{figure}"))


def repair_report(actions: DataFrame, key: str) -> DataFrame:
    """K8: a document's repairs (rule, original, fixed) as Markdown, 30 characters each, by rule."""
    cut = lambda c: F.substring(c, 1, 30)
    g = actions.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat(F.lit("- "), "rule", F.lit(": `"), cut(F.col("original")), F.lit("` → `"), cut(F.col("fixed")), F.lit("`")))).alias("a"))
    return g.select(key, F.concat(F.lit("# Repairs\n\nTotal: "), F.col("n").cast("string"), F.lit("\n\n"), F.array_join("a", "\n")).alias("report"))


def batch_report(summary: DataFrame) -> DataFrame:
    """K9: a batch summary as Markdown."""
    return summary.select("*", F.format_string("# Batch\n\n- total: %d\n- completed: %d\n- failed: %d\n- success: %.1f %%\n- quality: %.1f", "total", "completed", "failed", "success_rate", "avg_quality").alias("report"))


def write_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines; Spark commits whole files."""
    df.write.mode("overwrite").json(path)


def checkpoint_json(states: DataFrame) -> DataFrame:
    """A state as JSON, with texts cut to 500 characters."""
    blocks = F.transform("blocks", lambda b: F.struct(b["block"].alias("block"), F.substring(b["text"], 1, 500).alias("text"), b["complete"].alias("complete")))
    return states.select("job_id", F.to_json(F.struct("job_id", "phase", blocks.alias("blocks"))).alias("json"))


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    """A text file for each value of key."""
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def markdown_latex(c: Column) -> Column:
    """Headers, bold, italics, list items and Greek letters to LaTeX; consecutive items share a list."""
    heads = [(rf"(?m)^{'#' * n} (.+)$", rf"\\{name}{{$1}}") for n, name in ((3, "subsubsection"), (2, "subsection"), (1, "section"))]
    x = T.chain(c, heads + [(r"\*\*([^*]+)\*\*", r"\\textbf{$1}"), (r"\*([^*\n]+)\*", r"\\textit{$1}")])
    x = T.chain(x, [(r"(?m)((?:^- .+\n?)+)", "\\\\begin{itemize}\n$1\\\\end{itemize}\n"), (r"(?m)^- (.+)$", r"\\item $1")])
    return T.replace_all(x, {g: f"$\\{n}$" for n, g in R.GREEK_NAMES.items() if n != "omicron"})


def spread_over_runs(runs: DataFrame, key: str = "paragraph") -> DataFrame:
    """A translated text over the runs of its paragraph, in proportion to their lengths; the last gets the rest."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    o = w.orderBy("run")
    share = F.floor(F.length("translated") * F.length("text") / F.greatest(F.sum(F.length("text")).over(w), F.lit(1)))
    x = runs.withColumn("_n", share)
    x = x.withColumns({"_a": F.coalesce(F.sum("_n").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_last": F.lead("run").over(o).isNull()})
    piece = F.when(F.col("_last"), F.substr("translated", F.col("_a") + 1)).otherwise(F.substr("translated", F.col("_a") + 1, F.col("_n")))
    return x.withColumn("new_text", piece).drop("_n", "_a", "_last")
