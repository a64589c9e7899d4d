"""Operators on small tables: state, layout, sources, sinks, hooks and streams."""

import json

import pandas as pd
from pyspark.sql import functions as F

from leafwright.operators import corpus, hooks, layout, pairs, state
from leafwright.sources import readers, sinks
from leafwright.streaming import progress


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_cache(spark):
    c = frame(spark, "cache_key string, translated string, language string, created_at double, accessed_at double, access_count long", *[(f"k{i}", "x", "de", float(i), float(i), 2) for i in range(10)])
    assert {r.cache_key for r in state.evict(c).collect()} == {f"k{i}" for i in range(2, 10)}
    assert state.live(c, F.lit(100.0), 95).count() == 5
    assert state.cache_stats(c).first().hit_rate == 0.5
    assert state.clear(c, "de").count() == 0 and state.clear(c).count() == 0
    new = c.where("cache_key = 'k1'").withColumn("translated", F.lit("y"))
    r = state.upsert(c, new).where("cache_key = 'k1'").first()
    assert (r.translated, r.access_count) == ("y", 1)


def test_anchored_clusters_are_not_gaps(spark):
    b = frame(spark, "page long, block long, y double", *[(1, i, y) for i, y in enumerate([0.0, 6.0, 12.0, 18.0, 40.0])])
    got = [r.cluster for r in layout.anchored_clusters(b, "y", 8.0).orderBy("y").collect()]
    assert got == [0, 0, 1, 1, 2]


def test_captions_are_exclusive(spark):
    c = frame(spark, "page long, block long, x double, y double, width double, height double", (1, 1, 0.0, 110.0, 50.0, 10.0), (1, 2, 0.0, 125.0, 50.0, 10.0))
    i = frame(spark, "page long, image long, x double, y double, width double, height double", (1, 7, 0.0, 0.0, 50.0, 100.0), (1, 8, 400.0, 0.0, 50.0, 100.0))
    got = {r.image: r.block for r in layout.anchor_captions(c, i).collect()}
    assert got == {7: 1, 8: 2}


def test_table_detection(spark):
    b = frame(spark, "page long, block long, x double, y double, font_size double, is_bold boolean", *[(1, 3 * r + c, 100.0 * c, 20.0 * r, 10.0, r == 0) for r in range(3) for c in range(3)])
    t = layout.detect_tables(b).orderBy("start_row").first()
    assert (t.rows, t.cols, t.has_header, t.confidence) == (3, 3, True, 1.0)


def test_sources(spark, tmp_path):
    (tmp_path / "a.log").write_text("t | ERROR | m | bad | worse\nshort\n")
    assert [tuple(r) for r in readers.log_lines(spark, str(tmp_path / "a.log")).collect()] == [("t", "ERROR", "m", "bad | worse")]
    (tmp_path / "g").mkdir()
    (tmp_path / "g/x.json").write_text(json.dumps({"domain": "d", "target_language": "de", "terms": {"wave": "Welle"}}))
    assert readers.glossary(spark, str(tmp_path / "g")).first().translation == "Welle"
    (tmp_path / "p").mkdir()
    (tmp_path / "p/1.json").write_text(json.dumps({"job_id": "a", "phase": "translating", "ts": 1.0}))
    (tmp_path / "p/2.json").write_text("{broken")
    assert [r.job_id for r in readers.checkpoints(spark, str(tmp_path / "p")).collect()] == ["a"]
    (tmp_path / "f.pdf").write_bytes(b"one")

    def extractor(path, content):
        if content == b"bad":
            raise ValueError("unreadable")
        yield {"page": 0, "block": 0, "text": content.decode()}

    (tmp_path / "e.pdf").write_bytes(b"bad")
    got = {r.text: r.raw_text for r in readers.extract(readers.documents(spark, str(tmp_path)), extractor).collect()}
    assert got == {"one": None, None: "error: unreadable"}
    pages = frame(spark, "doc_id long, page int, text string", (1, 0, "1.\n\n─\n\nTable 1\tx\n\n  "))
    assert [r.content for r in readers.block_rows(pages).orderBy("block_idx").collect()] == ["1.", "Table 1\tx"]


def test_sinks(spark):
    b = frame(spark, "doc_id long, block_idx int, content string, element_type string", (1, 1, "5% x", "text"), (1, 0, "Head", "heading"))
    tex = sinks.latex_documents(b, "German").first().latex
    assert tex.index("\\section*{Head}") < tex.index("5\\% x") and "[ngerman]" in tex
    assert "\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}" in spark.range(1).select(sinks.markdown_latex(F.lit("# T\n- a\n- b\n"))).first()[0]
    r = frame(spark, "paragraph long, run int, text string, translated string", (1, 0, "aa", "wxyz!"), (1, 1, "bb", "wxyz!"))
    assert "".join(x.new_text for x in sinks.spread_over_runs(r).orderBy("run").collect()) == "wxyz!"


def test_hooks(spark):
    calls = frame(spark, "id long, t string", (1, "ok"), (2, "timeout"), (3, "odd"))

    def f(x):
        if x != "ok":
            raise RuntimeError(x)
        return x.upper()

    got = {r.id: (r.answer, r.attempts) for r in hooks.call(calls, "t", f).collect()}
    assert got == {1: ("OK", 1), 2: (None, 3), 3: (None, 1)}
    items = frame(spark, "i array<string>, a string", (["one", "two long words"], "[1] eins\n[2] x"))
    assert items.select(hooks.numbered_answers(F.col("a"), F.col("i")).alias("r")).first().r == ["eins", "two long words"]
    a = frame(spark, "k long, original string, answer string, attempt int", (1, "0123456789", "012345", 1), (1, "0123456789", "0", 2))
    assert hooks.best_attempt(a, "k").first().text == "012345"


def test_once_each(spark):
    r = frame(spark, "id long, text string", (1, "Same "), (2, "same"), (3, "other"))
    got = state.once_each(r, lambda d: d.withColumn("answer", F.upper("text")), F.lower(F.trim("text")))
    assert got.count() == 3 and got.select("cache_key").distinct().count() == 2


def test_consistency(spark):
    p = frame(spark, "conv_id long, turn long, original string, translated string", (1, 1, "The QED is", "QED"), (1, 2, "On QED", "x"))
    assert [(r.terms, r.inconsistent) for r in pairs.term_consistency(p, "conv_id").collect()] == [(1, 1)]
    assert pairs.needs_refinement(p).count() == 2


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = progress.read_events(spark, str(tmp_path / "in"), events.schema)
    q = progress.rates(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r.start, r.event_type, r.pages) for r in d.collect())
    assert key(spark.table("rates")) == key(progress.rates(events))


def test_streamed_upsert_is_repeatable(spark, tmp_path):
    sink = progress.upsert_sink(str(tmp_path / "cache"))
    b = frame(spark, "cache_key string, translated string, created_at double", ("a", "1", 1.0))
    sink(b, 0)
    for _ in range(2):
        sink(b.withColumns({"translated": F.lit("2"), "created_at": F.lit(2.0)}), 1)
    assert [r.translated for r in spark.read.parquet(str(tmp_path / "cache/v=1")).collect()] == ["2"]


def test_defaults(spark):
    x = layout.with_defaults(spark.createDataFrame(pd.DataFrame([{"x": 1.0, "y": 2.0}])).withColumns({"width": F.lit(None).cast("double"), "height": F.lit(None).cast("double"), "font_size": F.lit(None).cast("double")})).first()
    assert (x.x1, x.y1, x.font_size) == (101.0, 22.0, 10.0)


def test_best_match(spark):
    b = frame(spark, "block_id long, text string", (1, "a b c d"), (2, "z"))
    p = frame(spark, "para_id long, text string", (5, "a b c"), (4, "a b c"))
    assert [(r.block_id, r.para_id, r.score) for r in corpus.best_match(b, p).collect()] == [(1, 4, 0.75)]


def test_whole_job_queue(spark):
    rows = [(i, (i * 7) % 4, ("pending", "running", "failed")[i % 3]) for i in range(900)]
    jobs = spark.createDataFrame(rows, "seq long, priority int, status string").repartition(5)
    got = [(r.seq, r["rank"]) for r in state.ranked_queue(state.resumable(jobs)).collect()]
    want = sorted((r for r in rows if r[2] != "failed"), key=lambda r: (-r[1], r[0]))
    assert sorted(got, key=lambda r: r[1]) == [(r[0], k) for k, r in enumerate(want, 1)]
    assert state.ranked_queue(state.resumable(jobs.where("false"))).count() == 0


def test_corruption_places(spark):
    texts = {1: "a [G_abcd12_0] b", 2: "3 ? 4", 3: "so\u00adft", 4: "ze\u200bro\ufeff", 5: "99?5 2?³ ESO?Xa", 6: "?F_abcdef_1? a�b", 7: None, 8: "clean.", 9: "x" * 30 + "\u00ad" + "y" * 30}
    got = {(r.doc_id, r.kind, r.start, r.end, r.original, r.context) for r in corpus.corruption_places(frame(spark, "doc_id int, text string", *texts.items())).collect()}
    near = lambda t, a, b: t[max(0, a - 20) : b + 20]
    want = [
        (1, "font_glyph_bracket", 2, 14), (2, "broken_range", 1, 4), (3, "soft_hyphen", 2, 3), (4, "zero_width", 2, 3), (4, "zero_width", 5, 6), (5, "question_in_number", 2, 3), (5, "broken_range", 2, 3),
        (5, "question_in_number", 6, 7), (5, "question_compound", 12, 13), (5, "question", 11, 14), (6, "font_glyph", 0, 12), (6, "glyph", 0, 12), (6, "replacement_char", 14, 15), (6, "replacement", 14, 15),
        (9, "soft_hyphen", 30, 31),
    ]
    assert got == {(i, k, a, b, texts[i][a:b], near(texts[i], a, b)) for i, k, a, b in want}


def test_acronym_mappings(spark):
    rows = [(1, 1, "NASA flew. The ESA-X saw DNA.", "NASA flog. ESA sah DNA."), (1, 2, "NASA flew. More.", "NASA flog."), (1, 3, "We saw GPS. Later GPS.", "Wir. Dann GPS."), (1, 4, "CO2 and Dna, no caps", "CO2 und"), (1, 5, None, "x")]
    got = pairs.acronym_mappings(frame(spark, "conv_id int, turn int, original string, translated string", *rows)).collect()
    assert sorted((r.turn, r.term, r.translation) for r in got) == [(1, "DNA", "DNA"), (1, "ESA", "ESA"), (1, "NASA", "NASA"), (4, "CO2", "CO2")]


def test_quality_report_rounds_as_printf(spark):
    values = [(99.0625, 92.3625, 62.1025), (0.0, 100.0, 0.0005), (14.5895, 38.2955, 99.3125), (None, 1.0, 1.0)]
    rows = [(i, *v, "good") for i, v in enumerate(values)]
    got = {r.k: r.report for r in corpus.quality_report(frame(spark, "k int, overall double, formula_score double, completeness double, level string", *rows), "k").collect()}
    text = "# Quality\n\n| score | value |\n|---|---|\n| overall | %.3f |\n| formulas | %.3f |\n| completeness | %.3f |\n\nLevel: good"
    assert got == {i: text % v if None not in v else None for i, v in enumerate(values)}
