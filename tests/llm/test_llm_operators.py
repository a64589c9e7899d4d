"""The operators against brute force, exact round trips and held-out accuracy, with nulls, empty and repeated rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from leafwright.llm import bpe, common, components, fingerprints, media, mixing, near_dedup, quality, token_counts, token_files, toxicity, warc
from leafwright.llm.queries import MULTI, pattern

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hi string, size string"
WORDS = [f"w{i}" for i in range(400)]
BASE = " ".join(WORDS[:60])
ODD = [
    (1, BASE), (2, BASE), (3, BASE.upper()), (4, BASE.replace("w7 ", "x ")), (5, " ".join(WORDS[60:120])), (6, None), (7, ""), (8, " \n\t "), (9, "one"), (10, "One"), (11, "a b"),
    (12, "é ß 👍 中文 " * 5), (13, " ".join(WORDS) * 60), (13, " ".join(WORDS) * 60), (14, "x" * 3000), (None, "no id"), (None, None), (15, "a\x1cb \x85 c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if (i or 0) % 4 == 0 else f"s{(i or 0) % 3}", 0, "clash", "clash") for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def spark_hash(text):
    """xxhash64 of Spark: seed 42, signed."""
    return np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64).item()


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    k = min(width, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, odd, none, sf_dir, width):
    assert near_dedup.near_duplicates(none, width).count() == 0
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        sets = {i: shingle_set(t, width) for i, t in rows if i is not None}
        parent = {i: i for i in sets}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in itertools.combinations(sorted(sets), 2):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
        got = near_dedup.near_duplicates(docs, width).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and not r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id)


def test_prefix_join_finds_what_stars_miss(spark):
    """A chain: each text resembles its neighbours only, so no star round one least text links it."""
    rows = [(i, " ".join(WORDS[5 * i : 5 * i + 100])) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.component_id for r in near_dedup.near_duplicates(d, 2).collect()}
    assert got == {0}


def test_repeated_ids_with_unlike_texts(spark):
    """One component an id; where texts stand for themselves, no group is lost under an id that another group has."""
    one, two = " ".join(WORDS[:60]), " ".join(WORDS[100:200])
    d = spark.createDataFrame([(1, one), (5, one), (5, two), (9, two + " end"), (7, ""), (5, "")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(d, 2).collect()}
    assert got == {(1, 1, True), (5, 1, False), (9, 1, False), (7, 7, True)}
    left = sorted((r.doc_id, r.text) for r in near_dedup.distinct_documents(d, 2).collect())
    assert left == [(1, one), (5, ""), (5, two), (7, "")]


def test_quality(spark, odd, none, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, quality.grades(labels))
    assert list(model.thresholds) == sorted(model.thresholds) and model.grades == 3
    got = quality.score(docs, model).join(labels, "doc_id").where("held_out")
    assert got.where((F.col("quality") == 1) == F.col("selected")).count() >= 0.9 * got.count()
    assert quality.score(odd, model).count() == len(ODD) and quality.score(none, model).count() == 0
    empty = quality.fit(docs, quality.grades(labels.limit(0)))
    assert quality.score(odd, empty).where("selected").count() == len(ODD)
    assert quality.select(docs, model).count() == quality.score(docs, model).where("selected").count()


def test_ordinal_grades():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    z = x @ np.array([1, -2, 0.5, 0, 1], np.float32) + rng.logistic(size=600) * 0.3
    y = np.digitize(z, [-2, -0.5, 0.5, 2])
    m = quality.train(x, y)
    p = m.tails(x)
    assert (np.diff(m.thresholds) > 0).all() and (np.diff(p, axis=1) <= 1e-9).all()
    assert np.corrcoef(p.sum(1), y)[0, 1] > 0.9


def test_toxicity(spark, odd, none):
    rows = [(i, " ".join(np.random.default_rng(i).choice(WORDS, 80)) + (" you scumbag loser, vile wretch " * 3 if i % 3 == 0 else ""), i % 3 == 0) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd, model).where("score between 0 and 1").count() == len(ODD) and toxicity.score(none, model).count() == 0
    one_kind = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(odd, one_kind).where("predicted = 0").count() == len(ODD)


def test_fits_send_the_driver_only_models(spark, sf_dir, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    sizes, collect = [], type(docs).collect

    def weighed(df):
        got = collect(df)
        sizes.append(sum(len(x) for r in got for x in r if isinstance(x, str | bytes | bytearray)))
        return got

    with monkeypatch.context() as m:
        m.setattr(type(docs), "collect", weighed)
        q, t = quality.fit(docs, quality.grades(labels)), toxicity.fit(docs, labels)
    assert sizes and max(sizes) < toxicity.ORDINARY_BYTES + toxicity.TOXIC_BYTES + 1000
    by_id = lambda x: sorted(x.collect(), key=lambda r: r.doc_id)
    rated, known = by_id(common.labelled_sample(docs, quality.grades(labels).where("grade is not null"), ["grade"], quality.SAMPLE)), by_id(common.labelled_sample(docs, labels, ["toxic"], toxicity.SAMPLE))
    want = quality.train(quality.features(pa.array([r.text for r in rated])), np.asarray([r.grade for r in rated]))
    assert q.grades == want.grades and np.allclose(q.weights, want.weights, atol=1e-3) and np.allclose(q.thresholds, want.thresholds, atol=1e-3)
    want = toxicity.train([r.text for r in known], [int(r.toxic or 0) for r in known])
    assert (t.ordinary, t.toxic) == (want.ordinary, want.toxic) and np.allclose(t.weights, want.weights) and np.allclose(t.mean, want.mean)


def test_toxicity_learns_from_all_labelled_texts(monkeypatch):
    rng = np.random.default_rng(7)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    texts = [text(60) for _ in range(1500)] + [text(2000) + " lastwords" for _ in range(5)] + [text(60) + " you scumbag loser" + " zorblattian" * (i < 8) for i in range(450)]
    toxic, seen = [0] * 1505 + [1] * 450, {}
    kept, dictionary = toxicity.Model.distances, toxicity._dictionary
    monkeypatch.setattr(toxicity.Model, "distances", lambda m, t: seen.setdefault("calibrated", t) and kept(m, t))
    monkeypatch.setattr(toxicity, "_dictionary", lambda s, *a: seen.setdefault(len(a), s) and dictionary(s, *a))
    model = toxicity.train(texts, toxic)
    assert sorted(seen["calibrated"]) == sorted(t.encode() for t in texts)
    assert b"".join(seen[1]) == b"".join(t.encode() for t, y in zip(texts, toxic) if not y)
    assert sum(b"zorblattian" in s for s in toxicity._segments([t.encode() for t, y in zip(texts, toxic) if y], [t.encode() for t, y in zip(texts, toxic) if not y])) > 0
    assert abs(model.score([t.encode() for t in texts]).mean() - 450 / 1955) < 0.02


def _tiktoken(name):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(common.tokenizer_file(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, odd, none, sf_dir):
    enc, path = _tiktoken(MULTI), common.tokenizer_file(MULTI)
    assert bpe.encode(none, path, pattern()).count() == 0
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    want = sorted((r.doc_id or -1, hashlib.sha256((r.text or "").encode()).hexdigest(), enc.encode_ordinary(r.text or "")) for r in docs.collect())
    got = sorted((r.doc_id or -1, r.decoded_sha256, r.ids) for r in bpe.encode(docs, path, pattern()).collect())
    assert got == want


def test_long_words():
    b, enc = bpe.Bpe(common.tokenizer_file(MULTI), pattern()), _tiktoken(MULTI)
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeé"), n)) for n in (5, 95, 96, 97, 98, 1000)] + ["a" * 500]
    got = [np.frombuffer(x[0], "<u4").tolist() for x in b.encode(pa.array(words))]
    assert got == [enc.encode_ordinary(w) for w in words]


def test_component_tables_have_few_files(spark, tmp_path):
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = components.connected(spark.range(1, 400).selectExpr("id AS a", "id - id % 10 AS b"), f"file://{tmp_path}")
        assert {(r.id, r.component) for r in got.collect()} == {(i, i - i % 10) for i in range(400)}
        tables = [len(list(t.glob("part-*"))) for t in tmp_path.iterdir()]
        assert tables and max(tables) <= spark.sparkContext.defaultParallelism < 40
        assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_executors_give_back_heap(spark):
    beans = lambda: sum(b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    alone = beans()
    spark.sparkContext._jvm.System.gc()
    one = beans() - alone
    start = beans()
    common.release(spark)  # here driver and executor are one JVM: it collects for both
    assert beans() - start > one


def test_short_words_need_no_keyed_recursion(monkeypatch):
    b, enc = bpe.Bpe(common.tokenizer_file(MULTI), pattern()), _tiktoken(MULTI)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list(letters), n)) for letters in ("ab", "etaoinsr", "abcdeéñ中") for n in range(1, bpe.SHORT + 1) for _ in range(9)]
    words = [w for w in words if len(w.encode()) <= bpe.SHORT] + ["a" * n for n in range(1, bpe.SHORT + 1)]
    with monkeypatch.context() as m:
        m.setattr(bpe, "_STEP", None)
        got = b.encode_words([w.encode() for w in words])
    assert [np.frombuffer(x[0], "<u4").tolist() for x in got] == [enc.encode_ordinary(w) for w in words]
    assert [x[1].decode() for x in got] == words
    both = [w.encode() for w in ["b" * (bpe.SHORT + 1), *words[:40], "", "ab" * bpe.SHORT]]
    assert [np.frombuffer(x[0], "<u4").tolist() for x in b.encode_words(both)] == [enc.encode_ordinary(w.decode()) for w in both]


def test_bpe_encodes_a_chunk_once_in_a_worker():
    b = bpe.Bpe(common.tokenizer_file(MULTI), pattern())
    keys = [b" w%d" % i for i in range(400_000)]
    assert b.cache.look_up(keys[:50]) == [np.asarray(_tiktoken(MULTI).encode_ordinary(k.decode()), "<u4").tobytes() for k in keys[:50]]
    calls, b.cache.encode = [], lambda new: calls.append(len(new)) or [b""] * len(new)
    for _ in range(2):
        for i in range(0, len(keys), 8000):
            b.cache.look_up(keys[i : i + 8000])
    assert sum(calls) == len(keys) - 50


def test_decoded_bytes_come_from_the_ids(monkeypatch):
    b = bpe.Bpe(common.tokenizer_file(MULTI), pattern())
    real = b.encode_words
    monkeypatch.setattr(b, "encode_words", lambda words: [(ids, raw.replace(b"cat", b"dog")) for ids, raw in real(words)])
    assert [x[1] for x in b.encode(pa.array(["a cat, a cat", "b", None]))] == [b"a dog, a dog", b"b", b""]


def test_length_histogram(spark, odd, none):
    enc = _tiktoken("byte_bpe_50k.tiktoken")
    n = [len(enc.encode_ordinary(t or "")) for _, t in ODD]
    path = common.tokenizer_file("byte_bpe_50k.tiktoken")
    h = token_counts.histogram(token_counts.lengths(odd, path, pattern())).cache()
    for r in h.collect():
        at = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.tokens_truncated) == (n.count(at), sum(x >= at for x in n), sum(x for x in n if x >= at), sum(min(x, at) for x in n))
        assert r.quantile == pytest.approx(sum(x <= at for x in n) / len(n))
    assert token_counts.truncated_total(h, 7).first().tokens == sum(min(x, 7) for x in n)
    assert token_counts.quantile(h, 0.5).first().n_tokens == sorted(n)[-(-len(n) // 2) - 1]
    assert token_counts.histogram(token_counts.lengths(none, path, pattern())).count() == 0


def test_fingerprints(spark, odd, none):
    rows = sorted(((i is not None, i or 0, spark_hash(t or ""), t or "") for i, t in ODD))
    a, b = fingerprints._functions()

    def phrases(text):
        seen, w = set(), ""
        for c in text:
            w += c
            if w not in seen:
                seen.add(w)
                w = ""
        return seen

    want = []
    for k, (has, i, _, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][3]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        s, u, v = (fingerprints.signature(phrases(x), a, b) for x in (t, e, nxt))
        want.append((i if has else -1, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints._hex(s), fingerprints._hex(u), fingerprints.likeness(s, u), fingerprints.likeness(s, v)))
    for each in (1000, 1, 5):
        got = [(-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in fingerprints.compare(odd, rows_each=each).collect()]
        assert sorted(got) == sorted(want)
    assert fingerprints.compare(none).count() == 0


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        p = mixing.permute(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n)) and (mixing.permute(p, n, 7, back=True) == np.arange(n)).all()
    assert (mixing.permute(np.arange(1000), 1000, 7) != np.arange(1000)).mean() > 0.9


def test_mix(spark, odd, none, sf_dir):
    assert mixing.taken(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = mixing.taken(docs).collect()
        assert len(got) == docs.count() and all(r.taken <= 2 * r.size for r in got)
        by = {}
        for r in got:
            s = by.setdefault((r.source_size, r.target), [0, 0])
            s[0] += r.size
            s[1] += r.taken
        assert all(abs(t - k) <= 1 for (_, t), (_, k) in by.items())
        total = sum(r.size for r in got)
        assert sum(s[1] for s in by.values()) == pytest.approx(1.5 * total, abs=len(by) + 1)
        again = sorted((repr(r) for r in mixing.taken(docs).collect()))
        assert again == sorted(map(repr, got))
        m = mixing.mixed_documents(docs)
        assert m.schema == docs.schema and m.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(r.taken for r in got)


def test_targets():
    t = mixing.targets([("b", 100), ("a", 10), (None, 50)])
    assert t["a"] == 20.0 and t["b"] + t[None] == pytest.approx(220.0) and t["b"] == pytest.approx(220 * 2 / 3)


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = common.tokenizer_file("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    docs = odd.union(spark.createDataFrame([(20, "a <|endoftext|> b <|endof", "", "", 0, "", "")], SCHEMA))
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, spark_hash(r.text or ""), r.text or "") for r in docs.collect()))
    want, at = [], 0
    for has, i, _, t in rows:
        ids = np.asarray([*tk.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i if has else -1, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    manifest = token_files.write(docs, path, f"file://{tmp_path}/w", shard_tokens=500)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(manifest).collect())
    assert got == sorted(want) and manifest.count() > 1
    assert token_files.read(token_files.write(none, path, f"file://{tmp_path}/n")).count() == 0


def test_wavelet():
    ids = np.random.default_rng(3).integers(0, 60, 2000) * 2000
    w, docs, starts = token_files.Wavelet.from_bytes(token_files.Wavelet.build(ids, 17).to_bytes([5], [0]))
    assert (w.all() == ids).all() and (docs, starts) == ([5], [0])
    for i in range(0, 2000, 97):
        v = int(ids[i])
        assert w.access(i) == v and w.rank(v, i) == (ids[:i] == v).sum() and w.select(v, 1) == np.flatnonzero(ids == v)[1]
    assert w.count(1) == 0 and w.select(1, 0) == -1 and ids.max() > 65535
    with pytest.raises(ValueError):
        token_files.Wavelet.build(ids, 16)


def test_warc(spark, tmp_path):
    long_ = "<p>é</p>" * 20
    assert [x for x in warc.members(b"".join(warc.record(i, "u", b"x" * (i * 999), None) for i in range(40)), 512)] == [zlib.decompress(warc.record(i, "u", b"x" * (i * 999), None), 31) for i in range(40)]
    with pytest.raises(ValueError):
        list(warc.records(warc.record(1, "u", b"x" * 99, None)[:-4]))
    pages = [(3, "http://a\r\nb", long_), (1, None, long_), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long_), (1, None, long_), (6, "u", "x" * 50_000)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc.write(d, f"file://{tmp_path}/w", roll_bytes=300)
    got = sorted(((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(manifest).collect()), key=repr)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        same = [p for p, _, x in pages if x == h and p is not None]
        revisit = len(raw) >= 100 and same and min(same) != i
        want.append((-1 if i is None else i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert got == sorted(want, key=repr) and manifest.count() > 1
    first = {r.uri.rpartition("/")[2]: r.bytes for r in manifest.collect()}
    again = warc.write(d, f"file://{tmp_path}/v", roll_bytes=300)
    for r in again.collect():
        name = r.uri.rpartition("/")[2]
        assert (tmp_path / "v/archives" / name).read_bytes() == (tmp_path / "w/archives" / name).read_bytes() and name in first
    assert warc.read(warc.write(d.limit(0), f"file://{tmp_path}/n")).count() == 0


def test_manifests_are_in_few_files(spark, tmp_path, monkeypatch):
    kind = type(spark.range(0))
    deal = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda df, n, *c: deal(df, max(n, 20), *c))
    d = spark.createDataFrame([(i, "u", f"{i} " * 100) for i in range(200)], "page_id long, url string, html string")
    pages = warc.write(d, f"file://{tmp_path}/p")
    ids = token_files.write(d.selectExpr("page_id AS doc_id", "html AS text"), common.tokenizer_file("byte_bpe_50k.json"), f"file://{tmp_path}/t")
    for folder, manifest, got in (("p", pages, warc.read(pages)), ("t", ids, token_files.read(ids))):
        assert manifest.count() > 10 and len(list((tmp_path / folder / "manifest").glob("part-*"))) == 1
        assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and got.count() == 200


def test_media(spark, odd, none, tmp_path):
    where = f"file://{tmp_path}/m"
    got = media.features(media.store(odd, where), where).collect()
    assert len(got) == len(ODD)
    texts = {i: t for i, t in ODD}
    for r in got:
        if r.doc_id is None:
            continue
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        wav = media.to_wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
    same = {r.feature for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1
    frames = sum(int(r.feature.split(";")[0][7:]) for r in got)
    tables = [media.read_tensors(p.read_bytes()) for p in (tmp_path / "m/tensors").iterdir()]
    assert sum(t.num_rows for t in tables) >= frames / media.FRAMES and tables[0]["mel"].type.shape == [media.FRAMES, media.MELS]
    assert media.features(media.store(none, f"file://{tmp_path}/n"), f"file://{tmp_path}/n").count() == 0


def test_resampling_and_segments():
    x = (np.random.default_rng(4).random(600) - 0.5).astype(np.float32)
    h = np.zeros(media.UP * media.TAPS)
    for p in range(media.UP):
        h[p :: media.UP] = media._FILTERS[p][::-1]
    up = np.zeros(len(x) * media.UP)
    up[:: media.UP] = x
    want = np.convolve(up, h)[: len(up) : media.DOWN]
    assert np.abs(media.resample(x) - want).max() < 1e-5
    e = np.array([0, 0, 5, 3, 0.5, 5, -5, -5, 0, 0.0])
    assert media.segments(e) == [(2, 6)]
