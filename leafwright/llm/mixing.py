"""Mixing sources to target weights (operator 7).

Each source's words, in ascending doc_id order, are packed into blocks of BLOCK words. Every output shard draws how many of its
slots each source gets from a multinomial over what the sources still have to give, so shards vary but the totals meet the
targets. A source's slot k is pass k div n over its n blocks; in a pass, slots map to blocks through a pseudorandom permutation
of the indices (a keyed Feistel network with cycle walking), so nothing is sorted or drawn per row. Blocks join slots by
(source, index). The last slot of a source is cut to the words that its target still needs. Another permutation orders the slots
of a shard: slices, the mix as it is written, name the shard and the place in it of every piece (shards and mixed_blocks).

Targets: the sources in code point order, null last, have the weights WEIGHTS, repeating, and share RATIO times all sizes; a target
stops at MOST times its source's size and the excess is shared again by weight. As a pass takes a block at most once, no
document is taken more than MOST (2) times its size.

A size is a text's number of words, runs outside [\\x20\\x09-\\x0D]; null and empty texts have 0 and are not taken. Rows with equal ids
are ordered by a hash of the text; null ids come first; rows equal in id, source and text are copies that follow each other. All rows
keep a row in the result; empty tables give an empty result; further columns, whatever their names, only go with the texts.
Sizes, places and slices are narrow rows; texts move once, to the slices of their words, and are cut in pieces of a batch,
so a very long text takes a few times its own bytes.
Prefix sums are in two levels (range, then rows of one range), so a source that holds most rows is spread over
all tasks. The driver sees one row a source (a mixture is a list of named sources) and the shards' counts for each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textvec

BLOCK, SHARDS, SEED = 512, 64, 20240609
WEIGHTS, RATIO, MOST = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]]) -> dict[str | None, float]:
    """Words to take of each source."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, (s, _) in enumerate(order)}
    size, left, out = dict(order), RATIO * sum(n for _, n in order), {}
    while True:
        open_ = [s for s in size if s not in out]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > MOST * size[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(MOST * size[s])
        left -= sum(out[s] for s in over)


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)


def permute(k: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The place of each k in a pseudorandom permutation of range(n), or what stands there (back)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [(seed * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) & ((1 << 64) - 1) for i in range(1, 7)]
    x = k.astype(np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = x[todo] >> np.uint64(half), x[todo] & mask
            for key in reversed(keys) if back else keys:
                if back:
                    left, right = right ^ (_round(left, key) & mask), left
                else:
                    left, right = right, left ^ (_round(right, key) & mask)
            x[todo] = (left << np.uint64(half)) | right
            todo = todo[x[todo] >= np.uint64(n)]  # outside: walk on along the cycle
    return x.astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """What a source gives: size and target in words, n blocks, full passes, and slots and words of the last pass."""

    name: str | None
    size: int
    target: float
    seed: int
    n: int
    full: int
    last: int
    cut: int

    @property
    def slots(self) -> int:
        return self.full * self.n + self.last


def plan(name: str | None, size: int, target: float, number: int, block: int) -> Plan:
    take, n, seed = min(round(target), MOST * size), -(-size // block), SEED + 1000 * number
    full, rest = divmod(take, size) if size else (0, 0)
    if not rest:
        return Plan(name, size, target, seed, n, full, 0, 0)
    tail = int(permute(np.asarray([n - 1]), n, seed + full, back=True)[0])
    words = lambda j: j * block - (n * block - size if tail < j else 0)
    last = -(-rest // block)
    last += words(last) < rest
    return Plan(name, size, target, seed, n, full, last, rest - words(last - 1))


def draws(slots: list[int], shards: int) -> list[tuple[int, int, int, int]]:
    """(source, shard, first slot, slots): each shard's multinomial counts over what the sources still have."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    left, total, out = np.asarray(slots, np.int64), int(sum(slots)), []
    given = np.zeros(len(slots), np.int64)
    for h in range(shards):
        want = total * (h + 1) // shards - total * h // shards
        counts = np.zeros(len(slots), np.int64)
        while want:
            free = left - counts
            counts += np.minimum(rng.multinomial(want, free / free.sum()), free)
            want = total * (h + 1) // shards - total * h // shards - int(counts.sum())
        out += [(s, h, int(given[s]), int(c)) for s, c in enumerate(counts) if c]
        given += counts
        left = left - counts
    return out


def _source(c: str = "source"):
    """The source as a key that is never null."""
    return F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(c).cast("string")))


def _key(name: str | None) -> str:
    return "n" if name is None else "s" + name


def _placed(docs: DataFrame, where: str) -> tuple[DataFrame, list[tuple[str | None, int]]]:
    """(rows, sizes): a row of doc_id, sk, h (hash of the text), size and start (its first word's place in its source) for each row
    of docs, and each source's words."""
    t = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source().alias("sk"), F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(t).alias("h"))
    groups = common.save(sized.groupBy("sk", "doc_id", "h").agg(F.max("size").alias("size"), F.count("*").alias("times")), where, "sized")

    def run(batches):
        from pyspark import TaskContext

        common.hold()
        part, given = TaskContext.get().partitionId(), {}
        for batch in batches:
            sk, words = batch.column(0).to_pylist(), [s * n for s, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            at = []
            for s, n in zip(sk, words, strict=True):
                at.append(given.get(s, 0))
                given[s] = at[-1] + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(batch), pa.int64()), pa.array(at, pa.int64())], names=[*batch.schema.names, "part", "at"])

    keys = [F.col("sk"), F.col("doc_id").asc_nulls_first(), F.col("h")]
    ranged = common.ranged(groups, keys, 50_000).mapInArrow(run, "sk string, doc_id long, h long, size long, times long, part long, at long")
    ranged = common.save(ranged, where, "ranged")
    sums = common.save(ranged.groupBy("sk", "part").agg(F.sum(F.col("size") * F.col("times")).alias("words")), where, "sums")
    before = sums.select("sk", "part", F.coalesce(F.sum("words").over(Window.partitionBy("sk").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = ranged.join(before, ["sk", "part"]).select("sk", "doc_id", "h", "size", "times", (F.col("before") + F.col("at")).alias("start"))
    # Copies one by one, some thousand from each row of a first step, as a row may stand for any number.
    step = 4096
    some = rows.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {step}"))))
    each = some.withColumn("i", F.explode(F.sequence(F.col("c") * step, F.least(F.col("times"), (F.col("c") + 1) * step) - 1)))
    each = each.select("sk", "doc_id", "h", "size", "times", (F.col("start") + F.col("i") * F.col("size")).alias("start"))
    sizes = [(None if r.sk == "n" else r.sk[1:], r.words) for r in sums.groupBy("sk").agg(F.sum("words").alias("words")).collect()]
    return common.save(each, where, "rows"), sizes


def _slots(spark, plans: list[Plan], block: int, shards: int) -> DataFrame:
    """sk, block, pass, shard, slot (place in the shard), most (words of the block to take) of every slot."""
    drawn = draws([p.slots for p in plans], shards)
    total: dict[int, int] = {}
    runs = []  # source, shard, first slot of the source, first place in the shard, slots
    for s, h, k0, c in drawn:
        runs.append((s, h, k0, total.get(h, 0), c))
        total[h] = total.get(h, 0) + c
    step = 1 << 15
    each = spark.createDataFrame(pa.table({c: pa.array([r[i] for r in runs], pa.int64()) for i, c in enumerate(("s", "h", "k0", "p0", "c"))}))
    each = each.withColumn("o", F.explode(F.expr(f"sequence(0L, c - 1, {step}L)"))).select("s", "h", (F.col("k0") + F.col("o")).alias("k"), (F.col("p0") + F.col("o")).alias("p"), F.least(F.col("c") - F.col("o"), F.lit(step)).alias("c"))

    def run(batches):
        for batch in batches:
            for s, h, k0, p0, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                p = plans[s]
                k = np.arange(k0, k0 + c)
                turn, index = k // p.n, k % p.n
                at = np.empty(c, np.int64)
                for e in np.unique(turn).tolist():
                    at[turn == e] = permute(index[turn == e], p.n, p.seed + e)
                most = np.where((k == p.slots - 1) & (p.last > 0), p.cut, block)
                slot = permute(np.arange(p0, p0 + c), total[h], SEED - 1 - h)
                cols = [pa.array(x.astype(np.int64)) for x in (at, turn, np.full(c, h), slot, most)]
                yield pa.RecordBatch.from_arrays([pa.array([_key(p.name)] * c, pa.string()), *cols], names=["sk", "block", "pass", "shard", "slot", "most"])

    slots = sum(p.slots for p in plans)
    return each.repartition(int(min(common.MOST_TASKS, max(1, slots // 100_000)))).mapInArrow(run, "sk string, block long, pass long, shard long, slot long, most long")


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS):
    """(rows, slices, facts): rows has sk, doc_id, h, size, times (equal rows) and start of each row; slices has a row for each
    piece of a row that a slot takes: sk, start, pass, shard, slot, a, b (its words, b excluded); facts has sk, source_size, target."""
    spark = docs.sparkSession
    common.ready(spark)
    rows, sizes = _placed(docs, common.scratch(spark))
    goal = targets(sizes)
    plans = [plan(s, n, goal[s], i, block) for i, (s, n) in enumerate(sorted(sizes, key=lambda s: (s[0] is None, s[0] or "")))]
    # The hint: Spark takes the slots for as small as their runs and would broadcast them, but they grow with the input.
    slots = _slots(spark, plans, block, shards).hint("merge")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = rows.where("size > 0").select("sk", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo, hi = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("most"))
    slices = pieces.join(slots, ["sk", "block"]).select("sk", "start", "pass", "shard", "slot", (lo - F.col("start")).alias("a"), (hi - F.col("start")).alias("b")).where("a < b")
    facts = pa.table({"sk": pa.array([_key(p.name) for p in plans], pa.string()), "source_size": pa.array([p.size for p in plans], pa.int64()), "target": pa.array([float(p.target) for p in plans], pa.float64())})
    return rows, slices, spark.createDataFrame(facts)


def taken(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard, last_shard (null if none takes of it) for each row of docs (doc_id, source, text)."""
    rows, slices, facts = mix(docs, shards=shards)
    words = slices.groupBy("sk", "start").agg(F.sum(F.col("b") - F.col("a")).alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    some = rows.where("size > 0").select("sk", "doc_id", "size", "start").join(words, ["sk", "start"], "left").drop("start")
    none = rows.where("size = 0").select("sk", "doc_id", "size", *[F.lit(None).cast("long").alias(c) for c in ("taken", "first_shard", "last_shard")])
    return some.union(none).join(facts, "sk").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")


def _joined(docs: DataFrame, rows: DataFrame, slices: DataFrame) -> DataFrame:
    """_pass, _shard, _slot, _a, _b (arrays: the slices of a row), _size and the columns of docs, for each row that the mix takes of.

    Rows equal in id, source and text go by the one that is least as JSON.
    """
    t = F.col("text").cast("string")
    key = lambda s, d, h: [s.alias("_s"), d.isNull().alias("_z"), F.coalesce(d, F.lit(0)).alias("_d"), h.alias("_h")]
    of, row = key(_source(), F.col("doc_id").cast("long"), F.xxhash64(t)), F.struct(*docs.columns)
    repeats = bool(rows.where("times > 1 and size > 0").limit(1).count())
    texts = docs.groupBy(*of).agg(F.min_by(row, F.to_json(row)).alias("_row")) if repeats else docs.select(*of, row.alias("_row"))
    each = slices.groupBy("sk", "start").agg(F.array_sort(F.collect_list(F.struct("pass", "a", "b", "shard", "slot"))).alias("r"))
    each = rows.where("size > 0").join(each, ["sk", "start"]).select(*key(F.col("sk"), F.col("doc_id"), F.col("h")), F.col("size").alias("_size"), "r")
    return texts.join(each, ["_s", "_z", "_d", "_h"]).select(*[F.col(f"r.{c}").alias(f"_{c}") for c in ("pass", "shard", "slot", "a", "b")], "_size", "_row.*")


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray, a: list[int], b: list[int]) -> bytes:
    """The words a to b (excluded) of each slice, which ascend: words that follow each other keep what is between them, gaps become a line break."""
    joined: list[list[int]] = []
    for x, y in zip(a, b, strict=True):
        if joined and joined[-1][1] == x:
            joined[-1][1] = y
        else:
            joined.append([x, y])
    return b"\n".join([text[starts[x] : ends[y - 1]] for x, y in joined])


def _emit(part: pa.RecordBatch, at: int, by_pass: bool):
    """(row, first slice, text) of each pass over a row, or of each slice; the text is None where it is the whole one."""
    lists = [part.column(i) for i in range(5)]
    bounds = np.asarray(lists[0].offsets).tolist()
    turn, a, b = (np.asarray(lists[i].values).tolist() for i in (0, 3, 4))
    size = part.column(5).to_pylist()
    out = []
    for i, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
        cut = [x, *[j for j in range(x + 1, y) if not by_pass or turn[j] != turn[j - 1]], y]
        out += [(i, j, k, sum(b[j:k]) - sum(a[j:k]) == size[i]) for j, k in zip(cut, cut[1:], strict=False)]
    rows = sorted({i for i, _, _, whole in out if not whole})
    place = {r: n for n, r in enumerate(rows)}
    raw, ends_of = textvec.flat(part.column(at).take(pa.array(rows, pa.int64())))
    starts, ends, first = textvec.spans(raw, ends_of)
    data = raw.data
    for i, j, k, whole in out:
        if whole:
            yield i, j, None
        else:
            n = place[i]
            yield i, j, _cut(data, starts[first[n] : first[n + 1]], ends[first[n] : first[n + 1]], a[j:k], b[j:k])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass over a document the words it takes, with the columns of docs (text and n_chars anew).

    Words that follow each other keep the text between them; gaps become a line break. A document that is wholly taken keeps
    its whole text.
    """
    names = docs.columns
    rows, slices, _ = mix(docs)

    def run(batches):
        common.hold()
        at = 6 + names.index("text")
        for batch in batches:
            for part in common.pieces(batch):
                made = list(_emit(part, at, True))
                which = pa.array([i for i, _, _ in made], pa.int64())
                cols = [part.column(6 + i).take(which) for i in range(len(names))]
                if any(t is not None for _, _, t in made):
                    old = part.column(at).cast(pa.binary())
                    text = pa.array([old[i].as_py() if t is None else t for i, _, t in made], pa.binary()).cast(pa.string())
                    cols[names.index("text")] = text
                    if "n_chars" in names:
                        cols[names.index("n_chars")] = pc.utf8_length(text).cast(cols[names.index("n_chars")].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return _joined(docs, rows, slices).mapInArrow(run, docs.schema)


def mixed_blocks(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix as output shards: shard, slot, doc_id, pass, first_word and text of each slice, in the order of shards and slots."""
    rows, slices, _ = mix(docs, shards=shards)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("text").cast("string").alias("text"))
    names = ["shard", "slot", "doc_id", "pass", "first_word", "text"]

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch):
                made = list(_emit(part, 8, False))
                old = part.column(8).cast(pa.binary())
                j = pa.array([j for _, j, _ in made], pa.int64())
                turn, shard, slot, a = (part.column(i).values.take(j) for i in range(4))
                text = pa.array([old[i].as_py() if t is None else t for i, _, t in made], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([shard, slot, part.column(6).take(pa.array([i for i, _, _ in made], pa.int64())), turn, a, text], names=names)

    made = _joined(own, rows, slices).mapInArrow(run, "shard long, slot long, doc_id long, pass long, first_word long, text string")
    return made.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot", "doc_id", "first_word")
