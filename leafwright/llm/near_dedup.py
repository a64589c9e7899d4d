"""MinHash near-duplicates with tensored banding (operator 2).

Two small collections of HALVES hash keys are computed for each shingle set, each key of ROWS minima; every pair of a key
of the one and a key of the other is a table of 2 * ROWS minima. So HALVES ** 2 tables cost 2 * HALVES * ROWS minima, about
the square root of what separate tables would take. A pair with similarity s shares a table with probability
(1 - (1 - s**ROWS)**HALVES)**2: 0.9996 at 0.8, 0.99999 at 0.85, with the defaults; exact=True leaves no such chance.

Plan:
1. One pass over the texts makes each document's set size, a 128-bit key of its full set and its half keys.
2. Documents with equal sets are one class, so exact copies never meet as pairs.
3. Half keys that only one class has cannot take part in a table and go; the rest are paired to table keys.
4. First round: of a SHARE-th of the tables, by the table key's hash, each class is compared with the table's least class: a
   star, not all pairs. One pair a class is confirmed on full sets; the confirmed links make components.
5. All tables: classes are sorted by component, so that the tables of one component's members fall together before they are
   shuffled. Tables that hold one component only are settled.
6. In the other, open tables further stars, with other heads each turn, link classes to other components while that finds links.
7. Classes still in open tables are compared by an exact prefix-filter join (rarest shingles first) across components, so no link
   depends on which class a star had at its centre. Components again, over all confirmed links.

Shingles are held as 64-bit hashes, classes named by 64 bits of their key; two shingles of a pair of documents agree by chance
with probability below 1e-10. Joins are keyed sort-merge joins that adaptive execution may split, groupings reduce before the shuffle,
nothing but counts reaches the driver.

Null or wordless texts have an empty set and link with nothing. Null ids keep their row, with a null component, and link with
nothing. Rows with one id are one node, whatever their texts: it is in one component with all that any of its texts is like, and its
rows have one component_id. Very long texts are a piece of a batch each. Ties (equal sets) are links. Further columns of the input,
whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, textvec

ROWS, HALVES = 4, 16
PERCENT = 80
#: One table in so many is looked at in the first round.
SHARE = 16
#: Star turns over open tables at most, heads a class goes to in each; a turn that links fewer than one class in FEW is the last.
TURNS, HEADS, FEW = 5, 4, 50


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240607))
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def half_keys(shingles: np.ndarray, rows: int, halves: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """2 * halves keys, each a hash of rows minima and of its own number; the lowest bit tells the two collections apart."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 1024):
            x = shingles[i : i + 1024][None, :] * a[:, None]
            x += b[:, None]
            x ^= x >> np.uint64(29)
            np.minimum(least, x.min(axis=1), out=least)
        m = textvec.mix(least).reshape(2 * halves, rows)
        h = np.arange(1, 2 * halves + 1, dtype=np.uint64)
        for j in range(rows):
            h = textvec.mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, j])
    h = (h & ~np.uint64(1)) | (np.arange(2 * halves) >= halves).astype(np.uint64)
    return h.astype(np.int64)


def sketches(docs: DataFrame, width: int, rows: int = ROWS, halves: int = HALVES) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, hi and lo (key of the full set), keys (half keys) of each row."""
    a, b = _functions(2 * halves * rows)
    names = ["doc_id", "hash", "n_shingles", "hi", "lo", "keys"]

    def run(batches):
        common.hold()
        for batch in batches:
            for part in common.pieces(batch):
                n, key, keys, last = [], [], [], {}
                for s in textvec.shingle_sets(part.column(2), width):
                    n.append(len(s))
                    key.append(_name(s))
                    if key[-1] not in last:  # copies often stand side by side
                        last[key[-1]] = half_keys(s, rows, halves, a, b) if len(s) else None
                    keys.append(last[key[-1]])
                both = np.frombuffer(b"".join(key), np.int64).reshape(-1, 2)
                cols = [pa.array(n, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=names)

    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("hash"), t.alias("text")).mapInArrow(run, "doc_id long, hash long, n_shingles long, hi long, lo long, keys array<long>")


def _name(shingles: np.ndarray) -> bytes:
    """128 bits of a shingle set; the first 64 name its class."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame, wanted: DataFrame, width: int, repeats: bool) -> DataFrame:
    """k, b, head and shingles (sorted distinct hashes) of each class in wanted (k, id, b, head)."""

    def run(batches):
        common.hold()
        for batch in batches:
            for part in common.pieces(batch):
                names = part.column(0).to_pylist()
                sets = [s if int.from_bytes(_name(s)[:8], "little", signed=True) == k else None for s, k in zip(textvec.shingle_sets(part.column(3), width), names, strict=True)]
                keep = [i for i, s in enumerate(sets) if s is not None]  # of an id with several texts, those of the class
                yield pa.RecordBatch.from_arrays([*part.select([0, 1, 2]).take(pa.array(keep, pa.int64())).columns, pa.array([sets[i].astype(np.int64) for i in keep], pa.list_(pa.int64()))], names=["k", "b", "head", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets = texts.join(wanted, "id").select("k", "b", "head", "text").mapInArrow(run, "k long, b long, head boolean, shingles array<long>")
    return sets.dropDuplicates(["k"]) if repeats else sets


def _like(pairs: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs (a, b, sa, sb) whose sets have 100 * intersection >= percent * union, as (a, b)."""
    x = pairs.where(F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * percent)
    x = x.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return x.where(F.col("common") * 100 >= (F.size("sa") + F.size("sb") - F.col("common")) * percent).select("a", "b")


def labelled(docs: DataFrame, width: int = 5, percent: int = PERCENT, rows: int = ROWS, halves: int = HALVES, exact: bool = False, by_id: bool = True) -> DataFrame:
    """doc_id, hash, n_shingles, hi, least (id and k of the least class of the component; null without words or id) of each row.

    With by_id, the rows of one id are one node; without, each text stands for itself. With exact, all classes go to the
    prefix-filter join, so links do not depend on the tables at all.
    """
    spark = docs.sparkSession
    common.ready(spark)
    where = common.scratch(spark)
    common.release(spark)
    base = common.save(sketches(docs, width, rows, halves), where, "sketches")
    has = base.where("n_shingles > 0 and doc_id is not null")
    # A class: k (its name), lo, id (its least document), keys.
    classes = common.save(has.groupBy(F.col("hi").alias("k"), "lo").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")), where, "classes")
    repeats = bool(has.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())
    links = classes.select(F.col("k").alias("a"), F.col("k").alias("b")).limit(0)
    if by_id and repeats:
        same = has.groupBy("doc_id").agg(F.min("hi").alias("b"), F.max("hi").alias("y")).where("b < y").select("doc_id", "b")
        links = common.save(has.join(same, "doc_id").where("hi <> b").select(F.col("hi").alias("a"), "b").distinct(), where, "links-ids")

    if exact:
        sets = common.save(_sets(docs, classes.select("k", "id", F.lit(0).cast("long").alias("b"), F.lit(False).alias("head")), width, repeats), where, "sets")
    else:
        one = classes.select("k", F.explode("keys").alias("key"))
        shared = one.groupBy("key").agg(F.min("k").alias("x"), F.max("k").alias("y")).where("x < y").select("key")
        # With 4 minima a half key that unrelated documents share is rare, so few classes go on to the tables.
        halved = one.join(shared, "key", "left_semi").groupBy("k").agg(F.collect_list("key").alias("h"))
        side = lambda bit: F.filter("h", lambda x: x.bitwiseAND(F.lit(1)) == bit)
        kept = common.save(halved.select("k", side(0).alias("p"), side(1).alias("q")).where("size(p) > 0 and size(q) > 0"), where, "kept")
        tables = lambda frame, *names: frame.select(*names, F.explode("p").alias("p"), "q").select(*names, "p", F.explode("q").alias("q")).select(*names, F.xxhash64("p", "q").alias("t"))
        some = tables(kept, "k").where(F.pmod("t", F.lit(SHARE)) == 0)
        heads = some.groupBy("t").agg(F.min("k").alias("b"), F.max("k").alias("last")).where("b < last").select("t", "b")
        lead = common.save(some.join(heads, "t").where("k > b").groupBy("k").agg(F.min("b").alias("b")), where, "lead")
        wanted = kept.select("k").join(classes.select("k", "id"), "k").join(lead, "k", "left").join(lead.select(F.col("b").alias("k"), F.lit(True).alias("head")).distinct(), "k", "left")
        sets = common.save(_sets(docs, wanted.select("k", "id", "b", F.coalesce("head", F.lit(False)).alias("head")), width, repeats), where, "sets")
        # Every set moves once to its head, a head's own set once.
        own = sets.where("head").select(F.col("k").alias("b"), F.col("shingles").alias("sb"))
        first = sets.where("b is not null").select(F.col("k").alias("a"), "b", F.col("shingles").alias("sa")).join(own, "b")
        links = common.save(links.union(_like(first, percent)), where, "links")
        del one, shared, halved, some, heads, lead, wanted, own, first
        common.release(spark, where, "lead")
    parts, done = common.save(components.connected(links, where, "ca"), where, "parts"), False

    def merged(found: DataFrame, name: str) -> DataFrame:
        """The components with further links: stars stand for the links they came from."""
        star = parts.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        return common.save(components.connected(star.union(found), where, f"c-{name}"), where, f"parts-{name}")

    if exact:
        members = classes.select("k").join(parts.withColumnRenamed("id", "k"), "k", "left").select("k", F.coalesce("component", "k").alias("component"))
    else:
        relabel = lambda frame, names: frame.join(names.select(F.col("id").alias("component"), F.col("component").alias("_c")), "component", "left").withColumn("component", F.coalesce("_c", "component")).drop("_c")
        # Rows of one component side by side: its tables meet in few tasks, which send on one row a table and component.
        whole = relabel(kept.withColumn("component", F.col("k")), parts).repartitionByRange(max(1, -(-kept.count() // 1000)), "component", "k")
        whole = common.save(whole, where, "placed-0")
        per = common.save(tables(whole, "component").groupBy("t", "component").agg(F.count("*").alias("n")).select("t", "component"), where, "tables-0")
        for turn in range(1, TURNS + 2):
            open_ = common.save(per.groupBy("t").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("t"), where, f"open-{turn}")
            touched = per.join(open_, "t", "left_semi").select("component").distinct()
            rows_in = common.save(tables(whole.join(touched, "component", "left_semi"), "k", "component").join(open_, "t", "left_semi"), where, f"rows-{turn}")
            if turn > TURNS or done:
                break
            found, done = _stars(rows_in, sets, percent, turn, where)
            parts = merged(found, f"{turn}")
            whole, per = common.save(relabel(whole, parts), where, f"placed-{turn}"), common.save(relabel(per, parts).distinct(), where, f"tables-{turn}")
            del open_, touched, rows_in, found
            common.release(spark, where, *[f"{n}-{turn - (n in ('placed', 'tables'))}" for n in ("placed", "tables", "open", "rows")], f"stars-{turn}")
        members = rows_in.select("k", "component").distinct()
    found = common.save(_prefix_links(sets, common.save(members, where, "members"), percent, where), where, "found")
    del sets, members
    common.release(spark, where, "kept", "members", "member-sets", "sets")
    if found.limit(1).count():
        parts = merged(found, "last")
    of = classes.select("k", "lo", "id").join(parts.withColumnRenamed("id", "k"), "k", "left")
    least = of.where("component is not null").groupBy("component").agg(F.min(F.struct("id", "k")).alias("least"))
    label = of.join(least, "component", "left").select(F.col("k").alias("hi"), "lo", F.coalesce("least", F.struct("id", "k")).alias("least"))
    return base.select("doc_id", "hash", "n_shingles", "hi", "lo").join(label, ["hi", "lo"], "left").select("doc_id", "hash", "n_shingles", "hi", F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("least"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, rows: int = ROWS, halves: int = HALVES, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text); see the module's text.

    component_id is the least doc_id reachable over confirmed links, kept is doc_id = component_id.
    """
    rows_ = labelled(docs, width, percent, rows, halves, exact)
    out = rows_.select("doc_id", "n_shingles", F.coalesce("least.id", "doc_id").alias("component_id"))
    # An id with a wordless row beside others: all its rows have the component of the others.
    some, none = out.where("n_shingles > 0"), out.where("n_shingles = 0")
    if some.select("doc_id").join(none.select("doc_id"), "doc_id", "left_semi").limit(1).count():
        none = none.join(some.groupBy("doc_id").agg(F.min("component_id").alias("c")), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "component_id").alias("component_id"))
        out = some.union(none)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, without the near-duplicates: of each group of like texts the least one stays.

    Here each text is a node: rows of one id with unlike texts are in groups of their own, so no group is lost for another. The
    least of a group is that with the least id (of its texts, the one with the least set key). Rows that are equal in id and text
    are one document, with the other columns of the row that is least as JSON. Rows with a null id and wordless rows stay.
    """
    rows = labelled(docs, width, percent, by_id=False)
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gone = rows.where((F.col("least.id") != F.col("doc_id")) | (F.col("least.k") != F.col("hi"))).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    kept = docs.join(gone, (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64(t) == F.col("_hash")), "left_anti")
    if not rows.groupBy("doc_id", "hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return kept
    row = F.struct(*docs.columns)
    return kept.groupBy(F.col("doc_id").alias("_id"), F.xxhash64(t).alias("_hash"), F.col("text").isNull().alias("_null")).agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")


def _stars(rows: DataFrame, sets: DataFrame, percent: int, turn: int, where: str) -> tuple[DataFrame, bool]:
    """Confirmed links of open tables' classes (t, k, component) to heads of other components, and whether they were few.

    The head of a table is another class each turn (least by a hash); a class goes to HEADS of its tables' heads at most, which
    is no cap on links: what is not found here is left to the prefix-filter join.
    """
    by = lambda c: F.xxhash64(c, F.lit(turn))
    heads = rows.groupBy("t").agg(F.min(F.struct(by("k").alias("o"), "k", "component")).alias("head")).select("t", F.col("head.k").alias("b"), F.col("head.component").alias("c"))
    each = rows.join(heads, "t").where("component <> c").groupBy("k").agg(F.slice(F.array_sort(F.collect_set(F.struct(by("b").alias("o"), "b"))), 1, HEADS).alias("h"))
    pairs = common.save(each.select("k", F.explode("h.b").alias("b")), where, f"stars-{turn}")
    own = sets.join(pairs.select(F.col("b").alias("k")).distinct(), "k", "left_semi").select(F.col("k").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(sets.select("k", F.col("shingles").alias("sa")), "k").select(F.col("k").alias("a"), "b", "sa").join(own, "b")
    found = common.save(_like(both, percent), where, f"star-links-{turn}")
    tried, linked = pairs.agg(F.count_distinct("k")).first()[0], found.agg(F.count_distinct("a")).first()[0]
    return found, linked * FEW <= tried


def _prefix_links(sets: DataFrame, members: DataFrame, percent: int, where: str) -> DataFrame:
    """All links among members (k, component) of different components, by a prefix-filter join with size and position filters.

    A pair with similarity s >= percent shares one of the first n - ceil(s * n) + 1 shingles of each set when both are sorted
    in one order. Shingles that one component alone has cannot be shared by such a pair: they come first and are no keys; the others
    follow, rarest first, which makes keys selective.
    """
    s = common.save(sets.select("k", "shingles").join(members, "k"), where, "member-sets")
    each = s.select("k", "component", F.explode("shingles").alias("g"))
    counts = each.groupBy("g").agg(F.count("*").alias("f"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("g", "f")
    ranked = each.select("k", "g").join(counts, "g").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("seq"))
    sized = s.select("k", "component", F.size("shingles").alias("n")).join(ranked, "k").withColumn("alone", F.col("n") - F.size("seq"))
    sized = sized.withColumn("length", F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1 - F.col("alone")).where("length > 0")
    keys = sized.select("k", "component", "n", "alone", F.posexplode(F.slice("seq", 1, F.col("length").cast("int"))).alias("at", "x")).select("k", "component", "n", F.col("x.g").alias("g"), (F.col("n") - F.col("alone") - F.col("at")).alias("rest"))
    a, b = (keys.select("g", *[F.col(c).alias(f"{c}_{k}") for c in ("k", "component", "n", "rest")]) for k in "ab")
    least = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100.0 + percent) - 1e-9)
    pairs = (
        a.join(b, "g")
        .where((F.col("component_a") < F.col("component_b")) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.least("rest_a", "rest_b") >= least))
        .select(F.col("k_a").alias("a"), F.col("k_b").alias("b"))
        .distinct()
    )
    both = pairs.join(s.select(F.col("k").alias("a"), F.col("shingles").alias("sa")), "a").join(s.select(F.col("k").alias("b"), F.col("shingles").alias("sb")), "b")
    return _like(both, percent)
