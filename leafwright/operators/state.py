"""Translation memory, jobs, progress and model tables: J1, J2, T1-T7, O1, O5, O9, A6-A9, A24-A28, W13, M1-M3, M14, P21, J16, J20."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from leafwright.functions import text as T

#: Days a cached answer lives, shortest text that is cached, share that an eviction removes.
TTL_SECONDS, LEAST_CACHED, EVICT_SHARE = 30 * 86400, 10, 5
#: Share of the whole progress before each phase.
PHASES = {"init": 0, "extraction": 10, "translation": 80, "layout": 95, "output": 98, "complete": 100, "failed": 0}


# Cache ---------------------------------------------------------------------------------------------------------------------
def look_up(requests: DataFrame, cache: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Each request (text, language, model) with its cached answer, null on a miss, an expired one or a short text."""
    keyed = requests.withColumn("cache_key", T.cache_key(F.col("text"), F.col("language"), F.col("model")))
    live = cache.where(now - F.col("created_at") <= ttl).select("cache_key", F.col("translated").alias("answer"))
    found = keyed.join(live, "cache_key", "left")
    return found.withColumn("answer", F.when(F.length(T.strip(F.col("text"))) >= LEAST_CACHED, F.col("answer")))


def hits(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests in the cache."""
    return keyed.join(cache.select("cache_key"), "cache_key", "left_semi")


def misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests not in the cache."""
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows replace cached ones of their key; the newest of a key stays, with access_count 1 again."""
    w = Window.partitionBy("cache_key").orderBy(F.col("_new").desc(), F.col("created_at").desc(), F.col("translated"))
    both = cache.withColumn("_new", F.lit(0)).unionByName(fresh.withColumns({"access_count": F.lit(1).cast("long"), "_new": F.lit(1)}))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def touch(cache: DataFrame, accesses: DataFrame) -> DataFrame:
    """An access log (cache_key, ts) counted into the cache."""
    a = accesses.groupBy("cache_key").agg(F.count("*").alias("n"), F.max("ts").alias("t"))
    x = cache.join(a, "cache_key", "left")
    return x.withColumns({"access_count": F.col("access_count") + F.coalesce("n", F.lit(0)), "accessed_at": F.greatest("accessed_at", "t")}).drop("n", "t")


def live(cache: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Without expired rows."""
    return cache.where(now - F.col("created_at") <= ttl)


def evict(cache: DataFrame, share: int = EVICT_SHARE) -> DataFrame:
    """Without the least recently used fifth (rounded down); ties at the cut are settled by key.

    The cut is an exact order statistic from counts, by days, then by the seconds of one day, then by the rows of one second, so no
    task sorts the rows of the table; the driver gets one row of each count.
    """
    left = cache.count() // share
    if not left:
        return cache
    at, rest, gone = F.col("accessed_at"), cache, F.lit(False)
    for width in (86400, 1):
        unit = F.floor(at / width)
        upto = F.sum("k").over(Window.orderBy("u").rowsBetween(Window.unboundedPreceding, 0))
        cut = rest.groupBy(unit.alias("u")).agg(F.count("*").alias("k")).withColumn("upto", upto).where(F.col("upto") >= left).orderBy("u").first()
        gone, rest, left = gone | (unit < cut.u), rest.where(unit == cut.u), left - (cut.upto - cut.k)
    inside = rest.withColumn("_n", F.row_number().over(Window.orderBy("accessed_at", "cache_key"))).where(F.col("_n") > left).drop("_n")
    return cache.where(~gone & (F.floor(at) != cut.u)).unionByName(inside)


def clear(cache: DataFrame, language: str | None = None) -> DataFrame:
    """T5: empty, or without one language."""
    return cache.where(F.lit(False)) if language is None else cache.where(~F.col("language").eqNullSafe(language))


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries, bytes, hits and their rate (an entry's first access is its miss), oldest and newest."""
    hit = F.coalesce(F.sum(F.col("access_count") - 1), F.lit(0))
    return cache.agg(
        F.count("*").alias("entries"), hit.alias("hits"), F.coalesce(F.sum(F.length("translated")), F.lit(0)).alias("bytes"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"),
        F.when(F.coalesce(F.sum("access_count"), F.lit(0)) > 0, hit / F.sum("access_count")).otherwise(F.lit(0.0)).alias("hit_rate"),
    )


def once_each(requests: DataFrame, translate, key: Column) -> DataFrame:
    """The cache's evident use at scale: call an expensive hook once for each distinct key, then join the answers back."""
    keyed = requests.withColumn("cache_key", key)
    answers = translate(keyed.groupBy("cache_key").agg(F.min("text").alias("text"))).select("cache_key", "answer")
    return keyed.join(answers, "cache_key", "left")


# Jobs ----------------------------------------------------------------------------------------------------------------------
def job_queue(jobs: DataFrame) -> DataFrame:
    """O1: priority descending, then submission order."""
    return jobs.orderBy(F.col("priority").desc(), "seq")


def ranked_queue(jobs: DataFrame) -> DataFrame:
    """O1 with the place in the queue, from 1: a range-partitioned sort whose parts are counted, so no task gets all jobs."""
    schema = T_.StructType([*jobs.schema.fields, T_.StructField("rank", T_.LongType(), False)])
    return job_queue(jobs).rdd.zipWithIndex().map(lambda p: (*p[0], p[1] + 1)).toDF(schema)


def job_summary(jobs: DataFrame, *keys: str) -> DataFrame:
    """Totals, success rate, mean of the scores that are not 0 and the time of finished jobs."""
    done, total = F.count_if(F.col("status") == "completed"), F.count("*")
    return jobs.groupBy(*keys).agg(
        total.alias("total"), done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "pending").alias("cancelled"),
        F.when(total > 0, 100.0 * done / total).otherwise(F.lit(0.0)).alias("success_rate"), F.coalesce(F.avg(F.nullif("quality", F.lit(0.0))), F.lit(0.0)).alias("avg_quality"),
    )


def resumable(jobs: DataFrame) -> DataFrame:
    """Pending and running jobs."""
    return jobs.where(F.col("status").isin("pending", "running"))


# Progress ------------------------------------------------------------------------------------------------------------------
def latest_state(events: DataFrame, *keys: str) -> DataFrame:
    """The last event of each block; ties by event id."""
    return events.groupBy(*keys).agg(F.max_by("event", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"), F.count("*").alias("events"))


def page_progress(blocks: DataFrame) -> DataFrame:
    """Complete blocks, percent (100 for an empty page), and the blocks still to do."""
    done = F.count_if("is_complete")
    return blocks.groupBy("job_id", "page").agg(
        F.count("block").alias("blocks"), done.alias("complete"), F.when(F.count("block") == 0, F.lit(100.0)).otherwise(100.0 * done / F.count("block")).alias("percent"),
        F.array_sort(F.collect_list(F.when(~F.col("is_complete"), F.col("block")))).alias("to_do"),
    )


def overall_progress(phase: Column, pages_done: Column, pages: Column) -> Column:
    """The phase's weight; in translation 10 and up to 70 by pages; 0 without pages or for a phase that has no weight."""
    weight = F.create_map(*[F.lit(float(x) if isinstance(x, int) else x) for p in PHASES.items() for x in p])
    return F.when(F.coalesce(pages, F.lit(0)) == 0, 0.0).when(phase == "translation", 10 + 70.0 * pages_done / pages).otherwise(F.coalesce(weight[phase], F.lit(0.0)))


def can_resume(phase: Column) -> Column:
    """P25: neither complete nor failed."""
    return ~phase.isin("complete", "failed")


def rate_and_eta(done: Column, total: Column, elapsed: Column) -> Column:
    """struct(mean, per_minute, remaining, eta, percent); zeros before the first page."""
    mean = F.when(done > 0, elapsed / done).otherwise(F.lit(0.0))
    return F.struct(
        mean.alias("mean"), F.when(elapsed > 0, 60.0 * done / elapsed).otherwise(F.lit(0.0)).alias("per_minute"), (total - done).alias("remaining"), (mean * (total - done)).alias("eta"),
        F.when(total > 0, 100.0 * done / total).otherwise(F.lit(0.0)).alias("percent"),
    )


def speed_trend(pages: DataFrame, key: str, order: list[str], seconds: str) -> DataFrame:
    """Mean of the last three times against the three before (the first three while under six), 10 % either way."""
    w = Window.partitionBy(key).orderBy(*order)
    last, prev = F.avg(seconds).over(w.rowsBetween(-2, 0)), F.avg(seconds).over(w.rowsBetween(-5, -3))
    x = pages.withColumns({"_n": F.row_number().over(w), "_last": last, "_prev": prev})
    heads = x.where("_n <= 3").groupBy(key).agg(F.avg(seconds).alias("_head"))
    x = x.join(heads, key).withColumn("_base", F.when(F.col("_n") >= 6, F.col("_prev")).otherwise(F.col("_head")))
    trend = F.when(F.col("_n") < 3, "→").when(F.col("_last") < F.col("_base") * 0.9, "↑").when(F.col("_last") > F.col("_base") * 1.1, "↓").otherwise("→")
    return x.withColumn("trend", trend).drop("_n", "_last", "_prev", "_head", "_base")


def log_summary(lines: DataFrame) -> DataFrame:
    """Lines of four or more parts by level, with their first messages."""
    p = F.split("value", r" \| ")
    x = lines.where(F.size(p) >= 4).select(T.strip(p[1]).alias("level"), p[3].alias("message"))
    return x.groupBy("level").agg(F.count("*").alias("lines"), F.min("message").alias("first"))


# Models and tiers ----------------------------------------------------------------------------------------------------------
def step_lookup(values: DataFrame, steps: DataFrame, value: str) -> DataFrame:
    """M2: for each value the step with the largest threshold at or under it; steps is a small dimension."""
    s = steps.agg(F.array_sort(F.collect_list(F.struct("threshold", "result"))).alias("s"))
    x = values.crossJoin(F.broadcast(s))  # one row
    return x.withColumn("result", F.array_max(F.filter("s", lambda e: e["threshold"] <= F.col(value)))["result"]).drop("s")


def round_up(value: Column, tiers: list[float]) -> Column:
    """The smallest tier at or over the value, else the value."""
    return F.coalesce(F.array_min(F.filter(F.array(*[F.lit(float(t)) for t in tiers]), lambda t: t >= value)), value)


def token_limit(context: Column, gigabytes: Column) -> Column:
    """M1: 80 % of the context, at most 2000 a GB, at least 4096."""
    return F.greatest(F.lit(4096).cast("long"), F.least(F.floor(context * 0.8).cast("long"), F.floor(gigabytes * 2000).cast("long")))


def fitting_models(models: DataFrame, gigabytes: float) -> DataFrame:
    """Models that fit, comfortable ones first, then by quality."""
    rank = F.when(F.col("quality") == "excellent", 0).when(F.col("quality") == "very good", 1).when(F.col("quality") == "good", 2).otherwise(3)
    return models.where(F.col("vram_min") <= gigabytes).withColumn("comfortable", F.col("vram_recommended") <= gigabytes).orderBy(F.col("comfortable").desc(), rank, "name")


def context_length(requests: DataFrame, models: DataFrame, default: int = 4096) -> DataFrame:
    """M3: by exact name, else by the first model (by name) with the same base before the colon, else the default."""
    base = lambda c: F.substring_index(c, ":", 1)
    exact = models.select(F.col("name").alias("model"), F.col("context_length").alias("_e"))
    near = models.groupBy(base(F.col("name")).alias("_base")).agg(F.min_by("context_length", "name").alias("_n"))
    x = requests.withColumn("_base", base(F.col("model"))).join(exact, "model", "left").join(near, "_base", "left")
    return x.withColumn("context_length", F.coalesce("_e", "_n", F.lit(default))).drop("_e", "_n", "_base")


def model_menu(installed: DataFrame, models: DataFrame, gigabytes: float) -> DataFrame:
    """Installed models first, then fitting ones whose name and base are not installed."""
    base = F.substring_index("name", ":", 1)
    own = installed.select("name").distinct().withColumn("base", base)
    known = own.join(models.select("name", "quality"), "name", "left").select("name", "base", "quality", F.lit(True).alias("installed"))
    rest = fitting_models(models, gigabytes).withColumn("base", base).join(own.select("name"), "name", "left_anti").join(own.select("base"), "base", "left_anti")
    return known.unionByName(rest.select("name", "base", "quality", F.lit(False).alias("installed")))
