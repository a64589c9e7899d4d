"""Queries on cache, jobs and progress, over documents and events. Times are fixed values, never the clock."""

from __future__ import annotations


from pyspark.sql import functions as F

from leafwright.functions import quality as Q
from leafwright.functions import rules as R
from leafwright.functions import text as T
from leafwright.operators import state as ST

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


_KEY = f"concat_ws(':', lang, 'any', left(sha256(lower({S.strip('text')})), 16))"
_REQUESTS = f"r AS (SELECT doc_id, lang, text, {_KEY} AS cache_key FROM documents), c AS (SELECT DISTINCT cache_key FROM r WHERE doc_id % 2 = 0)"


def _requests(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("lang").alias("language"), "text")
    return x.withColumn("cache_key", T.cache_key(F.col("text"), F.col("language")))


@query(f"WITH {_REQUESTS} SELECT doc_id, cache_key FROM r WHERE doc_id % 2 = 1 AND cache_key IN (FROM c)")
def dedup_cache_hits(spark, d):
    """Odd requests answered by what even ones have put into the cache."""
    r = _requests(spark, d)
    return ST.hits(r.where("doc_id % 2 = 1"), r.where("doc_id % 2 = 0").select("cache_key").distinct()).select("doc_id", "cache_key")


@query(f"WITH {_REQUESTS} SELECT doc_id, cache_key FROM r WHERE doc_id % 2 = 1 AND cache_key NOT IN (FROM c)")
def dedup_cache_misses(spark, d):
    """J2, the other side."""
    r = _requests(spark, d)
    return ST.misses(r.where("doc_id % 2 = 1"), r.where("doc_id % 2 = 0").select("cache_key").distinct()).select("doc_id", "cache_key")


_EV = "epoch(ts)::DOUBLE"
_CACHE = f"""e AS (SELECT event_id, user_id, event_type, value, {_EV} AS t FROM events),
k AS (SELECT concat('u', user_id, ':', event_type) AS cache_key, min(t) AS created_at, max(t) AS accessed_at, count(*) AS access_count, arg_max(event_id, t * 1e7 + event_id)::VARCHAR AS translated FROM e GROUP BY 1)"""
_CACHE = f"""e AS (SELECT event_id, user_id, event_type, value, {_EV} AS t FROM events),
k AS (SELECT concat('u', user_id, ':', event_type) AS cache_key, min(t) AS created_at, max(t) AS accessed_at, count(*) AS access_count, max(event_id)::VARCHAR AS translated FROM e GROUP BY 1)"""


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").withColumn("t", F.col("ts").cast("timestamp").cast("double"))


def _cache(spark, d):
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), "event_type")
    return _events(spark, d).groupBy(key.alias("cache_key")).agg(F.min("t").alias("created_at"), F.max("t").alias("accessed_at"), F.count("*").alias("access_count"), F.max("event_id").cast("string").alias("translated"))


@query(f"WITH {_CACHE} SELECT count(*) AS entries, sum(access_count - 1)::BIGINT AS hits, sum(length(translated))::BIGINT AS bytes, min(created_at) AS oldest, max(created_at) AS newest, round(sum(access_count - 1) / sum(access_count)::DOUBLE, 8) AS hit_rate FROM k")
def cache_stats(spark, d):
    """A7, M6."""
    return ST.cache_stats(_cache(spark, d)).withColumn("hit_rate", F.round("hit_rate", 8))


@query(f"WITH {_CACHE}, n AS (SELECT max(t) AS now FROM e) SELECT cache_key, created_at FROM k, n WHERE now - created_at <= 2160000")
def cache_ttl_live(spark, d):
    """T3 with 25 days, at the time of the last event."""
    now = _events(spark, d).agg(F.max("t").alias("now"))
    return _cache(spark, d).crossJoin(F.broadcast(now)).where("now - created_at <= 2160000").select("cache_key", "created_at")


@query(f"WITH {_CACHE}, n AS (SELECT *, row_number() OVER (ORDER BY accessed_at, cache_key) AS n, count(*) OVER () AS total FROM k) SELECT cache_key, accessed_at FROM n WHERE n > total // 5")
def cache_lru_evict(spark, d):
    """O9, T4."""
    return ST.evict(_cache(spark, d)).select("cache_key", "accessed_at")


@query(f"WITH {_CACHE}, f AS (SELECT concat('u', user_id, ':', event_type) AS cache_key, t AS created_at, event_id::VARCHAR AS translated, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t DESC, event_id::VARCHAR) AS n FROM e WHERE event_id % 3 = 0) SELECT k.cache_key, coalesce(f.created_at, k.created_at) AS created_at, coalesce(f.translated, k.translated) AS translated, CASE WHEN f.cache_key IS NULL THEN access_count ELSE 1 END AS access_count FROM k LEFT JOIN (FROM f WHERE n = 1) f USING (cache_key)")
def cache_upsert_latest(spark, d):
    """Every third event is a fresh answer."""
    e = _events(spark, d).where("event_id % 3 = 0")
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), "event_type")
    fresh = e.select(key.alias("cache_key"), F.col("t").alias("created_at"), F.col("t").alias("accessed_at"), F.col("event_id").cast("string").alias("translated"))
    return ST.upsert(_cache(spark, d), fresh).select("cache_key", "created_at", "translated", "access_count")


@query(f"WITH {_CACHE}, a AS (SELECT concat('u', user_id, ':', event_type) AS cache_key, count(*) AS n FROM e WHERE event_id % 5 = 0 GROUP BY 1) SELECT cache_key, access_count + coalesce(n, 0) AS access_count, accessed_at FROM k LEFT JOIN a USING (cache_key)")
def cache_touch(spark, d):
    """T2."""
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), "event_type")
    log = _events(spark, d).where("event_id % 5 = 0").select(key.alias("cache_key"), F.col("t").alias("ts"))
    return ST.touch(_cache(spark, d), log).select("cache_key", "access_count", "accessed_at")


_JOBS = "j AS (SELECT event_id AS seq, user_id, (event_id % 4)::INT AS priority, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'pending' ELSE 'completed' END AS status, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS quality FROM events)"


def _jobs(spark, d):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "pending").otherwise("completed")
    quality = F.when(F.col("event_id") % 3 == 0, F.lit(0.0)).otherwise(F.col("value"))
    return _events(spark, d).select(F.col("event_id").alias("seq"), "user_id", (F.col("event_id") % 4).cast("int").alias("priority"), status.alias("status"), quality.alias("quality"))


@query(f"WITH {_JOBS} SELECT user_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS cancelled, round(100.0::DOUBLE * count(*) FILTER (status = 'completed') / count(*), 6) AS success_rate, round(coalesce(avg(nullif(quality, 0)), 0), 6) AS avg_quality FROM j GROUP BY user_id")
def job_summary(spark, d):
    """A6, A6b, T9."""
    return ST.job_summary(_jobs(spark, d), "user_id").withColumns({c: F.round(c, 6) for c in ("success_rate", "avg_quality")})


@query(f"WITH {_JOBS} SELECT seq, user_id, priority FROM j WHERE status = 'pending' ORDER BY priority DESC, seq LIMIT 50")
def job_priority_queue(spark, d):
    """A report of the next fifty jobs; job_queue_ranked is the whole queue."""
    return ST.job_queue(ST.resumable(_jobs(spark, d))).select("seq", "user_id", "priority").limit(50)


@query(f"WITH {_JOBS} SELECT seq, user_id, priority, row_number() OVER (ORDER BY priority DESC, seq) AS rank FROM j WHERE status IN ('pending', 'running')")
def job_queue_ranked(spark, d):
    """Every job that waits or runs, with its place."""
    return ST.ranked_queue(ST.resumable(_jobs(spark, d)).select("seq", "user_id", "priority"))


@query("""WITH p AS (SELECT user_id, count(*) AS done, (user_id % 50) + 200 AS total, sum(value) AS elapsed FROM events GROUP BY user_id)
SELECT user_id, done, round(elapsed / done, 6) AS mean, round(CASE WHEN elapsed > 0 THEN 60.0::DOUBLE * done / elapsed ELSE 0 END, 6) AS per_minute, total - done AS remaining, round(elapsed / done * (total - done), 4) AS eta, round(100.0::DOUBLE * done / total, 6) AS percent,
  CASE WHEN done % 3 = 0 THEN 95.0::DOUBLE WHEN done % 3 = 1 THEN round(10 + 70.0::DOUBLE * (done / total::DOUBLE), 6) ELSE 100.0::DOUBLE END AS overall FROM p""")
def progress_rate_eta(spark, d):
    """A user is a job, an event is a page and its value the seconds it took."""
    p = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("done"), F.sum("value").alias("elapsed")).withColumn("total", F.col("user_id") % 50 + 200)
    x = p.withColumn("r", ST.rate_and_eta(F.col("done"), F.col("total"), F.col("elapsed")))
    phase = F.when(F.col("done") % 3 == 0, "layout").when(F.col("done") % 3 == 1, "translation").otherwise("complete")
    overall = F.round(ST.overall_progress(phase, F.col("done"), F.col("total")), 6)
    return x.select("user_id", "done", F.round("r.mean", 6).alias("mean"), F.round("r.per_minute", 6).alias("per_minute"), F.col("r.remaining").alias("remaining"), F.round("r.eta", 4).alias("eta"), F.round("r.percent", 6).alias("percent"), overall.alias("overall"))


@query("""WITH n AS (SELECT user_id, event_id, value, row_number() OVER w AS n, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT user_id, avg(value) AS h FROM n WHERE n <= 3 GROUP BY user_id), b AS (SELECT n.*, CASE WHEN n >= 6 THEN p ELSE h END AS base FROM n JOIN h USING (user_id))
SELECT user_id, event_id, CASE WHEN n < 3 THEN '→' WHEN l < base * 0.9 THEN '↑' WHEN l > base * 1.1 THEN '↓' ELSE '→' END AS trend FROM b""")
def speed_trend(spark, d):
    """W13."""
    return ST.speed_trend(_events(spark, d), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "trend")


_MESSAGE = "concat(CASE (event_id % 9)::INT WHEN 0 THEN 'Request timed out' WHEN 1 THEN 'HTTP 429' WHEN 2 THEN 'Service busy' WHEN 3 THEN 'Connection refused' WHEN 4 THEN 'error 502' WHEN 5 THEN 'prompt too long' WHEN 6 THEN 'Bad request' WHEN 7 THEN 'Forbidden' ELSE 'odd' END, ' at step')"


def _sql_class() -> str:
    low = f"lower({_MESSAGE})"
    return "CASE " + " ".join(f"WHEN {S.any_of(low, w)} THEN {S.lit(n + ':' + str(r).lower())}" for n, r, w in R.ERROR_CLASSES) + " ELSE 'unknown:false' END"


@query(f"SELECT event_id, split_part({_sql_class()}, ':', 1) AS error_type, split_part({_sql_class()}, ':', 2) = 'true' AS retryable, least(1.0::DOUBLE * 2.0::DOUBLE ** (event_id % 8), 60.0::DOUBLE) AS delay FROM events WHERE event_type = 'error'")
def error_classes(spark, d):
    """Q23, Q24."""
    x = _events(spark, d).where("event_type = 'error'").withColumn("c", Q.error_class(F.expr(_MESSAGE)))
    return x.select("event_id", "c.error_type", "c.retryable", Q.retry_delay((F.col("event_id") % 8).cast("double")).alias("delay"))


@query("""WITH v AS (SELECT event_id, (event_id % 70)::DOUBLE / 2 AS gb FROM events), s(threshold, result) AS (VALUES (4.0::DOUBLE, 4096), (8.0::DOUBLE, 16384), (16.0::DOUBLE, 65536), (32.0::DOUBLE, 131072))
SELECT event_id, gb, (SELECT max_by(result, threshold) FROM s WHERE threshold <= gb)::INTEGER AS result, greatest(4096, least(floor(8192 * (1 + event_id % 16) * 0.8)::BIGINT, floor(gb * 2000)::BIGINT)) AS tokens FROM v""")
def model_capacity_steps(spark, d):
    """M1, M2."""
    v = _events(spark, d).select("event_id", ((F.col("event_id") % 70).cast("double") / 2).alias("gb"))
    steps = spark.createDataFrame([(4.0, 4096), (8.0, 16384), (16.0, 65536), (32.0, 131072)], "threshold double, result int")
    return ST.step_lookup(v, steps, "gb").select("event_id", "gb", "result", ST.token_limit(8192 * (1 + F.col("event_id") % 16), F.col("gb")).alias("tokens"))


@query("SELECT event_id, coalesce((SELECT min(t) FROM (VALUES (4.0::DOUBLE), (6.0), (8.0), (12.0), (16.0), (24.0)) x(t) WHERE t >= (event_id % 60)::DOUBLE / 2), (event_id % 60)::DOUBLE / 2) AS tier FROM events")
def tier_round_up(spark, d):
    """M14."""
    return _events(spark, d).select("event_id", ST.round_up((F.col("event_id") % 60).cast("double") / 2, [4, 6, 8, 12, 16, 24]).alias("tier"))


_MODELS = [("alpha:7b", 5.0, 8.0, 8192, "good"), ("alpha:70b", 40.0, 48.0, 32768, "excellent"), ("beta:3b", 3.0, 4.0, 4096, "basic"), ("gamma:13b", 9.0, 12.0, 16384, "very good")]
_MODELS_SQL = "m(name, vram_min, vram_recommended, context_length, quality) AS (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c}, '{q}')" for n, a, b, c, q in _MODELS) + ")"


@query(f"WITH {_MODELS_SQL}, r AS (SELECT event_id, ['alpha:7b', 'alpha:13b', 'delta:1b', 'gamma:13b'][event_id % 4 + 1] AS model FROM events) SELECT event_id, model, coalesce((SELECT context_length FROM m WHERE name = model), (SELECT min_by(context_length, name) FROM m WHERE split_part(name, ':', 1) = split_part(model, ':', 1)), 4096)::INTEGER AS context_length FROM r")
def context_lengths(spark, d):
    """M3."""
    m = spark.createDataFrame(_MODELS, "name string, vram_min double, vram_recommended double, context_length int, quality string")
    r = _events(spark, d).select("event_id", F.element_at(F.array(*[F.lit(x) for x in ("alpha:7b", "alpha:13b", "delta:1b", "gamma:13b")]), (F.col("event_id") % 4 + 1).cast("int")).alias("model"))
    return ST.context_length(r, m).select("event_id", "model", "context_length")


@query(f"WITH {_MODELS_SQL} SELECT * FROM (VALUES ('alpha:13b', 'alpha', NULL, true), ('beta:3b', 'beta', 'basic', true), ('gamma:13b', 'gamma', 'very good', false)) x(name, base, quality, installed)")
def model_menu(spark, d):
    """J20, J16, P21."""
    m = spark.createDataFrame(_MODELS, "name string, vram_min double, vram_recommended double, context_length int, quality string")
    return ST.model_menu(spark.createDataFrame([("alpha:13b",), ("beta:3b",)], "name string"), m, 12.0)


@query("""WITH x AS (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS last_event, max(ts) AS last_ts, count(*) AS events FROM events GROUP BY ALL) SELECT user_id, event_type, last_event, events FROM x""")
def latest_block_state(spark, d):
    """The last event of each user and kind."""
    e = _events(spark, d).withColumn("event", F.col("event_id"))
    return ST.latest_state(e, "user_id", "event_type").select("user_id", "event_type", F.col("state").alias("last_event"), "events")


@query("""WITH b AS (SELECT user_id AS job_id, (event_id % 5)::INT AS page, event_id AS block, value > 50 AS is_complete FROM events)
SELECT job_id, page, count(*) AS blocks, count(*) FILTER (is_complete) AS complete, round(100.0::DOUBLE * count(*) FILTER (is_complete) / count(*), 6) AS percent, coalesce(list(block ORDER BY block) FILTER (NOT is_complete), []) AS to_do FROM b GROUP BY ALL""")
def resume_points(spark, d):
    """A24, J18, P25."""
    b = _events(spark, d).select(F.col("user_id").alias("job_id"), (F.col("event_id") % 5).cast("int").alias("page"), F.col("event_id").alias("block"), (F.col("value") > 50).alias("is_complete"))
    return ST.page_progress(b).withColumn("percent", F.round("percent", 6))


@query("SELECT 'L' || event_id % 3 AS level, count(*) AS lines, min('m' || event_id) AS first FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def log_levels(spark, d):
    """Derived log lines; every seventh has too few parts."""
    line = F.when(F.col("event_id") % 7 == 0, F.lit("no parts")).otherwise(F.concat(F.lit("t | L"), (F.col("event_id") % 3).cast("string"), F.lit(" | mod | m"), F.col("event_id").cast("string")))
    return ST.log_summary(_events(spark, d).select(line.alias("value")))


@query("""SELECT event_type, count(*) AS events, sum(CASE WHEN s < 0 THEN 0 WHEN s < 60 THEN 1 ELSE 0 END)::BIGINT AS under_minute, min(CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' END) AS least_text FROM (SELECT event_type, (event_id * 37) % 9000 AS s FROM events) GROUP BY event_type""")
def durations(spark, d):
    """I34."""
    x = _events(spark, d).select("event_type", ((F.col("event_id") * 37) % 9000).alias("s")).withColumn("f", T.format_duration(F.col("s")))
    return x.groupBy("event_type").agg(F.count("*").alias("events"), F.sum((F.col("s") < 60).cast("long")).alias("under_minute"), F.min("f").alias("least_text"))
