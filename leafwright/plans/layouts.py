"""Queries over positioned blocks, whose coordinates follow from event keys by arithmetic (the same in the SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwright.operators import layout as L

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_X, _Y = "50.0 + 100 * (event_id % 16 % 3) + user_id % 5", "100.0 + 20 * (event_id % 16 // 3) + (user_id % 7) * 3"
_SQL = "b AS (SELECT event_id // 16 AS page, event_id % 16 AS block, 't' || event_id AS text, (" + _X + ")::DOUBLE AS x, (" + _Y + ")::DOUBLE AS y, (40 + user_id * 7 % 60)::DOUBLE AS width, 12.0::DOUBLE AS height FROM events)"


def _blocks(spark, d):
    """Sixteen events are a page."""
    block = F.col("event_id") % 16
    x = F.lit(50.0) + 100 * (block % 3) + F.col("user_id") % 5
    y = F.lit(100.0) + 20 * F.floor(block / 3) + (F.col("user_id") % 7) * 3
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.floor(F.col("event_id") / 16).alias("page"), block.alias("block"), F.concat(F.lit("t"), "event_id").alias("text"), x.cast("double").alias("x"), y.cast("double").alias("y"), (40 + F.col("user_id") * 7 % 60).cast("double").alias("width"), F.lit(12.0).alias("height"),
        F.when(block == 1, 14.0).otherwise(10.0).alias("font_size"), (block < 3).alias("is_bold"),
    )


def _bounds(low, size, gap):
    return f"d{low} AS (SELECT DISTINCT page, {low} FROM b), l{low} AS (SELECT page, {low}, lag({low}) OVER (PARTITION BY page ORDER BY {low}) AS p FROM d{low}), u{low} AS (SELECT page, ({low} + p) / 2 AS v FROM l{low} WHERE {low} - p > {gap} UNION SELECT page, min({low}) FROM b GROUP BY page UNION SELECT page, max({low} + {size}) FROM b GROUP BY page), g{low} AS (SELECT page, list(DISTINCT v ORDER BY v) AS boundaries FROM u{low} GROUP BY page)"


@query(f"WITH {_SQL}, {_bounds('x', 'width', 15)} FROM gx")
def column_boundaries(spark, d):
    """W6."""
    return L.boundaries(_blocks(spark, d), "x", "width", 15.0)


@query(f"WITH {_SQL}, {_bounds('y', 'height', 8)} FROM gy")
def row_boundaries(spark, d):
    """W7."""
    return L.boundaries(_blocks(spark, d), "y", "height", 8.0)


_SLOT = lambda v, b: f"(CASE WHEN len(list_filter({b}, lambda q: q <= {v})) IN (0, len({b})) THEN 0 ELSE len(list_filter({b}, lambda q: q <= {v})) - 1 END)"
_CELLS = f"WITH {_SQL}, {_bounds('x', 'width', 15)}, {_bounds('y', 'height', 8)}, t AS (SELECT b.*, {_SLOT('x + width / 2', 'gx.boundaries')} AS col, {_SLOT('y + height / 2', 'gy.boundaries')} AS row FROM b JOIN gx USING (page) JOIN gy USING (page))"


@query(_CELLS + " SELECT page, block, row::INTEGER AS row, col::INTEGER AS col FROM t")
def token_to_cell(spark, d):
    """J4."""
    b = _blocks(spark, d)
    c, r = L.boundaries(b, "x", "width", 15.0), L.boundaries(b, "y", "height", 8.0).withColumnRenamed("boundaries", "rb")
    t = b.join(c, "page").join(r, "page")
    return t.select("page", "block", L.slot(F.col("y") + F.col("height") / 2, F.col("rb")).alias("row"), L.slot(F.col("x") + F.col("width") / 2, F.col("boundaries")).alias("col"))


@query(_CELLS + ", c AS (SELECT page, row, col, string_agg(text, ' ' ORDER BY y, x, text) AS text, count(*) AS tokens FROM t GROUP BY ALL), r AS (SELECT gx.page, unnest(range(greatest(len(gy.boundaries) - 1, 1))) AS row, len(gx.boundaries) AS n FROM gx JOIN gy USING (page)), g AS (SELECT page, row, unnest(range(greatest(n - 1, 1))) AS col FROM r) SELECT page, row::INTEGER AS row, col::INTEGER AS col, coalesce(text, '') AS text, coalesce(tokens, 0) AS tokens FROM g LEFT JOIN c USING (page, row, col)")
def dense_grid(spark, d):
    """J4, L6, O4."""
    b = _blocks(spark, d)
    return L.stitch(b, L.boundaries(b, "x", "width", 15.0), L.boundaries(b, "y", "height", 8.0))


@query(f"WITH RECURSIVE {_SQL}, v AS (SELECT page, y, row_number() OVER (PARTITION BY page ORDER BY y) AS n FROM (SELECT DISTINCT page, y FROM b)), f(page, n, y, anchor, cluster) AS (SELECT page, n, y, y, 0 FROM v WHERE n = 1 UNION ALL SELECT v.page, v.n, v.y, CASE WHEN v.y - f.anchor > 8 THEN v.y ELSE f.anchor END, f.cluster + (v.y - f.anchor > 8)::INT FROM f JOIN v ON v.page = f.page AND v.n = f.n + 1) SELECT b.page, block, f.cluster::INTEGER AS cluster FROM b JOIN f ON f.page = b.page AND f.y = b.y")
def row_clusters_anchored(spark, d):
    """W4, W5, W11."""
    return L.anchored_clusters(_blocks(spark, d), "y", L.ROW_TOLERANCE).select("page", "block", "cluster")


@query(f"WITH {_SQL}, s AS (SELECT page, block % 2 AS bucket, x AS s, x + width AS e FROM b), m AS (SELECT *, max(e) OVER (PARTITION BY page, bucket ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s), i AS (SELECT *, sum(CASE WHEN s <= m + 3 THEN 0 ELSE 1 END) OVER (PARTITION BY page, bucket ORDER BY s, e) AS i FROM m) SELECT page, bucket, min(s) AS s, max(e) AS e, count(*) AS parts FROM i GROUP BY page, bucket, i")
def interval_union(spark, d):
    """W8, W9."""
    s = _blocks(spark, d).select("page", (F.col("block") % 2).alias("bucket"), F.col("x").alias("s"), (F.col("x") + F.col("width")).alias("e"))
    return L.interval_union(s, ["page", "bucket"])


@query(f"WITH {_SQL}, r AS (SELECT page, round_even(y, 0) AS ry, count(*) AS cells FROM b GROUP BY ALL HAVING count(*) >= 2), n AS (SELECT *, CASE WHEN ry - lag(ry) OVER (PARTITION BY page ORDER BY ry) < 30 THEN 0 ELSE 1 END AS n FROM r), t AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY ry)::BIGINT AS t FROM n) SELECT page, t AS \"table\", count(*) AS rows, sum(cells)::BIGINT AS cells, max(cells) AS cols, min(ry) AS y0, max(ry) AS y1 FROM t GROUP BY page, t HAVING count(*) >= 2")
def consecutive_row_tables(spark, d):
    """W10, M5."""
    return L.row_tables(_blocks(spark, d))


_BOX = "x AS (SELECT DISTINCT page, k AS box, 40.0 + 110 * k AS bx0, 160.0 + 110 * k AS bx1, 100.0 AS by0, 125.0 AS by1 FROM b, (VALUES (0), (1), (2)) v(k))"


def _boxes(spark, b):
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return b.select("page").distinct().select("page", k.alias("box")).select("page", "box", (40.0 + 110 * F.col("box")).alias("bx0"), (160.0 + 110 * F.col("box")).alias("bx1"), F.lit(100.0).alias("by0"), F.lit(125.0).alias("by1"))


@query(f"WITH {_SQL}, {_BOX} SELECT b.page, block, min(box)::INTEGER AS box FROM b JOIN x ON b.page = x.page AND b.x BETWEEN bx0 AND bx1 AND b.y BETWEEN by0 AND by1 GROUP BY ALL")
def points_in_boxes(spark, d):
    """J5."""
    b = _blocks(spark, d)
    return L.in_boxes(b, _boxes(spark, b))


@query(f"WITH {_SQL}, {_BOX} SELECT b.page, block FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE b.page = x.page AND b.x BETWEEN bx0 AND bx1 AND b.y BETWEEN by0 AND by1)")
def blocks_outside_tables(spark, d):
    """J13, X5."""
    b = _blocks(spark, d)
    return L.boxed_tables(b, _boxes(spark, b))[1].select("page", "block")


_IMAGES = "c AS (SELECT * FROM b WHERE block % 2 = 1), i AS (SELECT page, block AS image, x + width / 2 AS ix, y - 30 AS iy, height AS ih FROM b WHERE block % 2 = 0), s AS (SELECT c.page, c.block, i.image, abs(c.x + c.width / 2 - ix) AS dx, CASE WHEN c.y >= iy + ih THEN c.y - iy - ih WHEN iy >= c.y + c.height THEN iy - c.y - c.height ELSE 0.0 END AS gap FROM c JOIN i USING (page)), z AS (SELECT *, gap + CASE WHEN dx >= 50 THEN 1000.0 ELSE 0.0 END + 0.1::DOUBLE * dx AS score FROM s WHERE gap <= 100)"


def _figures(spark, d):
    b = _blocks(spark, d)
    return b.where("block % 2 = 1"), b.where("block % 2 = 0").select("page", F.col("block").alias("image"), "x", (F.col("y") - 30).alias("y"), "width", "height")


@query(f"WITH {_SQL}, {_IMAGES} SELECT page, block, arg_min(image, (score, image)) AS image, round(min(score), 6) AS score FROM z GROUP BY ALL")
def nearest_caption(spark, d):
    """J7."""
    return L.nearest_image(*_figures(spark, d)).withColumn("score", F.round("score", 6))


@query()
def anchored_captions(spark, d):
    """Rows only (greedy in caption order)."""
    return L.anchor_captions(*_figures(spark, d))


_TWO = "n AS (SELECT page, coalesce(count(*) FILTER (width < 216) >= 4 AND count(*) FILTER (l) >= 2 AND count(*) FILTER (r) >= 2 AND max(x + width) FILTER (l) < min(x) FILTER (r), false) AS two FROM (SELECT *, width < 216 AND x + width / 2 < 160 AS l, width < 216 AND x + width / 2 > 200 AS r FROM b) GROUP BY page)"
_LINES = "v AS (SELECT page, y, row_number() OVER (PARTITION BY page ORDER BY y) AS n FROM (SELECT DISTINCT page, y FROM b)), f(page, n, y, anchor, line) AS (SELECT page, n, y, y, 0 FROM v WHERE n = 1 UNION ALL SELECT v.page, v.n, v.y, CASE WHEN v.y - anchor > 6.0 THEN v.y ELSE anchor END, CASE WHEN v.y - anchor > 6.0 THEN line + 1 ELSE line END FROM f JOIN v ON v.page = f.page AND v.n = f.n + 1)"


@query(f"WITH RECURSIVE {_SQL}, {_TWO}, {_LINES}, k AS (SELECT b.*, two, CASE WHEN NOT two THEN line WHEN width >= 216 THEN 0 WHEN x + width / 2 < 180 THEN 1 ELSE 2 END AS k FROM b JOIN n USING (page) JOIN f USING (page, y)) SELECT page, block, (row_number() OVER (PARTITION BY page ORDER BY k, CASE WHEN two THEN y END, CASE WHEN NOT two THEN x END, CASE WHEN NOT two THEN y END, block) - 1)::INTEGER AS place FROM k")
def reading_order_two_column(spark, d):
    """L10, L12, O2, W11."""
    return L.reading_order(_blocks(spark, d), 360.0).select("page", "block", "place")


@query(f"WITH {_SQL}, g AS (SELECT page, max(x) - min(x) > 300 AS two, (max(x) + min(x)) / 2 AS mid FROM b GROUP BY page), k AS (SELECT b.*, CASE WHEN NOT two THEN 0 WHEN x < mid THEN 1 ELSE 2 END AS k FROM b JOIN g USING (page)) SELECT page, block, (row_number() OVER (PARTITION BY page ORDER BY k, y, x, block) - 1)::INTEGER AS place FROM k")
def reading_order_anchoring(spark, d):
    """O3."""
    return L.reading_order(_blocks(spark, d), 360.0, "anchoring").select("page", "block", "place")


@query(f"WITH {_SQL} SELECT page, round(avg(abs(block % 4)), 6) AS dx, round(avg(abs(block % 3 * 2)), 6) AS dy, round(avg((width + block % 2) / width), 6) AS width_ratio, bool_and(block % 2 = 0) AS same_sizes FROM b GROUP BY page")
def layout_drift(spark, d):
    """A15, J3b, L13."""
    b = _blocks(spark, d)
    moved = b.withColumns({"x": F.col("x") + F.col("block") % 4, "y": F.col("y") + F.col("block") % 3 * 2, "width": F.col("width") + F.col("block") % 2})
    return L.layout_drift(b, moved).withColumns({c: F.round(c, 6) for c in ("dx", "dy", "width_ratio")})


@query(f"WITH {_SQL} SELECT page, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1 FROM b GROUP BY page")
def bounding_boxes(spark, d):
    """A12."""
    return L.bounding_boxes(_blocks(spark, d), "page")


@query()
def detected_tables(spark, d):
    """Rows only (runs from every start row, with a fold)."""
    return L.detect_tables(_blocks(spark, d))


@query()
def merged_blocks(spark, d):
    """Rows only (the state is the merged box)."""
    return L.merge_adjacent(_blocks(spark, d))


@query()
def placed_blocks(spark, d):
    """Rows only (sequential)."""
    return L.place_blocks(_blocks(spark, d))


@query(f"WITH {_SQL}, e AS (SELECT page, x AS x0, y AS y0, x + width AS x1, y AS y1, width AS length, true AS h FROM b UNION ALL SELECT page, x, y + height, x + width, y + height, width, true FROM b UNION ALL SELECT page, x, y, x, y + height, height, false FROM b UNION ALL SELECT page, x + width, y, x + width, y + height, height, false FROM b) SELECT page, count(*) AS lines, count(*) FILTER (h) AS horizontal, sum(length) AS length FROM e WHERE length >= 10 GROUP BY page")
def ruling_line_counts(spark, d):
    """L5b, M4."""
    r = _blocks(spark, d).select("page", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"))
    return L.ruling_lines(r).groupBy("page").agg(F.count("*").alias("lines"), F.count_if("is_horizontal").alias("horizontal"), F.sum("length").alias("length"))
