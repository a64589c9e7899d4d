"""Positioned blocks: W4-W12, J4-J8, J13, J14, L1-L18, O2-O4, A10-A12, A15, X5.

Blocks are rows (page, block, text, x, y, width, height, font_size, is_bold). Sets of positions of one page are small; whole pages
are never joined with each other. Folds with state run over one page's sorted array, or over its rows gathered by page.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.functions.batches import cut

#: Rows of pages that a worker holds as Python objects at once.
PIECE_ROWS = 4096
#: Tolerances in points.
COLUMN_TOLERANCE, ROW_TOLERANCE, CAPTION_GAP, FAR_PENALTY = 8.0, 8.0, 100.0, 1000.0


def by_page(rows: DataFrame, columns: list[str], f, schema: str) -> DataFrame:
    """f(page, rows as dicts) -> tuples, over each page's rows gathered to one array: many pages go to Python in one Arrow batch,
    of which some thousand rows at a time become Python objects. A page's blocks are few; pages are spread over all tasks."""
    g = rows.groupBy("page").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    out = g.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        for batch in (b.slice(*at) for b in batches for at in cut(pc.list_value_length(b.column(1)), PIECE_ROWS)):
            made = [r for page, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in f(page, own)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k.type) for i, k in enumerate(kinds)], names=kinds.names)

    return g.mapInArrow(run, out)


def with_defaults(blocks: DataFrame) -> DataFrame:
    """Missing sizes get their defaults; edges and centres as columns (M4)."""
    w, h = F.coalesce("width", F.lit(100.0)), F.coalesce("height", F.lit(20.0))
    x = blocks.withColumns({"width": w, "height": h, "font_size": F.coalesce("font_size", F.lit(10.0))})
    return x.withColumns({"x1": F.col("x") + F.col("width"), "y1": F.col("y") + F.col("height"), "cx": F.col("x") + F.col("width") / 2, "cy": F.col("y") + F.col("height") / 2})


def anchored_clusters(blocks: DataFrame, value: str, tolerance: float | Column, group: str = "page") -> DataFrame:
    """Values in order; a new cluster where one is over tolerance from the first of its cluster. Adds cluster (from
    0). A fold over the distinct values of a page, not a gap rule. A tolerance of each page is an aggregate of its blocks."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("n"), F.array().cast("array<struct<v:double,cluster:int>>").alias("out"))

    def step(a, v):
        fresh = a["anchor"].isNull() | (v - a["anchor"] > F.col("_most"))
        n = F.when(fresh, a["n"] + 1).otherwise(a["n"])
        return F.struct(F.when(fresh, v).otherwise(a["anchor"]).alias("anchor"), n.alias("n"), F.array_append(a["out"], F.struct(v.alias("v"), n.alias("cluster"))).alias("out"))

    most = tolerance if isinstance(tolerance, Column) else F.max(F.lit(float(tolerance)))
    values = blocks.groupBy(group).agg(F.array_sort(F.collect_set(F.col(value).cast("double"))).alias("vs"), most.alias("_most"))
    found = values.select(group, F.explode(F.aggregate("vs", start, step)["out"]).alias("e")).select(group, F.col("e.v").alias(value), F.col("e.cluster").alias("cluster"))
    return blocks.withColumn(value, F.col(value).cast("double")).join(found, [group, value])


def boundaries(blocks: DataFrame, low: str, size: str, gap: float, group: str = "page") -> DataFrame:
    """Midpoints between distinct positions over gap apart, with the least position and the greatest end."""
    w = Window.partitionBy(group).orderBy(low)
    d = blocks.select(group, low).distinct().withColumn("_p", F.lag(low).over(w))
    cuts = d.where(F.col(low) - F.col("_p") > gap).select(group, ((F.col(low) + F.col("_p")) / 2).alias("b"))
    ends = blocks.groupBy(group).agg(F.min(low).alias("lo"), F.max(F.col(low) + F.col(size)).alias("hi")).select(group, F.explode(F.array("lo", "hi")).alias("b"))
    return cuts.union(ends).groupBy(group).agg(F.array_sort(F.collect_set("b")).alias("boundaries"))


def ruling_lines(rects: DataFrame, least: float = 10.0, degrees: float = 5.0) -> DataFrame:
    """The four edges of each rectangle (x0, y0, x1, y1), those of length least and nearly straight, with their direction."""
    edge = lambda a, b, c, d: F.struct(F.col(a).alias("x0"), F.col(b).alias("y0"), F.col(c).alias("x1"), F.col(d).alias("y1"))
    e = rects.select("page", F.explode(F.array(edge("x0", "y0", "x1", "y0"), edge("x0", "y1", "x1", "y1"), edge("x0", "y0", "x0", "y1"), edge("x1", "y0", "x1", "y1"))).alias("e")).select("page", "e.*")
    angle = F.abs(F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))))
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    flat = (angle <= degrees) | (angle >= 180 - degrees)
    return e.withColumns({"length": length, "is_horizontal": flat, "_up": F.abs(angle - 90) <= degrees}).where((F.col("length") >= least) & (F.col("is_horizontal") | F.col("_up"))).drop("_up")


def interval_union(segments: DataFrame, keys: list[str], slack: float = 3.0) -> DataFrame:
    """Segments (s, e) of each key merged where the next begins within slack of the end so far."""
    w = Window.partitionBy(*keys).orderBy("s", "e")
    x = segments.withColumn("_m", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_i", F.sum(F.when(F.col("s") <= F.col("_m") + slack, 0).otherwise(1)).over(w))
    return x.groupBy(*keys, "_i").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("parts")).drop("_i")


def collinear(lines: DataFrame) -> DataFrame:
    """Ruling lines of one direction whose position falls into one 3-point bucket, merged along their length."""
    flat = F.col("is_horizontal")
    p = F.when(flat, F.col("y0")).otherwise(F.col("x0"))
    s = lines.select("page", "is_horizontal", F.floor(p / 3).alias("bucket"), F.when(flat, F.least("x0", "x1")).otherwise(F.least("y0", "y1")).alias("s"), F.when(flat, F.greatest("x0", "x1")).otherwise(F.greatest("y0", "y1")).alias("e"))
    return interval_union(s, ["page", "is_horizontal", "bucket"])


def row_tables(blocks: DataFrame, gap: float = 30.0) -> DataFrame:
    """Rows by half-even rounded y with two cells or more; rows under gap apart form a table of two rows or more."""
    rows = blocks.withColumn("ry", F.bround("y", 0)).groupBy("page", "ry").agg(F.count("*").alias("cells")).where("cells >= 2")
    w = Window.partitionBy("page").orderBy("ry")
    x = rows.withColumn("_new", F.when(F.col("ry") - F.lag("ry").over(w) < gap, 0).otherwise(1)).withColumn("table", F.sum("_new").over(w))
    return x.groupBy("page", "table").agg(F.count("*").alias("rows"), F.sum("cells").alias("cells"), F.max("cells").alias("cols"), F.min("ry").alias("y0"), F.max("ry").alias("y1")).where("rows >= 2")


def slot(value: Column, bounds: Column) -> Column:
    """Index i with bounds[i] <= value < bounds[i + 1]; 0 if there is none."""
    n = F.size(F.filter(bounds, lambda b: b <= value))
    return F.when((n == 0) | (n >= F.size(bounds)), F.lit(0)).otherwise(n - 1)


def stitch(tokens: DataFrame, cols: DataFrame, rows: DataFrame) -> DataFrame:
    """Tokens to cells by their centre; texts in reading order, every cell of the grid present."""
    t = tokens.join(cols.select("page", F.col("boundaries").alias("cb")), "page").join(rows.select("page", F.col("boundaries").alias("rb")), "page")
    t = t.withColumns({"col": slot(F.col("x") + F.col("width") / 2, F.col("cb")), "row": slot(F.col("y") + F.col("height") / 2, F.col("rb"))})
    cells = t.groupBy("page", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda s: s["text"]), " ").alias("text"), F.count("*").alias("tokens"))
    size = cols.join(rows.withColumnRenamed("boundaries", "rb"), "page").select("page", F.greatest(F.size("rb") - 1, F.lit(1)).alias("r"), F.greatest(F.size("boundaries") - 1, F.lit(1)).alias("c"))
    grid = size.select("page", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("row"), "c").select("page", "row", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("col"))
    return grid.join(cells, ["page", "row", "col"], "left").select("page", "row", "col", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def merge_cell_text(tokens: DataFrame) -> DataFrame:
    """A cell's tokens in reading order, without a blank where a number goes on with a sign or digits."""
    w = Window.partitionBy("page", "row", "col").orderBy("y", "x")
    goes_on = F.lag("text").over(w).rlike(r"[0-9.,^]$") & F.col("text").rlike(r"^[0-9.,^%]")
    x = tokens.withColumn("_t", F.concat(F.when(F.lag("text").over(w).isNull() | goes_on, F.lit("")).otherwise(F.lit(" ")), "text"))
    return x.groupBy("page", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "_t"))), lambda s: s["_t"]), "").alias("text"))


def in_boxes(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Blocks whose origin lies in a box of their page (closed); the first box (by number) takes a block."""
    j = blocks.join(boxes, "page").where(F.col("x").between(F.col("bx0"), F.col("bx1")) & F.col("y").between(F.col("by0"), F.col("by1")))
    return j.groupBy("page", "block").agg(F.min("box").alias("box"))


def boxed_tables(blocks: DataFrame, boxes: DataFrame, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """Boxes that hold four blocks or more, and the blocks left over (any box consumes its blocks)."""
    taken = in_boxes(blocks, boxes)
    return taken.groupBy("page", "box").agg(F.count("*").alias("blocks")).where(F.col("blocks") >= least), blocks.join(taken, ["page", "block"], "left_anti")


def first_within(blocks: DataFrame, positions: DataFrame, value: str, tolerance: float) -> DataFrame:
    """The first position (idx) of the page within tolerance."""
    j = blocks.join(positions, "page").where(F.abs(F.col(value) - F.col("position")) <= tolerance)
    return j.groupBy("page", "block").agg(F.min("idx").alias("idx"))


def table_caption(tables: DataFrame, captions: DataFrame, gap: float = 50.0) -> DataFrame:
    """The first caption (block order) within gap above or below a table."""
    j = tables.join(captions.select("page", F.col("block").alias("cblock"), F.col("y").alias("cy"), F.col("text").alias("caption")), "page")
    j = j.where(((F.col("y0") - F.col("cy")).between(0, gap)) | ((F.col("cy") - F.col("y1")).between(0, gap)))
    return j.groupBy("page", "table").agg(F.min_by("caption", "cblock").alias("caption"))


def caption_score(cx: Column, cy: Column, ch: Column, ix: Column, iy: Column, ih: Column) -> Column:
    """Vertical gap, 1000 more if the centres are 50 or more apart, and a tenth of that distance; null over 100."""
    gap = F.when(cy >= iy + ih, cy - iy - ih).when(iy >= cy + ch, iy - cy - ch).otherwise(F.lit(0.0))
    dx = F.abs(cx - ix)
    return F.when(gap <= CAPTION_GAP, gap + F.when(dx >= 50, FAR_PENALTY).otherwise(0.0) + 0.1 * dx)


def nearest_image(captions: DataFrame, images: DataFrame) -> DataFrame:
    """J7 without exclusion: each caption's best image of its page; ties go to the first image."""
    i = images.select("page", "image", (F.col("x") + F.col("width") / 2).alias("ix"), F.col("y").alias("iy"), F.col("height").alias("ih"))
    j = captions.join(i, "page").withColumn("score", caption_score(F.col("x") + F.col("width") / 2, F.col("y"), F.col("height"), F.col("ix"), F.col("iy"), F.col("ih"))).where("score is not null")
    return j.groupBy("page", "block").agg(F.min_by("image", F.struct("score", "image")).alias("image"), F.min("score").alias("score"))


def anchor_captions(captions: DataFrame, images: DataFrame) -> DataFrame:
    """Captions in order take the best image that is still free; images without a caption stay. Rows page, image, block."""
    scored = (
        captions.select("page", "block", "x", "y", "width", "height")
        .join(images.select("page", "image", (F.col("x") + F.col("width") / 2).alias("ix"), F.col("y").alias("iy"), F.col("height").alias("ih")), "page")
        .withColumn("score", caption_score(F.col("x") + F.col("width") / 2, F.col("y"), F.col("height"), F.col("ix"), F.col("iy"), F.col("ih")))
        .where("score is not null").select("page", "block", "image", "score")
    )

    def greedy(page, rows):
        used: set = set()
        for block, group in groupby(sorted(rows, key=lambda r: (r["block"], r["score"], r["image"])), key=lambda r: r["block"]):
            image = next((r["image"] for r in group if r["image"] not in used), None)
            if image is not None:
                used.add(image)
                yield page, image, block

    won = by_page(scored, ["block", "image", "score"], greedy, "page long, image long, block long")
    return images.select("page", "image").join(won, ["page", "image"], "left")


def is_two_column(blocks: DataFrame, page_width: float, mode: str = "unified") -> DataFrame:
    """L10 (unified: of the blocks under 60 % of the width, at least four, two a side by their centres, 20 points off the middle, with a
    gap between the sides) and L11 (layout: at least four blocks, over three a side by their centres, off the middle by a fifth)."""
    mid, centre = page_width / 2, F.col("x") + F.col("width") / 2
    if mode == "layout":
        g = blocks.groupBy("page").agg(F.count("*").alias("n"), F.count_if(centre < 0.8 * mid).alias("l"), F.count_if(centre > 1.2 * mid).alias("r"))
        return g.select("page", ((F.col("n") >= 4) & (F.col("l") > 3) & (F.col("r") > 3)).alias("two_columns"))
    narrow = F.col("width") < 0.6 * page_width
    left, right = narrow & (centre < mid - 20), narrow & (centre > mid + 20)
    g = blocks.groupBy("page").agg(F.count_if(narrow).alias("n"), F.count_if(left).alias("l"), F.count_if(right).alias("r"), F.max(F.when(left, F.col("x") + F.col("width"))).alias("le"), F.min(F.when(right, F.col("x"))).alias("rs"))
    return g.select("page", F.coalesce((F.col("n") >= 4) & (F.col("l") >= 2) & (F.col("r") >= 2) & (F.col("le") < F.col("rs")), F.lit(False)).alias("two_columns"))


def assign_column(x: Column, width: Column, page_width: float) -> Column:
    """0 for a wide block, else 1 or 2 by its centre."""
    return F.when(width >= 0.6 * page_width, 0).when(x + width / 2 < page_width / 2, 1).otherwise(2)


def reading_order(blocks: DataFrame, page_width: float, mode: str = "unified") -> DataFrame:
    """O2, O3: place of each block: on two-column pages wide ones, left, right, each by y; else by line (W11: tops within half the page's
    mean height of the line's first) and x. mode anchoring takes pages whose x spread is over 300 as two columns cut at the
    middle of the spread, and y and x without lines."""
    if mode == "anchoring":
        g = blocks.groupBy("page").agg((F.max("x") - F.min("x") > 300).alias("two_columns"), ((F.max("x") + F.min("x")) / 2).alias("_mid"))
        x = blocks.join(g, "page")
        key = F.when(~F.col("two_columns"), 0).when(F.col("x") < F.col("_mid"), 1).otherwise(2)
        order = ["_k", "y", "x", "block"]
    else:
        x = anchored_clusters(blocks, "y", F.avg("height") * 0.5).join(is_two_column(blocks, page_width), "page")
        two = F.col("two_columns")
        key = F.when(two, assign_column(F.col("x"), F.col("width"), page_width)).otherwise(F.col("cluster"))
        order = ["_k", F.when(two, F.col("y")), F.when(~two, F.col("x")), F.when(~two, F.col("y")), "block"]
    w = Window.partitionBy("page").orderBy(*order)
    return x.withColumn("_k", key).withColumn("place", F.row_number().over(w) - 1).drop("_k", "two_columns", "_mid", "cluster")


def line_heights(lines: DataFrame, group: str = "page") -> DataFrame:
    """The distance of each line's top from that of the line before; null for the first."""
    return lines.withColumn("line_height", F.col("y") - F.lag("y").over(Window.partitionBy(group).orderBy("y", "block")))


def is_heading_block(text: Column, font_size: Column, is_bold: Column) -> Column:
    """P5: large and bold, or a number before a word."""
    return F.coalesce((font_size > 12) & is_bold, F.lit(False)) | text.rlike(r"^[0-9]+\.?\s+[0-9A-Za-z_]")


def scaled_font(size: Column, before: Column, after: Column) -> Column:
    """Size over the root of the length ratio, at least 6 and 70 %; unchanged if the text is not longer."""
    r = after / before
    return F.when((before == 0) | (r <= 1), size).otherwise(F.greatest(size / F.sqrt(r), F.greatest(F.lit(6.0), 0.7 * size)))


def text_width(text: Column, size: Column) -> Column:
    """L16."""
    return F.length(text) * size * 0.5


def text_height(text: Column, size: Column, width: Column) -> Column:
    """Wrapped lines of each line of text, 1.3 of the font size each, and 8."""
    lines = F.aggregate(F.split(text, "\n"), F.lit(0.0), lambda a, t: a + F.greatest(F.lit(1.0), F.ceil(F.length(t) * size * 0.5 / width)))
    return lines * 1.3 * size + 8


def place_blocks(blocks: DataFrame, step: float = 5.0, tries: int = 50) -> DataFrame:
    """From the top, a block that overlaps a placed one moves down below it, 50 times at most."""

    def run(page, rows):
        placed: list = []
        for r in sorted(rows, key=lambda r: (r["y"], r["x"], r["block"])):
            y = r["y"]
            for _ in range(tries):
                hit = [b for b in placed if r["x"] < b[2] and r["x"] + r["width"] > b[0] and y < b[3] and y + r["height"] > b[1]]
                if not hit:
                    break
                y = max(b[3] for b in hit) + step
            placed.append((r["x"], y, r["x"] + r["width"], y + r["height"]))
            yield page, r["block"], y

    return by_page(blocks, ["block", "x", "y", "width", "height"], run, "page long, block long, new_y double")


def merge_adjacent(blocks: DataFrame, dy: float = 5.0, gap: float = 50.0, dsize: float = 2.0) -> DataFrame:
    """In (y, x) order a block joins the one before if on its line, near and of like size; the union box is the state."""

    def run(page, rows):
        out: list = []
        for r in sorted(rows, key=lambda r: (r["y"], r["x"], r["block"])):
            p = out[-1] if out else None
            if p and abs(r["y"] - p[3]) < dy and r["x"] - p[4] < gap and abs(r["font_size"] - p[6]) < dsize:
                p[1], p[3], p[4], p[5] = f"{p[1]} {r['text']}", min(p[3], r["y"]), max(p[4], r["x"] + r["width"]), max(p[5], r["y"] + r["height"])
            else:
                out.append([page, r["text"], r["x"], r["y"], r["x"] + r["width"], r["y"] + r["height"], r["font_size"]])
        return out

    return by_page(blocks, ["block", "text", "x", "y", "width", "height", "font_size"], run, "page long, text string, x0 double, y0 double, x1 double, y1 double, font_size double")


def layout_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean shifts of blocks of one place and whether sizes are the same."""
    b = after.select("page", "block", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("width").alias("bw"), F.col("height").alias("bh"))
    j = before.join(b, ["page", "block"])
    return j.groupBy("page").agg(F.avg(F.abs(F.col("x") - F.col("bx"))).alias("dx"), F.avg(F.abs(F.col("y") - F.col("by"))).alias("dy"), F.avg(F.col("bw") / F.col("width")).alias("width_ratio"), F.every((F.col("bw") == F.col("width")) & (F.col("bh") == F.col("height"))).alias("same_sizes"))


def bounding_boxes(blocks: DataFrame, *keys: str) -> DataFrame:
    """A12."""
    return blocks.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"))


def detect_tables(blocks: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Rows of a page by anchored y; runs of at most 20 rows with two blocks or more from every start row;
    consistent ones with four blocks and a fill of half or more are tables, with confidence. Overlapping runs all stay."""
    def anchors(values):
        out: list[float] = []
        for v in sorted(values):
            if not out or v - out[-1] > tolerance:
                out.append(v)
        return out

    def at(marks, v):
        return max(i for i, a in enumerate(marks) if a <= v)

    def run(page, blocks):
        ys = anchors(b["y"] for b in blocks)
        rows = defaultdict(list)
        for b in blocks:
            rows[at(ys, b["y"])].append(b)
        for start in range(len(ys)):
            region = []
            for i in range(start, min(len(ys), start + 20)):
                if len(rows[i]) < 2:
                    break
                region.append(rows[i])
            sizes = [len(r) for r in region]
            n = sum(sizes)
            if len(region) < 2 or n < 4 or max(sizes) - min(sizes) > max(2, 0.5 * n / len(region)):
                continue
            xs = anchors(b["x"] for r in region for b in r)
            cells = {(i, at(xs, b["x"])) for i, r in enumerate(region) for b in r}
            head, body = region[0], [b for r in region[1:] for b in r]
            mean = lambda g: sum(b["font_size"] for b in g) / len(g)
            header = all(b["is_bold"] for b in head) or abs(mean(head) - mean(body)) > 1 or len(head) > len(body) / len(region[1:])
            fill = len(cells) / (len(region) * len(xs))
            confidence = min(1.0, fill + 0.1 * header + 0.05 * (len(region) >= 3))
            if confidence >= 0.6:
                yield page, start, len(region), len(xs), n, header, confidence

    return by_page(blocks, ["block", "x", "y", "font_size", "is_bold"], run, "page long, start_row long, rows long, cols long, blocks long, has_header boolean, confidence double")


def page_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pages whose texts differ, missing ones too."""
    return a.select("page", F.col("text").alias("_a")).join(b.select("page", F.col("text").alias("_b")), "page", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("page")
