"""Registered queries of the reference operators, with their SQL for DuckDB.

The driver's tables hold no images and no detections. ``det`` derives stand-in boxes from ``lineitem`` and
other queries use names, events or vectors as proxies; they exercise the operators, not recognition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import containment as C
from ..operators import detections as D
from ..ship import ship
from ..sources.dims import CLASSES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DET_SQL = """
SELECT l_orderkey // 8 AS page_id,
  row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS det_idx,
  l_partkey % 17 AS class_idx, l_discount * 10 AS conf, (l_partkey * 37) % 1000 AS x1, (l_suppkey * 53) % 1400 AS y1,
  CAST(CASE WHEN l_partkey % 17 IN (0, 7, 15) THEN 150 + l_quantity * 6 ELSE 20 + l_quantity * 3 END AS BIGINT) AS w,
  CAST(CASE WHEN l_partkey % 17 IN (0, 7, 15) THEN 150 + l_quantity * 6 ELSE 12 + l_quantity % 20 END AS BIGINT) AS h
FROM lineitem
"""
DET = f"WITH det AS MATERIALIZED ({DET_SQL}) "
ROUND = "CAST(floor({} + 0.5) AS BIGINT)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    line = read(spark, sf_dir, "lineitem").withColumn("page_id", F.floor(F.col("l_orderkey") / 8).cast("long"))
    part, q = F.col("l_partkey"), F.col("l_quantity")
    block = (part % 17).isin(0, 7, 15)
    return line.select(
        "page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy(*order)) - 1).alias("det_idx"), (part % 17).alias("class_idx"), (F.col("l_discount") * 10).alias("conf"),
        ((part * 37) % 1000).alias("x1"), ((F.col("l_suppkey") * 53) % 1400).alias("y1"),
        F.when(block, 150 + q * 6).otherwise(20 + q * 3).cast("long").alias("w"), F.when(block, 150 + q * 6).otherwise(12 + q % 20).cast("long").alias("h"),
    )


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- text -----------------------------------------------------------------------------------------------------
RULES = [T.Rule("[,，]", "", "g"), T.Rule(r"\s{2,}", " ", "g"), T.Rule("(th)(e)", "$2$1", "gi"), T.Rule("[invalid", "x", "g"), T.Rule("off", "x", "g", enabled=False), T.Rule(r"[.!]+$", "", "gm")]
WS = "[" + T.WHITE + "]"


@query(
    rf"""SELECT doc_id, c AS text_clean, length(c) AS n_chars FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[,，]', '', 'g'), '{WS}{{2,}}', ' ', 'g'), '(?i)(th)(e)', '\2\1', 'g'), '(?m)[.!]+$', '', 'g'),
  '(?m)[{T.WHITE_NO_LF}]+$', '', 'g'), '\A{WS}+', ''), '{WS}+\z', '') AS c FROM documents)"""
)
def clean_text(spark, sf_dir):
    """A rule list over every text, then the trims."""
    c = T.trim_lines(T.clean(spark, F.col("text"), RULES))
    return read(spark, sf_dir, "documents").select("doc_id", c.alias("text_clean")).withColumn("n_chars", F.length("text_clean").cast("long"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '([a-z]+), ([a-z]+)', '\2; \1'), '(?i)the', '[\0]') AS text_first FROM documents")
def clean_first_only(spark, sf_dir):
    """Without the flag g the first match alone changes."""
    c = T.clean(spark, F.col("text"), [T.Rule("([a-z]+), ([a-z]+)", "$2; $1", ""), T.Rule("the", "[$&]", "i")])
    return read(spark, sf_dir, "documents").select("doc_id", c.alias("text_first"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS assembled, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations WHERE text <> '' GROUP BY conv_id")
def assemble_text(spark, sf_dir):
    """The non-empty lines of a page, in order."""
    lines = read(spark, sf_dir, "conversations").where(F.col("text") != "")
    return lines.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("assembled"), F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars")
    )


@query("SELECT doc_id, length(text) AS n_points, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS n_utf16 FROM documents")
def text_lengths(spark, sf_dir):
    """Code points, and UTF-16 units for compatibility."""
    return read(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_points"), T.utf16_length(F.col("text")).cast("long").alias("n_utf16"))


# --- detections -----------------------------------------------------------------------------------------------
@query(DET + "SELECT page_id, det_idx, conf FROM det WHERE conf > 0.25")
def score_filter(spark, sf_dir):
    """F1."""
    return D.with_scores_above(det(spark, sf_dir).withColumnRenamed("conf", "score")).select("page_id", "det_idx", F.col("score").alias("conf"))


@query(DET + f"SELECT page_id, det_idx, {ROUND.format('x1 * 1400 / 800.0')} AS rx1, {ROUND.format('y1 * 1400 / 800.0')} AS ry1, {ROUND.format('(x1 + w) * 1400 / 800.0')} AS rx2, {ROUND.format('(y1 + h) * 1400 / 800.0')} AS ry2 FROM det")
def box_rescale(spark, sf_dir):
    """Pages of 1000 by 1400 pixels, detector side 800."""
    scale = lambda c: G.rescale(c, F.lit(1000), F.lit(1400), 800)
    d = det(spark, sf_dir)
    return d.select("page_id", "det_idx", scale(F.col("x1")).alias("rx1"), scale(F.col("y1")).alias("ry1"), scale(F.col("x1") + F.col("w")).alias("rx2"), scale(F.col("y1") + F.col("h")).alias("ry2"))


_NAMES = "(VALUES " + ", ".join(f"({i}, '{n}', '{o}')" for i, (n, o) in enumerate(CLASSES)) + ") AS c(k, n, o)"


@query(DET + f"SELECT page_id, det_idx, coalesce(n, 'class_' || (class_idx + 2)) AS class_name, coalesce(o, 'class_' || (class_idx + 2)) AS org_name FROM det LEFT JOIN {_NAMES} ON k = class_idx + 2")
def class_lookup(spark, sf_dir):
    """Names by index, moved by two so that unknown classes occur."""
    from ..sources.dims import classes

    d = det(spark, sf_dir).select("page_id", "det_idx", (F.col("class_idx") + 2).cast("int").alias("class_idx"))
    other = F.concat(F.lit("class_"), F.col("class_idx").cast("string"))
    # 17 rows.
    return d.join(F.broadcast(classes(spark)), "class_idx", "left").select("page_id", "det_idx", F.coalesce("class_name", other).alias("class_name"), F.coalesce("org_name", other).alias("org_name"))


@query(DET + "SELECT class_idx + 2 AS class_idx, count(*) AS n FROM det WHERE class_idx + 2 BETWEEN 0 AND 16 GROUP BY 1")
def unknown_class_drop(spark, sf_dir):
    """F5."""
    return D.known_classes(det(spark, sf_dir).withColumn("class_idx", F.col("class_idx") + 2)).groupBy("class_idx").agg(F.count("*").alias("n"))


@query(DET + "SELECT page_id, det_idx FROM det WHERE NOT (class_idx = 0 AND w < 250 AND h < 250)")
def tiny_block_filter(spark, sf_dir):
    """F6; the bound is 250, since the stand-in blocks are large."""
    return D.without_tiny_blocks(det(spark, sf_dir), 250).select("page_id", "det_idx")


@query(DET + "SELECT page_id, det_idx, class_idx FROM det WHERE class_idx IN (0, 7, 15) OR conf >= 0.1")
def line_score_filter(spark, sf_dir):
    """F7."""
    return D.lines_above(det(spark, sf_dir)).select("page_id", "det_idx", "class_idx")


@query(DET + f"SELECT page_id, det_idx, n AS class_name, starts_with(n, 'line_') AS is_line, starts_with(n, 'block_') AND n <> 'block_table' AS is_block FROM det JOIN {_NAMES} ON k = class_idx")
def class_prefix(spark, sf_dir):
    """F8."""
    from ..sources.dims import classes

    d = det(spark, sf_dir).join(F.broadcast(classes(spark)), "class_idx")
    n = F.col("class_name")
    return d.select("page_id", "det_idx", n, n.startswith("line_").alias("is_line"), (n.startswith("block_") & (n != "block_table")).alias("is_block"))


@query(DET + "SELECT page_id, det_idx, w - 40 AS w, h - 15 AS h, w - 40 <= 0 OR h - 15 <= 0 AS empty_text, w - 40 >= 5 AND h - 15 >= 5 AS synthesised FROM det")
def line_guards(spark, sf_dir):
    """lines without area stay with an empty text; lines of 5 pixels or more may be synthesised."""
    w, h = F.col("w") - 40, F.col("h") - 15
    return det(spark, sf_dir).select("page_id", "det_idx", w.alias("w"), h.alias("h"), ((w <= 0) | (h <= 0)).alias("empty_text"), ((w >= 5) & (h >= 5)).alias("synthesised"))


@query(DET + "SELECT page_id, det_idx, class_idx, row_number() OVER (PARTITION BY page_id, class_idx ORDER BY det_idx) - 1 AS cls_pos FROM det")
def class_positions(spark, sf_dir):
    """A1."""
    return D.class_positions(det(spark, sf_dir)).select("page_id", "det_idx", "class_idx", "cls_pos")


# --- selections, padding, geometry ----------------------------------------------------------------------------
@query(DET + "SELECT page_id, det_idx, least(x1, y1) AS x, least(y1, x1 + w) AS y, abs(y1 - x1) AS width, abs(x1 + w - y1) AS height FROM det WHERE abs(y1 - x1) >= 4 AND abs(x1 + w - y1) >= 4")
def selection_norm(spark, sf_dir):
    """two corners to a rectangle; under four pixels a selection is void."""
    r = G.corners_to_rect(F.col("x1"), F.col("y1"), F.col("y1"), F.col("x1") + F.col("w"))
    return det(spark, sf_dir).select("page_id", "det_idx", r.alias("r")).select("page_id", "det_idx", "r.*").where("width >= 4 AND height >= 4")


@query(
    DET + "SELECT page_id, det_idx, sx, sy, greatest(1, least(1000 - sx, CAST(floor(w * d + 0.5) AS BIGINT))) AS sw, greatest(1, least(1400 - sy, CAST(floor(h * d + 0.5) AS BIGINT))) AS sh FROM ("
    "SELECT *, greatest(0, CAST(floor((x1 - 50) * d + 0.5) AS BIGINT)) AS sx, greatest(0, CAST(floor(y1 * d + 0.5) AS BIGINT)) AS sy FROM (SELECT *, CASE WHEN det_idx % 3 = 0 THEN 1.0 ELSE (det_idx % 3) * 0.75 END AS d FROM det))"
)
def dpr_crop(spark, sf_dir):
    """F13."""
    d = det(spark, sf_dir)
    r = G.device_rect(F.col("x1") - 50, F.col("y1"), F.col("w"), F.col("h"), (F.col("det_idx") % 3) * F.lit(0.75), F.lit(1000), F.lit(1400))
    return d.select("page_id", "det_idx", r.alias("r")).select("page_id", "det_idx", *[F.col("r")[c].cast("long").alias(c) for c in ("sx", "sy", "sw", "sh")])


@query(DET + "SELECT page_id, det_idx, (x1 - 8) * 1000 / 640.0 AS cx, (y1 - 12) * 1400 / 896.0 AS cy FROM det")
def canvas_map(spark, sf_dir):
    """F14."""
    return det(spark, sf_dir).select("page_id", "det_idx", G.canvas_point(F.col("x1"), F.lit(8), F.lit(1000), F.lit(640.0)).alias("cx"), G.canvas_point(F.col("y1"), F.lit(12), F.lit(1400), F.lit(896.0)).alias("cy"))


_PAD = "least(CAST(floor(least(w, h) * {} + 0.5) AS BIGINT), 50)"


@query(DET + f"SELECT page_id, det_idx, {_PAD.format('CAST(0.3 AS DOUBLE)')} AS pad FROM det")
def padding_amount(spark, sf_dir):
    """F15."""
    return det(spark, sf_dir).select("page_id", "det_idx", G.padding(F.col("w"), F.col("h")).cast("long").alias("pad"))


@query(DET + f"SELECT page_id, det_idx, px, py, least(x1 + w + p, 1000) - px AS pw, least(y1 + h + p, 1400) - py AS ph FROM (SELECT *, greatest(x1 - p, 0) AS px, greatest(y1 - p, 0) AS py FROM (SELECT *, {_PAD.format('CAST(0.5 AS DOUBLE)')} AS p FROM det))")
def padded_rect(spark, sf_dir):
    """F16."""
    r = G.padded_rect(*[F.col(c) for c in ("x1", "y1", "w", "h")], F.lit(1000), F.lit(1400), 0.5)
    return det(spark, sf_dir).select("page_id", "det_idx", r.alias("r")).select("page_id", "det_idx", *[F.col("r")[c].cast("long").alias(c) for c in ("px", "py", "pw", "ph")])


@query(
    DET + "SELECT page_id, det_idx, CASE WHEN (500 BETWEEN x1 AND x1 + w) AND (y1 + 5 BETWEEN y1 AND y1 + h) THEN CAST(least(500 - x1, x1 + w - 500, 5, h - 5) AS DOUBLE) "
    "ELSE -sqrt(power(greatest(x1 - 500, 0, 500 - x1 - w), 2) + power(greatest(-5, 0, 5 - h), 2)) END AS dist FROM det"
)
def signed_distance(spark, sf_dir):
    """F18 for rectangles: the distance of (500, y1 + 5) from each box's border."""
    x, y = F.col("x1"), F.col("y1")
    return det(spark, sf_dir).select("page_id", "det_idx", G.signed_distance(F.lit(500), y + 5, x, y, x + F.col("w"), y + F.col("h")).alias("dist"))


@query(
    DET + "SELECT page_id, det_idx, CASE WHEN x1 + 10 <= 500 AND 500 <= x1 + w AND y1 + 3 = y1 THEN 0 WHEN 500 = x1 OR 500 = x1 + w THEN CASE WHEN 3 BETWEEN 0 AND h THEN 0 ELSE -1 END "
    "WHEN 500 > x1 AND 500 < x1 + w AND 3 < h THEN 1 ELSE -1 END AS side FROM det"
)
def point_in_polygon(spark, sf_dir):
    """F17 by the general even-odd rule, on the boxes as polygons; the SQL is the rectangle's closed form."""
    x, y = F.col("x1"), F.col("y1")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    points = F.array(corner(x, y), corner(x + F.col("w"), y), corner(x + F.col("w"), y + F.col("h")), corner(x, y + F.col("h")))
    return det(spark, sf_dir).select("page_id", "det_idx", G.point_in_polygon(F.lit(500), y + 3, points).alias("side"))


@query(DET + "SELECT page_id, det_idx, least(x1, y1, w) AS bx, least(y1, h, x1) AS by_, greatest(x1, y1, w) - least(x1, y1, w) AS bw, greatest(y1, h, x1) - least(y1, h, x1) AS bh, concat_ws(',', x1, y1, y1, h, w, x1) AS points FROM det")
def polygon_bbox(spark, sf_dir):
    """Box and point list of a triangle."""
    p = F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("x1", "y1"), ("y1", "h"), ("w", "x1"))])
    d = det(spark, sf_dir).select("page_id", "det_idx", G.polygon_box(p).alias("b"), F.array_join(F.flatten(F.transform(p, lambda q: F.array(q["x"].cast("string"), q["y"].cast("string")))), ",").alias("points"))
    return d.select("page_id", "det_idx", F.col("b.bx").alias("bx"), F.col("b.by").alias("by_"), F.col("b.bw").alias("bw"), F.col("b.bh").alias("bh"), "points")


def _pairs(spark, sf_dir, names: str) -> DataFrame:
    """Pairs of neighbours of a page: the following detection by position, an equi-join on page and position."""
    d = det(spark, sf_dir)
    nxt = d.select("page_id", (F.col("det_idx") - 1).alias("det_idx"), *[F.col(c).alias(c + "b") for c in ("x1", "y1", "w", "h")])
    return d.join(nxt, ["page_id", "det_idx"])


_NEXT = DET + "SELECT a.page_id, a.det_idx, {} FROM det a JOIN det b ON a.page_id = b.page_id AND b.det_idx = a.det_idx + 1"
_IX = "greatest(least(a.x1 + a.w, b.x1 + b.w) - greatest(a.x1, b.x1), 0)"
_IY = "greatest(least(a.y1 + a.h, b.y1 + b.h) - greatest(a.y1, b.y1), 0)"


@query(_NEXT.format(f"CASE WHEN least(a.w * a.h, b.w * b.h) = 0 THEN 0.0 ELSE CAST({_IX} * {_IY} AS DOUBLE) / least(a.w * a.h, b.w * b.h) END AS ratio, {_IX} > 0 AND {_IY} > 0 AS touching"))
def overlap_pairs(spark, sf_dir):
    """F21, F23 on neighbouring detections."""
    a, b = [F.col(c) for c in ("x1", "y1", "w", "h")], [F.col(c + "b") for c in ("x1", "y1", "w", "h")]
    touching = (G.overlap(a[0], a[0] + a[2], b[0], b[0] + b[2]) > 0) & (G.overlap(a[1], a[1] + a[3], b[1], b[1] + b[3]) > 0)
    return _pairs(spark, sf_dir, "").select("page_id", "det_idx", G.overlap_over_smaller(tuple(a), tuple(b)).alias("ratio"), touching.alias("touching"))


_MI = "greatest(least(a.x1 + a.w, b.x1 + b.w) - greatest(a.x1, b.x1) + 1, 0) * greatest(least(a.y1 + a.h, b.y1 + b.h) - greatest(a.y1, b.y1) + 1, 0)"
_MU = f"((a.x1 + a.w - b.x1 + 1) * (a.y1 + a.h - b.y1 + 1) + (b.x1 + b.w - a.x1 + 1) * (b.y1 + b.h - a.y1 + 1) - {_MI})"


@query(_NEXT.format(f"CASE WHEN {_MU} <= 0 THEN 0.0 ELSE CAST({_MI} AS DOUBLE) / {_MU} END AS score"))
def xycut_iou(spark, sf_dir):
    """F22."""
    box = lambda s: tuple([F.col("x1" + s), F.col("y1" + s), F.col("x1" + s) + F.col("w" + s), F.col("y1" + s) + F.col("h" + s)])
    return _pairs(spark, sf_dir, "").select("page_id", "det_idx", G.mixed_iou(box(""), box("b")).alias("score"))


@query(DET + "SELECT page_id, det_idx, x1 - dx AS dx1, y1 - dy AS dy1, x1 + w + dx AS dx2, y1 + h + dy AS dy2 FROM (SELECT *, CASE WHEN w < h THEN w * CAST(0.1 AS DOUBLE) / 2 ELSE 0.0 END AS dx, CASE WHEN w < h THEN 0.0 ELSE h * CAST(0.1 AS DOUBLE) / 2 END AS dy FROM det)")
def warichu_dilate(spark, sf_dir):
    """F24."""
    return det(spark, sf_dir).select("page_id", "det_idx", G.dilated(*[F.col(c) for c in ("x1", "y1", "w", "h")]).alias("d")).select("page_id", "det_idx", "d.*")


# --- joins ----------------------------------------------------------------------------------------------------
_LINES = ", ".join(map(str, D.LINE_CLASSES))
_CONT = (
    f"lines AS (SELECT *, x1 + w / 2.0 AS cx, y1 + h / 2.0 AS cy FROM det WHERE class_idx IN ({_LINES}) AND conf >= 0.1), "
    "boxes AS (SELECT page_id, det_idx AS block_idx, CASE class_idx WHEN 0 THEN 1 WHEN 7 THEN 2 ELSE 3 END AS prio, x1 AS bx1, y1 AS by1, x1 + w AS bx2, y1 + h AS by2 FROM det WHERE class_idx IN (0, 7, 15)), "
    "matched AS (SELECT l.page_id, det_idx, class_idx, prio, block_idx, row_number() OVER (PARTITION BY l.page_id, det_idx ORDER BY prio, block_idx) AS rn FROM lines l JOIN boxes b ON l.page_id = b.page_id AND cx BETWEEN bx1 AND bx2 AND cy BETWEEN by1 AND by2) "
)
_DETC = DET.rstrip() + ", " + _CONT


@query(_DETC + "SELECT page_id, det_idx, class_idx, prio, block_idx FROM matched WHERE rn = 1")
def line_containment(spark, sf_dir):
    """First container by priority."""
    return C.first_container(det(spark, sf_dir))


@query(_DETC + "SELECT l.page_id, l.det_idx, l.class_idx FROM lines l WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.page_id = l.page_id AND m.det_idx = l.det_idx)")
def independent_lines(spark, sf_dir):
    """J4."""
    return C.independent_lines(det(spark, sf_dir)).select("page_id", "det_idx", "class_idx")


_FAR = "power(greatest(p.x1 - {0}, 0, {0} - p.x1 - p.w), 2) + power(greatest(p.y1 - {1}, 0, {1} - p.y1 - p.h), 2)"


@query(
    DET + "SELECT c.page_id, c.det_idx AS child, p.det_idx AS parent FROM det c JOIN det p ON c.page_id = p.page_id AND c.det_idx <> p.det_idx WHERE c.class_idx = 0 AND p.class_idx = 0 AND sqrt(greatest("
    + ", ".join(_FAR.format(x, y) for x in ("c.x1", "(c.x1 + c.w)") for y in ("c.y1", "(c.y1 + c.h)"))
    + ")) <= 50"
)
def merge_candidates(spark, sf_dir):
    """J5, candidate pairs."""
    return C.merge_candidates(det(spark, sf_dir))


# --- aggregates -----------------------------------------------------------------------------------------------
@query(DET + "SELECT page_id, count(*) AS n, CAST(sum(CASE WHEN w < h THEN 1 ELSE 0 END) AS BIGINT) AS n_vertical, count(*) < 2 * sum(CASE WHEN w < h THEN 1 ELSE 0 END) AS vertical, min(x1) AS x0, min(y1) AS y0, max(x1 + w) AS x2, max(y1 + h) AS y2 FROM det GROUP BY page_id")
def orientation_vote(spark, sf_dir):
    """A4, A5, A8, A12."""
    v = F.count_if(F.col("w") < F.col("h"))
    return det(spark, sf_dir).groupBy("page_id").agg(
        F.count("*").alias("n"), v.alias("n_vertical"), (F.count("*") < 2 * v).alias("vertical"), F.min("x1").alias("x0"), F.min("y1").alias("y0"), F.max(F.col("x1") + F.col("w")).alias("x2"), F.max(F.col("y1") + F.col("h")).alias("y2")
    )


@query(DET + "SELECT page_id, class_idx, list_sort(list(w))[(count(*) // 2) + 1] AS median_w, list(w ORDER BY det_idx)[(count(*) // 2) + 1] AS middle_w, max(y1) - min(y1) AS order_range FROM det GROUP BY page_id, class_idx")
def upper_median(spark, sf_dir):
    """Upper median, positional middle, range; groups are the lines of one block."""
    mid = (F.floor(F.count("*") / 2) + 1).cast("int")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("det_idx", "w"))), lambda s: s["w"])
    return det(spark, sf_dir).groupBy("page_id", "class_idx").agg(
        F.element_at(F.array_sort(F.collect_list("w")), mid).alias("median_w"), F.element_at(listed, mid).alias("middle_w"), (F.max("y1") - F.min("y1")).alias("order_range")
    )


@query(
    DET + "SELECT page_id, det_idx, row_number() OVER (PARTITION BY page_id ORDER BY -x1, y1, det_idx) - 1 AS rank_vertical, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, det_idx) - 1 AS rank_horizontal FROM det"
)
def leaf_sort_rank(spark, sf_dir):
    """O1, W1, W3."""
    p = Window.partitionBy("page_id")
    return det(spark, sf_dir).select(
        "page_id", "det_idx", (F.row_number().over(p.orderBy(-F.col("x1"), "y1", "det_idx")) - 1).alias("rank_vertical"), (F.row_number().over(p.orderBy("y1", "x1", "det_idx")) - 1).alias("rank_horizontal")
    )


@query(
    DET + "SELECT page_id, det_idx, class_idx IN (7, 15) AS is_block, row_number() OVER (PARTITION BY page_id ORDER BY class_idx IN (7, 15), CASE WHEN class_idx IN (7, 15) THEN NULL ELSE coalesce(y1, -1) END NULLS FIRST, det_idx) - 1 AS line_pos FROM det"
)
def traversal_order(spark, sf_dir):
    """Sorted children first, containers after them in their own order."""
    block = F.col("class_idx").isin(7, 15)
    key = F.when(~block, F.coalesce(F.col("y1"), F.lit(-1)))
    w = Window.partitionBy("page_id").orderBy(block, key.asc_nulls_first(), "det_idx")
    return det(spark, sf_dir).select("page_id", "det_idx", block.alias("is_block"), (F.row_number().over(w) - 1).alias("line_pos"))


# --- arrays, tensors, decoding --------------------------------------------------------------------------------
@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def argmax_embed(spark, sf_dir):
    """A10, M6 on vectors as proxies of logits."""
    return read(spark, sf_dir, "embeddings").select("vec_id", T.argmax(F.col("embedding")).cast("int").alias("best"))


_IDS = "list_transform(embedding, lambda v: CAST(floor(abs(v) * 200) AS BIGINT))"


@query(
    f"SELECT vec_id, coalesce(list_aggregate(list_transform(list_filter(CASE WHEN list_position(i, 0) > 0 THEN i[1:list_position(i, 0) - 1] ELSE i END, lambda k: k > 0 AND k <= 26), lambda k: chr(CAST(96 + k AS INTEGER))), 'string_agg', ''), '') AS decoded FROM (SELECT vec_id, {_IDS} AS i FROM embeddings)"
)
def decode_tokens(spark, sf_dir):
    """T8 with a charset of 26 letters; ids are derived from vectors."""
    charset = F.array(*[F.lit(chr(97 + k)) for k in range(26)])
    # A float literal: with ANSI rules a float times a whole number would be a double, whose floor may differ from that of the SQL's float.
    ids = F.transform("embedding", lambda v: F.floor(F.abs(v) * F.lit(200).cast("float")))
    return read(spark, sf_dir, "embeddings").select("vec_id", T.decode_ids(ids, charset).alias("decoded"))


_MEAN, _STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
_PX = "list_transform(embedding, lambda v: CAST(floor(abs(v) * 255) AS BIGINT) % 256)"


@query(
    f"SELECT vec_id, list_transform(range(1, 49), lambda i: (p[i + ((i - 1) // 3)] / CAST(255 AS DOUBLE) - CASE (i - 1) % 3 WHEN 0 THEN CAST(0.485 AS DOUBLE) WHEN 1 THEN CAST(0.456 AS DOUBLE) ELSE CAST(0.406 AS DOUBLE) END) / CASE (i - 1) % 3 WHEN 0 THEN CAST(0.229 AS DOUBLE) WHEN 1 THEN CAST(0.224 AS DOUBLE) ELSE CAST(0.225 AS DOUBLE) END) AS standard, "
    f"list_transform(range(1, 49), lambda i: 2 * p[((i - 1) // 3) * 4 + 3 - (i - 1) % 3] / CAST(255 AS DOUBLE) - 1) AS bgr, list_transform(range(0, 48), lambda i: p[(i % 16) * 4 + i // 16 + 1]) AS planes FROM (SELECT vec_id, {_PX} AS p FROM embeddings)"
)
def normalize_pixels(spark, sf_dir):
    """R-e, R-f, R-g on vectors as 4 by 4 RGBA pixels: standardised, BGR, and channel planes."""
    from ..functions import tensor as X

    px = F.transform("embedding", lambda v: F.floor(F.abs(v) * 255) % 256)
    p = F.col("p")
    return read(spark, sf_dir, "embeddings").select("vec_id", px.alias("p")).select("vec_id", X.standardise(p, _MEAN, _STD).alias("standard"), X.bgr(p).alias("bgr"), X.planes(p, 16, 4, 3).alias("planes"))


# --- rules, settings, formats ---------------------------------------------------------------------------------
_LISTS = "WITH named AS (SELECT p_name, p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n, count(*) OVER (PARTITION BY p_name) AS many FROM part) "
_EX = "SELECT p_name AS name, p_partkey AS pos, p_brand AS pattern FROM named WHERE n = 1"
_IM = "SELECT p_name AS name, max_by(p_type, p_partkey) AS pattern FROM named WHERE n > 1 OR many = 1 GROUP BY p_name"


def _lists(spark, sf_dir):
    """Two rule lists of all parts: the first part of each name exists; other parts, and names met once, are imported."""
    w = Window.partitionBy("p_name")
    named = read(spark, sf_dir, "part").select("p_name", "p_brand", "p_type", "p_partkey", F.row_number().over(w.orderBy("p_partkey")).alias("n"), F.count(F.lit(1)).over(w).alias("many"))
    existing = named.where("n = 1").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("pattern"))
    return existing, named.where("n > 1 OR many = 1").select(F.col("p_name").alias("name"), F.col("p_type").alias("pattern"), F.col("p_partkey").alias("pos"))


@query(_LISTS + f"SELECT coalesce(e.name, i.name) AS name, coalesce(i.pattern, e.pattern) AS pattern, e.pos AS kept_pos, i.name IS NOT NULL AS imported FROM ({_EX}) e FULL JOIN ({_IM}) i ON e.name = i.name")
def rule_upsert(spark, sf_dir):
    """J10 with part names as proxies of rule names: imported values win, position and place stay."""
    from ..operators.rules import upsert

    existing, imported = _lists(spark, sf_dir)
    return upsert(existing, imported, ["pattern"]).select("name", "pattern", "kept_pos", "imported")


@query(_LISTS + f"SELECT DISTINCT i.name FROM ({_IM}) i WHERE EXISTS (SELECT 1 FROM ({_EX}) e WHERE e.name = i.name)")
def rule_dupes(spark, sf_dir):
    """J11."""
    existing, imported = _lists(spark, sf_dir)
    return imported.select("name").distinct().join(existing.select("name"), "name", "left_semi")


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY k, p_partkey) - 1 AS pos FROM (SELECT p_partkey, CASE WHEN p_partkey = 5 THEN 6 WHEN p_partkey = 6 THEN 5 ELSE p_partkey END AS k FROM part WHERE p_partkey <> 10)")
def rule_edits(spark, sf_dir):
    """Delete one rule and move another, in the list of all parts."""
    from ..operators.rules import delete, move

    rules = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - 1).alias("pos"))
    return delete(move(rules, 4, 1), [10]).select("id", "pos")


@query("SELECT p_partkey AS id, 'Rule ' || p_partkey AS name, '' AS pattern, 'g' AS flags, '' AS replacement, true AS enabled FROM part")
def new_rules(spark, sf_dir):
    """A new rule for each number."""
    from ..operators.rules import new_rule

    return read(spark, sf_dir, "part").select(new_rule(F.col("p_partkey"), F.concat(F.lit("Rule "), F.col("p_partkey").cast("string"))).alias("r")).select("r.id", "r.name", "r.pattern", "r.flags", "r.replacement", "r.enabled")


@query("SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(o_totalprice || 'px', '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS x, TRY_CAST(nullif(regexp_extract(o_orderpriority, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS y FROM orders")
def parse_boxes(spark, sf_dir):
    """The whole number that opens a text, or none."""
    return read(spark, sf_dir, "orders").select("o_orderkey", T.parse_int(F.concat(F.col("o_totalprice").cast("string"), F.lit("px"))).alias("x"), T.parse_int(F.col("o_orderpriority")).alias("y"))


@query(DET + "SELECT page_id, det_idx, abs(y1 - x1) AS width, abs(x1 + w - y1) AS height FROM det WHERE abs(y1 - x1) > 5 AND abs(x1 + w - y1) > 5")
def viewer_selection(spark, sf_dir):
    """in the viewer a selection of five pixels or less is void."""
    r = G.corners_to_rect(F.col("x1"), F.col("y1"), F.col("y1"), F.col("x1") + F.col("w"))
    return det(spark, sf_dir).select("page_id", "det_idx", r.alias("r")).where(G.is_selected(F.col("r"), "viewer")).select("page_id", "det_idx", "r.width", "r.height")


_POLYGON = "(VALUES (0, 200.0, 100.0, 800.0, 300.0), (1, 800.0, 300.0, 500.0, 1200.0), (2, 500.0, 1200.0, 200.0, 100.0)) e(k, ax, ay, bx, ye)"


@query(
    DET + "SELECT page_id, det_idx, round(CASE WHEN sum(CASE WHEN (ay > y1) <> (ye > y1) AND x1 < (bx - ax) * (y1 - ay) / (ye - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 THEN 1 ELSE -1 END * min(sqrt("
    "pow(x1 - ax - greatest(0.0, least(1.0, ((x1 - ax) * (bx - ax) + (y1 - ay) * (ye - ay)) / (pow(bx - ax, 2) + pow(ye - ay, 2)))) * (bx - ax), 2) + "
    "pow(y1 - ay - greatest(0.0, least(1.0, ((x1 - ax) * (bx - ax) + (y1 - ay) * (ye - ay)) / (pow(bx - ax, 2) + pow(ye - ay, 2)))) * (ye - ay), 2))), 6) AS d "
    f"FROM (SELECT page_id, det_idx, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM det), {_POLYGON} GROUP BY page_id, det_idx"
)
def polygon_distance(spark, sf_dir):
    """signed distance to a polygon of any shape, here a triangle."""
    corners = [(200.0, 100.0), (800.0, 300.0), (500.0, 1200.0)]
    return det(spark, sf_dir).select("page_id", "det_idx", F.round(G.polygon_distance(F.col("x1").cast("double"), F.col("y1").cast("double"), corners), 6).alias("d"))


@query("SELECT event_id, event_type || ' (' || (i + 1) || '/' || n || ')' AS message, CAST(floor(100.0 * (i + 1) / n + 0.5) AS BIGINT) AS pct FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE (i + 1) % 5 = 0 OR i = n - 1")
def event_progress(spark, sf_dir):
    """Every fifth step of a job and the last, with text and per cent; users are the jobs."""
    w = Window.partitionBy("user_id")
    e = read(spark, sf_dir, "events").select("event_id", "event_type", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return e.where("(i + 1) % 5 = 0 OR i = n - 1").select("event_id", T.progress_text(F.col("event_type"), F.col("i") + 1, F.col("n")).alias("message"), T.percent(F.col("i") + 1, F.col("n")).cast("long").alias("pct"))


@query("SELECT c_custkey, floor(c_acctbal * 1000 + 0.5) / 1000 AS conf3 FROM customer")
def fixed_three(spark, sf_dir):
    """T10, R3."""
    return read(spark, sf_dir, "customer").select("c_custkey", T.fixed3(F.col("c_acctbal")).alias("conf3"))


@query(
    "SELECT page_id, starts_with(u, 'chrome://') OR starts_with(u, 'chrome-extension://') OR starts_with(u, 'https://chromewebstore.google.com') OR starts_with(u, 'https://chrome.google.com/webstore') AS denied, starts_with(u, 'chrome-extension://') AS own_page "
    "FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'chrome://' || url WHEN 1 THEN 'chrome-extension://' || url ELSE url END AS u FROM pages)"
)
def url_rules(spark, sf_dir):
    """F26, F27."""
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("chrome://"), "url")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("chrome-extension://"), "url")).otherwise(F.col("url"))
    # Openings of addresses on which nothing may run.
    denied = ["chrome://", "chrome-extension://", "https://chromewebstore.google.com", "https://chrome.google.com/webstore"]
    return read(spark, sf_dir, "pages").select("page_id", G.any_prefix(url, denied).alias("denied"), url.startswith("chrome-extension://").alias("own_page"))


@query("SELECT page_id, octet_length(encode(html)) AS n_bytes, md5(html) AS digest FROM pages")
def data_url_decode(spark, sf_dir):
    """A data URL's bytes."""
    from ..sources.images import data_url_bytes

    url = F.concat(F.lit("data:text/html;base64,"), F.base64(F.encode("html", "UTF-8")))
    b = data_url_bytes(url)
    return read(spark, sf_dir, "pages").select("page_id", F.octet_length(b).cast("long").alias("n_bytes"), F.md5(b).alias("digest"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-1') AS k, event_type || '=' || coalesce(json_extract_string(props, '$.k'), '-1') AS overlay FROM events")
def attr_defaults(spark, sf_dir):
    """Attributes of a JSON object with a default, overlaid on a record."""
    attrs = F.from_json("props", "map<string,string>")
    k = F.coalesce(F.try_element_at(attrs, F.lit("k")), F.lit("-1"))
    record = F.struct(F.col("event_type").alias("label"), F.lit("").alias("k")).withField("k", k)
    return read(spark, sf_dir, "events").select("event_id", record.alias("r")).select("event_id", F.col("r.k").alias("k"), F.concat_ws("=", F.col("r.label"), F.col("r.k")).alias("overlay"))


@query("SELECT page_id, parent, list(det_idx ORDER BY det_idx) AS children, string_agg(' ' || det_idx || '=\"' || w || '\"', '' ORDER BY det_idx) AS attrs FROM (SELECT *, det_idx // 8 AS parent FROM (" + DET_SQL + ")) GROUP BY page_id, parent")
def child_lists(spark, sf_dir):
    """Ordered children and rendered attributes by parent."""
    d = det(spark, sf_dir).withColumn("parent", F.floor(F.col("det_idx") / 8))
    rows = F.array_sort(F.collect_list(F.struct("det_idx", "w")))
    g = d.groupBy("page_id", "parent").agg(rows.alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.concat(F.lit(" "), x["det_idx"].cast("string"), F.lit('="'), x["w"].cast("string"), F.lit('"'))), "")
    return g.select("page_id", "parent", F.transform("r", lambda x: x["det_idx"].cast("long")).alias("children"), text.alias("attrs"))


# --- page operators without an SQL form -----------------------------------------------------------------------
from . import page_queries, table_queries  # noqa: E402, F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
