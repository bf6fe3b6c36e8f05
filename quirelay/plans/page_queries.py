"""Queries of page operators; those that SQL can't express are compared with plain Python by tests.

Pages here are eight neighbouring orders, so every row of the table is on some page and pages stay small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import order as O
from ..operators import page as P
from ..operators import raster as R
from ..operators.detections import LINE_CLASSES
from ..sources import images as I
from ..sources.dims import CLASSES
from .catalog import det, query, read


#: The same pages for DuckDB.
PAGES = """
WITH RECURSIVE pg AS MATERIALIZED (
  SELECT l_orderkey // 8 AS page_id, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS det_idx,
    l_partkey % 17 AS class_idx, l_discount * 10 AS conf, (l_partkey * 37) % 1000 AS x1, (l_suppkey * 53) % 1400 AS y1,
    CAST(CASE WHEN l_partkey % 17 IN (0, 7, 15) THEN 150 + l_quantity * 6 ELSE 20 + l_quantity * 3 END AS BIGINT) AS w,
    CAST(CASE WHEN l_partkey % 17 IN (0, 7, 15) THEN 150 + l_quantity * 6 ELSE 12 + l_quantity % 20 END AS BIGINT) AS h
  FROM lineitem
)
"""


def pages(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").withColumn("page_id", F.floor(F.col("l_orderkey") / 8).cast("long"))
    # The one shuffle by page; its number of parts is given, since page folds cost time, not bytes.
    line = line.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    order = "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    part, q = F.col("l_partkey"), F.col("l_quantity")
    block = (part % 17).isin(0, 7, 15)
    return line.select(
        "page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy(*order)) - 1).cast("long").alias("det_idx"), (part % 17).cast("long").alias("class_idx"), (F.col("l_discount") * 10).alias("conf"),
        ((part * 37) % 1000).cast("long").alias("x1"), ((F.col("l_suppkey") * 53) % 1400).cast("long").alias("y1"),
        F.when(block, 150 + q * 6).otherwise(20 + q * 3).cast("long").alias("w"), F.when(block, 150 + q * 6).otherwise(12 + q % 20).cast("long").alias("h"),
    )


def lines(spark, sf_dir):
    return pages(spark, sf_dir).where(~F.col("class_idx").isin(0, 7, 15))


#: Cells of the page's grid (g) cut into strips at the edges of boxes; ``sheet`` has the covered cells of every strip up to each edge across it, so the
#: marginals of a node are differences; ``node`` cuts all nodes of a level at once; leaves are given their boxes and read in order.
XY_SQL = (
    PAGES
    + """, line AS MATERIALIZED (
  SELECT page_id, det_idx, x1, y1, x1 + w AS x2, y1 + h AS y2, w, h FROM pg WHERE class_idx NOT IN (0, 7, 15)
), page AS MATERIALIZED (
  SELECT page_id, min(x1) AS lx, min(y1) AS ly, CAST(max(x2) - min(x1) AS DOUBLE) AS ex, CAST(max(y2) - min(y1) AS DOUBLE) AS ey, 100 * sqrt(count(*)) AS side FROM line GROUP BY page_id
), g AS MATERIALIZED (
  SELECT page_id, det_idx, CAST(floor((x1 - lx) * tx / ex) AS INTEGER) AS a, CAST(floor((y1 - ly) * ty / ey) AS INTEGER) AS b, CAST(floor((x2 - lx) * tx / ex) AS INTEGER) AS c, CAST(floor((y2 - ly) * ty / ey) AS INTEGER) AS d
  FROM line JOIN (SELECT *, CASE WHEN ex < ey THEN side ELSE side * ex / ey END AS tx, CASE WHEN ey < ex THEN side ELSE side * ey / ex END AS ty FROM page) USING (page_id)
), xe AS (
  SELECT page_id, unnest(list_distinct(flatten([list(a), list(c), [0, max(c) + 1]]))) AS e FROM g GROUP BY page_id
), ye AS (
  SELECT page_id, unnest(list_distinct(flatten([list(b), list(d), [0, max(d) + 1]]))) AS e FROM g GROUP BY page_id
), xs AS (
  SELECT * FROM (SELECT page_id, e AS fr, lead(e) OVER (PARTITION BY page_id ORDER BY e) AS til FROM xe) WHERE til IS NOT NULL
), ys AS (
  SELECT * FROM (SELECT page_id, e AS fr, lead(e) OVER (PARTITION BY page_id ORDER BY e) AS til FROM ye) WHERE til IS NOT NULL
), mesh AS (
  SELECT DISTINCT g.page_id, xs.fr AS x, ys.fr AS y FROM g JOIN xs ON xs.page_id = g.page_id AND xs.fr >= a AND xs.til <= c JOIN ys ON ys.page_id = g.page_id AND ys.fr >= b AND ys.til <= d
), cell AS MATERIALIZED (
  SELECT xs.page_id, xs.fr AS x, ys.fr AS y, CASE WHEN mesh.x IS NULL THEN 0 ELSE xs.til - xs.fr END AS wide, CASE WHEN mesh.x IS NULL THEN 0 ELSE ys.til - ys.fr END AS high
  FROM xs JOIN ys ON ys.page_id = xs.page_id LEFT JOIN mesh ON mesh.page_id = xs.page_id AND mesh.x = xs.fr AND mesh.y = ys.fr
), down AS (
  SELECT page_id, list(list_prepend(0, n) ORDER BY x) AS cx FROM (SELECT page_id, x, list(n ORDER BY y) AS n FROM (SELECT page_id, x, y, CAST(sum(high) OVER (PARTITION BY page_id, x ORDER BY y) AS SMALLINT) AS n FROM cell) GROUP BY page_id, x) GROUP BY page_id
), across AS (
  SELECT page_id, list(list_prepend(0, n) ORDER BY y) AS cy FROM (SELECT page_id, y, list(n ORDER BY x) AS n FROM (SELECT page_id, x, y, CAST(sum(wide) OVER (PARTITION BY page_id, y ORDER BY x) AS SMALLINT) AS n FROM cell) GROUP BY page_id, y) GROUP BY page_id
), sheet AS MATERIALIZED (
  SELECT page_id, 0 AS along, cx AS cum, e FROM down JOIN (SELECT page_id, list(e ORDER BY e) AS e FROM xe GROUP BY page_id) USING (page_id)
  UNION ALL
  SELECT page_id, 1, cy, e FROM across JOIN (SELECT page_id, list(e ORDER BY e) AS e FROM ye GROUP BY page_id) USING (page_id)
), node AS (
  SELECT page_id, CAST(1 AS BIGINT) AS x0, CAST(1 AS BIGINT) AS y0, max(len(e)) FILTER (WHERE along = 0) AS x1, max(len(e)) FILTER (WHERE along = 1) AS y1, CAST([] AS INTEGER[]) AS path FROM sheet GROUP BY page_id
  UNION ALL
  SELECT page_id, px0, py0, px1, py1, list_append(path, k) FROM (
    SELECT *, unnest([1, 2, 3]) AS k,
      unnest(CASE WHEN dir = 0 THEN [x0, xa, xb] ELSE [x0, x0, x0] END) AS px0, unnest(CASE WHEN dir = 0 THEN [y0, y0, y0] ELSE [y0, ya, yb] END) AS py0,
      unnest(CASE WHEN dir = 0 THEN [xa, xb, x1] ELSE [x1, x1, x1] END) AS px1, unnest(CASE WHEN dir = 0 THEN [y1, y1, y1] ELSE [ya, yb, y1] END) AS py1
    FROM (
      SELECT *, CASE WHEN xscore < yscore OR (xscore = yscore AND xlong >= ylong) THEN 0 ELSE 1 END AS dir FROM (
        SELECT page_id, x0, y0, x1, y1, path, max(CASE WHEN along = 0 THEN s END) AS xa, max(CASE WHEN along = 0 THEN e END) AS xb, max(CASE WHEN along = 0 THEN long END) AS xlong, max(CASE WHEN along = 0 THEN score END) AS xscore,
          max(CASE WHEN along = 1 THEN s END) AS ya, max(CASE WHEN along = 1 THEN e END) AS yb, max(CASE WHEN along = 1 THEN long END) AS ylong, max(CASE WHEN along = 1 THEN score END) AS yscore
        FROM (
          SELECT page_id, x0, y0, x1, y1, path, along, any_value(score) AS score, arg_max(s, (long, -s)) AS s, arg_max(e, (long, -s)) AS e, max(long) AS long FROM (
            SELECT page_id, x0, y0, x1, y1, path, along, min(i) AS s, max(i) + 1 AS e, sum(size) AS long, any_value(CASE WHEN whole <= 1 OR top = 0 THEN 0.0 ELSE -CAST(low AS DOUBLE) / top END) AS score
            FROM (
              SELECT *, i - row_number() OVER (PARTITION BY page_id, x0, y0, x1, y1, along ORDER BY i) AS island FROM (
                SELECT * FROM (
                  SELECT page_id, x0, y0, x1, y1, path, along, whole, list_min(ns) AS low, list_max(ns) AS top, unnest(ns) AS n, unnest(sizes) AS size, unnest(range(first, first + len(ns))) AS i FROM (
                    SELECT page_id, x0, y0, x1, y1, path, along, lo AS first, e[hi] - e[lo] AS whole, [c[o1] - c[o0] FOR c IN cum[lo:hi - 1]] AS ns, [e[i + 1] - e[i] FOR i IN range(lo, hi)] AS sizes
                    FROM (SELECT *, unnest([0, 1]) AS along, unnest([x0, y0]) AS lo, unnest([x1, y1]) AS hi, unnest([y0, x0]) AS o0, unnest([y1, x1]) AS o1 FROM node) JOIN sheet USING (page_id, along)
                  )
                ) WHERE n = low
              )
            ) GROUP BY page_id, x0, y0, x1, y1, path, along, island
          ) GROUP BY page_id, x0, y0, x1, y1, path, along
        ) GROUP BY page_id, x0, y0, x1, y1, path
      )
    ) WHERE NOT (xa = x0 AND xb = x1 AND ya = y0 AND yb = y1)
  ) WHERE px0 < px1 AND py0 < py1 AND NOT (px0 = x0 AND py0 = y0 AND px1 = x1 AND py1 = y1)
), counted AS MATERIALIZED (
  SELECT * FROM node
), tree AS MATERIALIZED (
  SELECT c.page_id, path, s.e[x0] AS x0, t.e[y0] AS y0, s.e[x1] AS x1, t.e[y1] AS y1 FROM counted c JOIN sheet s ON s.page_id = c.page_id AND s.along = 0 JOIN sheet t ON t.page_id = c.page_id AND t.along = 1
), parent AS MATERIALIZED (
  SELECT p.page_id, p.path, bool_and(c.y0 = p.y0 AND c.y1 = p.y1) AS columns FROM tree p JOIN tree c ON c.page_id = p.page_id AND len(c.path) = len(p.path) + 1 AND c.path[1:len(p.path)] = p.path GROUP BY p.page_id, p.path
), leaf AS MATERIALIZED (
  SELECT tree.* FROM tree ANTI JOIN parent ON parent.page_id = tree.page_id AND parent.path = tree.path
), scored AS (
  SELECT g.page_id, g.det_idx, g.a, g.b, g.c, g.d, leaf.path, greatest(0, least(g.c, leaf.x1) - greatest(g.a, leaf.x0) + 1) * greatest(0, least(g.d, leaf.y1) - greatest(g.b, leaf.y0) + 1) AS inter,
    (g.c - leaf.x0 + 1) * (g.d - leaf.y0 + 1) + (leaf.x1 - g.a + 1) * (leaf.y1 - g.b + 1) AS spans
  FROM g JOIN leaf USING (page_id)
), placed AS MATERIALIZED (
  SELECT *, d - b > c - a AS tall FROM scored
  QUALIFY row_number() OVER (PARTITION BY page_id, det_idx ORDER BY CASE WHEN spans - inter > 0 THEN CAST(inter AS DOUBLE) / (spans - inter) ELSE 0.0 END DESC, path) = 1
), within AS (
  SELECT page_id, path[1:k] AS path, count(*) < 2 * count(*) FILTER (WHERE tall) AS vertical FROM (SELECT page_id, path, tall, unnest(range(0, len(path) + 1)) AS k FROM placed) GROUP BY page_id, path[1:k]
), turned AS (
  SELECT page_id, path FROM within JOIN parent USING (page_id, path) WHERE vertical AND columns
), keyed AS (
  SELECT p.page_id, p.det_idx, list(CASE WHEN t.path IS NULL THEN path_k ELSE 4 - path_k END ORDER BY k) AS key
  FROM (SELECT page_id, det_idx, path, unnest(range(1, len(path) + 1)) AS k, unnest(path) AS path_k FROM placed) p LEFT JOIN turned t ON t.page_id = p.page_id AND t.path = p.path[1:p.k - 1] GROUP BY p.page_id, p.det_idx
)
SELECT p.page_id, p.det_idx, CAST(row_number() OVER (PARTITION BY p.page_id ORDER BY coalesce(k.key, []), CASE WHEN w.vertical THEN -p.a ELSE p.b END, CASE WHEN w.vertical THEN p.b ELSE p.a END, p.det_idx) - 1 AS INTEGER) AS ord
FROM placed p LEFT JOIN keyed k USING (page_id, det_idx) JOIN within w ON w.page_id = p.page_id AND w.path = p.path
"""
)


@query(XY_SQL)
def xy_cut_order(spark, sf_dir):
    """G5, G6 to G6e, A6, A7, A13, A14, J8, O1, O5, W1."""
    return O.page_order(lines(spark, sf_dir)).select("page_id", "det_idx", "ord")


@query()
def tolerance_sort(spark, sf_dir):
    """O2."""
    return O.tolerance_sorted(lines(spark, sf_dir)).select("page_id", "det_idx", "line_pos")


@query()
def dedup_lines(spark, sf_dir):
    """W2 after O2."""
    return O.deduplicated(lines(spark, sf_dir)).select("page_id", "det_idx", "line_pos")


NOTES_SQL = (
    PAGES
    + """, note AS (
  SELECT page_id, det_idx, row_number() OVER (PARTITION BY page_id ORDER BY det_idx) AS k,
    x1 - CASE WHEN w < h THEN w * 0.1 / 2 ELSE 0 END AS ax, y1 - CASE WHEN w < h THEN 0 ELSE h * 0.1 / 2 END AS ay,
    x1 + w + CASE WHEN w < h THEN w * 0.1 / 2 ELSE 0 END AS bx, y1 + h + CASE WHEN w < h THEN 0 ELSE h * 0.1 / 2 END AS ye
  FROM pg WHERE class_idx = 4
), listed AS (
  SELECT page_id, list({'k': k, 'ax': ax, 'ay': ay, 'bx': bx, 'ye': ye} ORDER BY k) AS free FROM note GROUP BY page_id
), step AS (
  SELECT page_id, 0 AS g, free, [free[1]] AS taken FROM listed WHERE false
  UNION ALL
  SELECT page_id, -1, free, CAST([] AS STRUCT(k BIGINT, ax DOUBLE, ay DOUBLE, bx DOUBLE, ye DOUBLE)[]) FROM listed
), walk AS (
  SELECT page_id, g, [{'k': x.k, 'ax': CAST(x.ax AS DOUBLE), 'ay': CAST(x.ay AS DOUBLE), 'bx': CAST(x.bx AS DOUBLE), 'ye': CAST(x.ye AS DOUBLE)} FOR x IN free] AS free, CAST([] AS BIGINT[]) AS taken FROM step
  UNION ALL
  SELECT page_id, g + 1,
    list_filter(free, lambda x: NOT (x.k = free[1].k OR (least(x.bx, free[1].bx) > greatest(x.ax, free[1].ax) AND least(x.ye, free[1].ye) > greatest(x.ay, free[1].ay)))),
    list_transform(list_filter(free, lambda x: x.k = free[1].k OR (least(x.bx, free[1].bx) > greatest(x.ax, free[1].ax) AND least(x.ye, free[1].ye) > greatest(x.ay, free[1].ay))), lambda x: x.k)
  FROM walk WHERE len(free) > 0
)
SELECT note.page_id, note.det_idx, CAST(g AS INTEGER) AS note_group FROM (SELECT page_id, g, unnest(taken) AS k FROM walk) t JOIN note USING (page_id, k)
"""
)


@query(NOTES_SQL)
def warichu_groups(spark, sf_dir):
    """J7, F24."""
    return O.grouped_notes(lines(spark, sf_dir)).select("page_id", "det_idx", "note_group")


WIDTH, HEIGHT = 1000, 1400


def tree(spark, sf_dir, smooth=False):
    return P.ordered_lists(B.element_lists(pages(spark, sf_dir)), WIDTH, HEIGHT, smooth)


def named_pages(spark, sf_dir):
    """Smoothed pages with a stand-in for recognised texts: the numbers of detections."""
    named = pages(spark, sf_dir).withColumn("string", F.concat(F.lit("line "), F.col("det_idx").cast("string")))
    return P.placed(B.element_lists(named, carry=("string",)), WIDTH, HEIGHT, True)


@query()
def page_sort(spark, sf_dir):
    """Whole pages (blocks, containers, lines) in reading order."""
    return tree(spark, sf_dir).where("tag = 'LINE'").select("page_id", "section", "pos", "child", "det_idx", "ord", "line_pos")


@query()
def smooth_order(spark, sf_dir):
    """G9, G9a, with the size of the page."""
    return tree(spark, sf_dir, True).where("tag = 'LINE'").select("page_id", "section", "pos", "child", "det_idx", "line_pos")


@query()
def page_chain_text(spark, sf_dir):
    """Detections to text: G2, G5, G7, G9, J5, T8's result, A11, A12."""
    return P.placed_texts(named_pages(spark, sf_dir))


@query()
def page_chain_xml(spark, sf_dir):
    """Detections to XML with ORDER and STRING: K2, M4, G2 to G9."""
    return P.placed_xml(named_pages(spark, sf_dir), WIDTH, HEIGHT)


#: Lines with their first container; the text blocks of a page as one list, merged child by child (``merged``); every element (``elements``).
MERGED = (
    PAGES
    + f""", line AS (
  SELECT * FROM pg WHERE class_idx IN {tuple(LINE_CLASSES)} AND conf >= 0.1
), ranked AS (
  SELECT l.page_id, l.det_idx, l.class_idx, CASE b.class_idx WHEN 0 THEN 1 WHEN 7 THEN 2 ELSE 3 END AS prio, b.det_idx AS block_idx,
    row_number() OVER (PARTITION BY l.page_id, l.det_idx ORDER BY CASE b.class_idx WHEN 0 THEN 1 WHEN 7 THEN 2 ELSE 3 END, b.det_idx) AS rn
  FROM line l JOIN pg b ON l.page_id = b.page_id AND b.class_idx IN (0, 7, 15)
    AND l.x1 + l.w / 2 BETWEEN b.x1 AND b.x1 + b.w AND l.y1 + l.h / 2 BETWEEN b.y1 AND b.y1 + b.h
), held AS MATERIALIZED (
  SELECT page_id, det_idx, class_idx, prio, block_idx FROM ranked WHERE rn = 1
), own AS (
  SELECT page_id, block_idx AS det_idx, list({{'c': class_idx, 'd': det_idx}}) AS m FROM held WHERE prio = 1 GROUP BY page_id, block_idx
), listed AS (
  SELECT page_id, list({{'i': det_idx, 'x1': x1, 'y1': y1, 'x2': x1 + w, 'y2': y1 + h, 'alive': true, 'm': coalesce(m, [])}} ORDER BY det_idx) AS s
  FROM pg LEFT JOIN own USING (page_id, det_idx) WHERE class_idx = 0 AND NOT (w < 5 AND h < 5) GROUP BY page_id
), folded AS (
  SELECT page_id, CAST(1 AS BIGINT) AS k, s FROM listed
  UNION ALL
  SELECT page_id, k + 1, CASE WHEN t IS NULL THEN s ELSE list_transform(range(1, len(s) + 1), lambda j: CASE
      WHEN j = t THEN {{'i': s[j].i, 'x1': s[j].x1, 'y1': s[j].y1, 'x2': s[j].x2, 'y2': s[j].y2, 'alive': true,
        'm': list_concat(s[j].m, CASE WHEN len(s[k].m) > 0 THEN s[k].m ELSE [{{'c': CAST(0 AS BIGINT), 'd': s[k].i}}] END)}}
      WHEN j = k THEN {{'i': s[j].i, 'x1': s[j].x1, 'y1': s[j].y1, 'x2': s[j].x2, 'y2': s[j].y2, 'alive': false, 'm': s[j].m[1:0]}}
      ELSE s[j] END) END
  FROM (
    SELECT page_id, k, s, list_filter(range(1, len(s) + 1), lambda j: j <> k AND s[j].alive
      AND power(greatest(0, s[j].x1 - s[k].x1, s[k].x2 - s[j].x2), 2) + power(greatest(0, s[j].y1 - s[k].y1, s[k].y2 - s[j].y2), 2) <= 2500)[1] AS t
    FROM folded WHERE k <= len(s)
  )
), merged AS MATERIALIZED (
  SELECT page_id, b.i AS det_idx, b.alive AS alive, CASE WHEN len(list_filter(b.m, lambda x: x.c <> 0)) > 0 THEN list_transform(b.m, lambda x: x.d) ELSE [] END AS members
  FROM (SELECT page_id, unnest(s) AS b FROM folded WHERE k = len(s) + 1)
)
"""
)

ELEMENTS = (
    MERGED
    + f""", named AS (
  SELECT page_id, det_idx, class_idx, conf, x1 AS x, y1 AS y, w, h, {[o for _, o in CLASSES]}[class_idx + 1] AS label FROM pg
), head AS (
  SELECT page_id, CASE class_idx WHEN 15 THEN 0 ELSE 1 END AS section, row_number() OVER (PARTITION BY page_id, class_idx ORDER BY det_idx) - 1 AS pos, det_idx, label AS type, 'BLOCK' AS tag FROM named WHERE class_idx IN (7, 15)
  UNION ALL
  SELECT page_id, 2, row_number() OVER (PARTITION BY page_id ORDER BY det_idx) - 1, det_idx, NULL, 'TEXTBLOCK' FROM merged WHERE alive
), inside AS (
  SELECT head.page_id, section, pos, held.det_idx FROM head JOIN held ON held.page_id = head.page_id AND held.block_idx = head.det_idx AND held.prio = 3 - section WHERE section < 2
  UNION ALL
  SELECT page_id, section, pos, unnest(members) FROM head JOIN merged USING (page_id, det_idx) WHERE section = 2
), elements AS (
  SELECT page_id, section, pos, 0 AS child, tag, type, x, y, w, h, conf, det_idx FROM head JOIN named USING (page_id, det_idx)
  UNION ALL
  SELECT page_id, section, pos, row_number() OVER (PARTITION BY page_id, section, pos ORDER BY class_idx, det_idx), 'LINE', CASE class_idx WHEN 0 THEN '{CLASSES[1][1]}' ELSE label END, x, y, w, h, conf, det_idx
  FROM inside JOIN named USING (page_id, det_idx)
  UNION ALL
  SELECT page_id, section, pos, 1, 'LINE', '{CLASSES[1][1]}', x, y, w, h, NULL, det_idx FROM head JOIN merged USING (page_id, det_idx) JOIN named USING (page_id, det_idx) WHERE section = 2 AND len(members) = 0 AND w >= 5 AND h >= 5
  UNION ALL
  SELECT page_id, 3, row_number() OVER (PARTITION BY page_id ORDER BY class_idx, det_idx) - 1, 0, 'LINE', label, x, y, w, h, conf, det_idx
  FROM named SEMI JOIN line USING (page_id, det_idx) ANTI JOIN held USING (page_id, det_idx)
  UNION ALL
  SELECT page_id, 4, row_number() OVER (PARTITION BY page_id ORDER BY class_idx, det_idx) - 1, 0, 'BLOCK', label, x, y, w, h, conf, det_idx
  FROM named WHERE class_idx IN {tuple(i for i, (n, _) in enumerate(CLASSES) if n.startswith("block_") and n != "block_table")} AND conf >= 0.1
)
"""
)

XML_SQL = (
    ELEMENTS
    + """, written AS (
  SELECT page_id, section, pos, child, tag, printf('%.3f', conf) AS c, concat_ws(',', x, y, x + w, y, x + w, y + h, x, y + h) AS points,
    printf(' TYPE="%s" X="%d" Y="%d" WIDTH="%d" HEIGHT="%d"', type, x, y, w, h) || coalesce(printf(' CONF="%.3f"', conf), '') AS attrs
  FROM elements
), inner_lines AS (
  SELECT page_id, section, pos, string_agg(chr(10) || '    <LINE' || attrs || '></LINE>', '' ORDER BY child) AS xml FROM written WHERE child > 0 GROUP BY page_id, section, pos
), parts AS (
  SELECT page_id, section, pos, CASE WHEN tag = 'TEXTBLOCK'
    THEN '  <TEXTBLOCK CONF="' || c || '">' || chr(10) || '    <SHAPE>' || chr(10) || '      <POLYGON POINTS="' || points || '"></POLYGON>' || chr(10) || '    </SHAPE>' || coalesce(i.xml, '') || chr(10) || '  </TEXTBLOCK>'
    ELSE '  <' || tag || attrs || '>' || coalesce(i.xml || chr(10) || '  ', '') || '</' || tag || '>' END AS xml
  FROM (SELECT * FROM written WHERE child = 0) LEFT JOIN inner_lines i USING (page_id, section, pos)
)
SELECT page_id, '<PAGE WIDTH="1000" HEIGHT="1400">' || chr(10) || string_agg(xml, chr(10) ORDER BY section, pos) || chr(10) || '</PAGE>' AS xml FROM parts GROUP BY page_id
"""
)


@query(MERGED + "SELECT page_id, det_idx, alive, CAST(len(members) AS INTEGER) AS n_members FROM merged")
def block_merge(spark, sf_dir):
    """J5, J6."""
    return B.merged_blocks(pages(spark, sf_dir)).select("page_id", "det_idx", "alive", F.size("members").alias("n_members"))


@query(
    ELEMENTS
    + "SELECT page_id, section, CAST(pos AS INTEGER) AS pos, CAST(child AS INTEGER) AS child, tag, type, x, y, w, h, conf, det_idx FROM elements"
)
def page_elements(spark, sf_dir):
    """G1, G2 to G2d, O8."""
    return B.page_elements(pages(spark, sf_dir))


@query(
    ELEMENTS
    + """SELECT e.page_id, CAST(row_number() OVER (PARTITION BY e.page_id ORDER BY e.section, e.pos, e.child) - 1 AS INTEGER) AS line_no, e.det_idx, up.det_idx AS parent
FROM elements e LEFT JOIN elements up ON e.child > 0 AND up.child = 0 AND up.page_id = e.page_id AND up.section = e.section AND up.pos = e.pos WHERE e.tag = 'LINE'"""
)
def line_numbers(spark, sf_dir):
    """Lines in document order with their parents."""
    return B.line_elements(B.element_lists(pages(spark, sf_dir))).select("page_id", "line_no", "det_idx", "parent")


@query(XML_SQL)
def xml_export(spark, sf_dir):
    """K2, T9, T10, T12."""
    return B.page_xml(B.page_elements(pages(spark, sf_dir)), 1000, 1400)


def tiles(spark, sf_dir):
    """Vectors as pictures of 4 by 4 RGBA pixels."""

    @F.pandas_udf("binary")
    def content(e: pd.Series) -> pd.Series:
        return e.map(lambda v: (np.floor(np.abs(np.asarray(v)) * 255).astype(np.int64) % 256).astype(np.uint8).tobytes())

    return read(spark, sf_dir, "embeddings").select("vec_id", content("embedding").alias("content"), F.lit(4).alias("width"), F.lit(4).alias("height"))


def _digest(image):
    return [image["width"].alias("width"), image["height"].alias("height"), F.md5(image["content"]).alias("digest")]


#: The pixels of every vector's picture, four bytes each, and the picture of the pixels at given places.
CROP_SQL = """
SELECT vec_id, {w} AS width, {h} AS height, md5(unhex(string_agg(printf('%02x', CAST(floor(abs(embedding[1 + ({y} * 4 + {x}) * 4 + c]) * CAST(255 AS FLOAT)) AS BIGINT) % 256), '' ORDER BY j, i, c))) AS digest
FROM embeddings, (SELECT range AS j FROM range({h})) rows, (SELECT range AS i FROM range({w})) columns, (SELECT range AS c FROM range(4)) signs
GROUP BY vec_id
"""


@query(CROP_SQL.format(w=5, h=5, x="(1 + greatest(0, least(i - 1, 2)))", y="greatest(0, least(j - 1, 2))"))
def raster_crop(spark, sf_dir):
    """R-a, D4."""
    c = R.cropped(F.col("content"), F.col("width"), F.col("height"), F.lit(1), F.lit(0), F.lit(5), F.lit(3))
    return tiles(spark, sf_dir).select("vec_id", c.alias("c")).select("vec_id", *_digest(F.col("c")))


@query(CROP_SQL.format(w=3, h=3, x="(1 + i)", y="j"))
def raster_clamp(spark, sf_dir):
    """R-b: the part inside the picture alone."""
    return tiles(spark, sf_dir).select("vec_id", R.image_udf(lambda a: R.crop_clamped(a, 1, 0, 5, 3))("content", "width", "height").alias("c")).select("vec_id", *_digest(F.col("c")))


@query()
def raster_letterbox(spark, sf_dir):
    """R-c."""
    return tiles(spark, sf_dir).select("vec_id", R.image_udf(lambda a: R.letterboxed(a, 16))("content", "width", "height").alias("c")).select("vec_id", *_digest(F.col("c")))


@query()
def raster_upright(spark, sf_dir):
    """R-d."""
    return tiles(spark, sf_dir).select("vec_id", R.image_udf(lambda a: R.upright(a[:, :2], 24, 4))("content", "width", "height").alias("c")).select("vec_id", *_digest(F.col("c")))


@query()
def raster_warp(spark, sf_dir):
    """R-l, R-m, R-n, D5."""
    m = R.homography([(0, 0), (3, 0), (3, 3), (0, 3)], [(0, 0), (7, 1), (6, 7), (1, 6)])
    return tiles(spark, sf_dir).select("vec_id", R.image_udf(lambda a: R.warped(a, m, 8, 8))("content", "width", "height").alias("c")).select("vec_id", *_digest(F.col("c")))


@query()
def png_encode(spark, sf_dir):
    """K6."""

    @F.pandas_udf("binary")
    def png(content: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([I.encode_png(c, w, h) for c, w, h in zip(content, width, height)])

    b = png("content", "width", "height")
    return tiles(spark, sf_dir).select("vec_id", b.alias("b")).select("vec_id", F.octet_length("b").alias("n_bytes"), F.hex(F.substring("b", 1, 8)).alias("mark"))


@query(CROP_SQL.format(w=4, h=4, x="i", y="j"))
def png_round_trip(spark, sf_dir):
    """A PNG of every picture, read back."""

    @F.pandas_udf("binary")
    def png(content: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([I.encode_png(c, w, h) for c, w, h in zip(content, width, height)])

    files = tiles(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), png("content", "width", "height").alias("content"))
    back = I.decoded_content(files)
    return back.select(F.col("path").cast("long").alias("vec_id"), "width", "height", F.md5("content").alias("digest"))


@query(CROP_SQL.format(w=2, h=2, x="(i + 1)", y="(j + 1)"))
def raster_shift(spark, sf_dir):
    """R-l, R-m, R-n: the middle of every picture by a homography of four points."""
    m = R.homography([(1, 1), (2, 1), (2, 2), (1, 2)], [(0, 0), (1, 0), (1, 1), (0, 1)])
    return tiles(spark, sf_dir).select("vec_id", R.image_udf(lambda a: R.warped(a, m, 2, 2))("content", "width", "height").alias("c")).select("vec_id", *_digest(F.col("c")))


@query(
    "SELECT vec_id, 4 AS width, 4 AS height, md5(unhex(string_agg(printf('%02x', CASE WHEN j < 3 THEN CAST(floor(abs(embedding[1 + (j * 4 + i) * 4 + c]) * CAST(255 AS FLOAT)) AS BIGINT) % 256 WHEN c = 3 THEN 255 ELSE 0 END), '' ORDER BY j, i, c))) AS digest "
    "FROM embeddings, range(4) js(j), range(4) ks(i), range(4) cs(c) GROUP BY vec_id"
)
def raster_square(spark, sf_dir):
    """R-c: the upper three rows of every picture on a black square of their longer side."""
    return tiles(spark, sf_dir).select("vec_id", R.image_udf(lambda a: R.letterboxed(a[:3], 4))("content", "width", "height").alias("c")).select("vec_id", *_digest(F.col("c")))


@query(CROP_SQL.format(w=4, h=2, x="(1 - j)", y="i"))
def raster_turn(spark, sf_dir):
    """R-d: the left half of every picture, which is tall, turned to a line of the same size."""
    return tiles(spark, sf_dir).select("vec_id", R.image_udf(lambda a: R.upright(a[:, :2], 4, 2))("content", "width", "height").alias("c")).select("vec_id", *_digest(F.col("c")))


@query()
def recognise_stub(spark, sf_dir):
    """R-h, R-j, R-k, R-o, U2: the model interface with a stub that reads mean values."""

    def provider():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            crops = [R.pixels(c, w, h) for c, w, h in zip(batch.content, batch.width, batch.height)]
            texts = R.recognise_lines(crops, lambda x: ["".join(chr(97 + int(v) % 26) for v in a.mean(axis=(0, 2))) * (30 if a.shape[1] == 4 and a.sum() % 2 else 1) for a in x])
            return pd.DataFrame({"vec_id": batch.vec_id, "text": texts})

        return model

    return R.infer(tiles(spark, sf_dir), provider, "vec_id long, text string")


#: Whole-number weights of a line model of six signs (0 ends a text) over four steps, and the pixels it sees, so that its scores are exact.
SIGNS = list("abcde")


def line_weights() -> np.ndarray:
    """(channel blue to red, row, sign)."""
    c, y, v = np.meshgrid(np.arange(3), np.arange(2), np.arange(6), indexing="ij")
    return (7 * c + 3 * y + 5 * v * v + c * v) % 11 - 5


def exact_line_model():
    """Weights over the pixels of each column of a picture of 4 by 2."""
    w = line_weights()
    return lambda tensor: np.einsum("ncys,cyv->nsv", np.rint((tensor.astype(float) + 1) * 127.5), w)


_PIXEL = "CAST(floor(abs(embedding[1 + {at}]) * CAST(255 AS FLOAT)) AS BIGINT) % 256"


@query(
    f"""WITH crop AS (
  SELECT vec_id, d, s, v, sum(({_PIXEL.format(at="(CASE d WHEN 0 THEN y * 4 + s ELSE s * 4 + 1 - y END) * 4 + 2 - c")}) * ((7 * c + 3 * y + 5 * v * v + c * v) % 11 - 5)) AS score
  FROM embeddings, range(2) ds(d), range(4) ss(s), range(6) vs(v), range(3) cs(c), range(2) ys(y) GROUP BY vec_id, d, s, v
), best AS (
  SELECT vec_id, d, s, min(v) AS sign FROM (SELECT *, max(score) OVER (PARTITION BY vec_id, d, s) AS most FROM crop) WHERE score = most GROUP BY vec_id, d, s
), ended AS (
  SELECT vec_id, d, coalesce(min(CASE WHEN sign = 0 THEN s END), 4) AS n FROM best GROUP BY vec_id, d
), spelt AS (
  SELECT b.vec_id, b.d, coalesce(string_agg(chr(96 + CAST(sign AS INTEGER)), '' ORDER BY s) FILTER (WHERE s < n), '') AS string FROM best b JOIN ended USING (vec_id, d) GROUP BY b.vec_id, b.d
)
SELECT vec_id, d AS det_idx, string FROM spelt UNION ALL SELECT vec_id, 2, '' FROM embeddings"""
)
def recognise_chain(spark, sf_dir):
    """R-b, R-d, R-f, R-g, R-j, A10, T8: lines of pictures through a model in batches, to texts. The upper half, the left half (turned), and a line without area."""
    from ..operators.recognition import recognised

    t = tiles(spark, sf_dir).withColumnRenamed("vec_id", "page_id")
    place = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("det_idx", "x", "y", "w", "h"), p)]) for p in ((0, 0, 0, 4, 2), (1, 0, 0, 2, 4), (2, 1, 1, 0, 4))])
    return recognised(t, t.select("page_id", F.inline(place)), exact_line_model, SIGNS, "exact lines", shape=(4, 2)).select(F.col("page_id").alias("vec_id"), "det_idx", "string")


def exact_page_model():
    """A detection for each quarter of a picture of 4 by 4, from the sum of its reds."""

    def model(tensor: np.ndarray) -> list[dict]:
        red = np.rint((tensor[:, 0].astype(float) * 0.229 + 0.485) * 255).astype(np.int64)
        sums = red.reshape(-1, 2, 2, 2, 2).sum(axis=(2, 4)).reshape(-1, 4)
        box = np.array([[0, 0, 2, 2], [2, 0, 4, 2], [0, 2, 2, 4], [2, 2, 4, 4]], np.float32)
        return [{"label": s % 19 + 1, "box": box, "score": (s % 97 / 97).astype(np.float32), "char_count": s % 7} for s in sums]

    return model


@query(
    f"""WITH q AS (
  SELECT vec_id, k, CAST(sum({_PIXEL.format(at="((k // 2) * 2 + j) * 16 + ((k % 2) * 2 + i) * 4")}) AS BIGINT) AS s FROM embeddings, range(4) ks(k), range(2) js(j), range(2) "is"(i) GROUP BY vec_id, k
)
SELECT vec_id AS page_id, CAST(k AS INTEGER) AS det_idx, CAST(s % 19 AS INTEGER) AS class_idx, coalesce({[n for n, _ in CLASSES]}[s % 19 + 1], 'class_' || (s % 19)) AS class_name, CAST(CAST((s % 97) / 97.0::DOUBLE AS FLOAT) AS DOUBLE) AS conf,
  CAST(k % 2 * 2 AS INTEGER) AS x1, CAST(k // 2 * 2 AS INTEGER) AS y1, CAST(k % 2 * 2 + 2 AS INTEGER) AS x2, CAST(k // 2 * 2 + 2 AS INTEGER) AS y2, CAST(s % 7 AS BIGINT) AS pred_char_cnt
FROM q WHERE CAST((s % 97) / 97.0::DOUBLE AS FLOAT) > CAST(0.25 AS FLOAT)"""
)
def detect_chain(spark, sf_dir):
    """R-c, R-e, R-g, R-h, R-i, F1 to F4, T13: pictures through a detector in batches, to detections."""
    from ..operators.recognition import detected
    from ..sources.dims import classes

    found, _ = detected(tiles(spark, sf_dir).withColumnRenamed("vec_id", "image_id"), exact_page_model, "exact pages", classes(spark), side=4)
    return found


@query(r"SELECT doc_id, regexp_replace(text, '\A[A-Z]+', '') AS text_clean FROM documents")
def regex_flags(spark, sf_dir):
    """T1 with the flag y (sticky)."""
    from ..functions.text import Rule, clean

    return read(spark, sf_dir, "documents").select("doc_id", clean(spark, F.col("text"), [Rule("[A-Z]", "", "gy")]).alias("text_clean"))


__all__ = ["det"]
