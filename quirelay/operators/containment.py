"""Lines and their containers: equi-join on page and grid cell, range condition, first match by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .detections import LINE_CLASSES

#: Container classes by priority: text block, advertisement, table.
PRIORITY = {0: 1, 7: 2, 15: 3}


def split(det: DataFrame, least: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(lines with enough score, containers)."""
    lines = det.where(F.col("class_idx").isin(LINE_CLASSES) & (F.col("conf") >= least))
    prio = F.create_map(*[F.lit(v) for kv in PRIORITY.items() for v in kv])
    boxes = det.where(F.col("class_idx").isin(list(PRIORITY))).select(
        "page_id", F.col("det_idx").alias("block_idx"), prio[F.col("class_idx").cast("int")].alias("prio"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"), (F.col("x1") + F.col("w")).alias("bx2"), (F.col("y1") + F.col("h")).alias("by2")
    )
    return lines, boxes


#: Side of a grid cell in pixels.
CELL = 512


def first_container(det: DataFrame, least: float = 0.1, cell: int = CELL) -> DataFrame:
    """Each line in some container, with the first one by (priority, detection order) that holds its centre.

    The page's plane is cut into cells: a container has a row for each cell it touches, a line one for that of its centre, and cell
    and page are the key. So a page of any number of boxes is no single group, and each pair meets once at most.
    """
    lines, boxes = split(det, least)
    at = lambda v: F.floor(v / F.lit(cell))
    cx, cy = F.col("x1") + F.col("w") / 2, F.col("y1") + F.col("h") / 2
    lines = lines.select("page_id", "det_idx", "class_idx", cx.alias("cx"), cy.alias("cy"), at(cx).alias("cell_x"), at(cy).alias("cell_y"))
    whole = boxes.where((F.col("bx1") <= F.col("bx2")) & (F.col("by1") <= F.col("by2")))
    wide = whole.withColumn("cell_x", F.explode(F.sequence(at(F.col("bx1")), at(F.col("bx2")))))
    cells = wide.withColumn("cell_y", F.explode(F.sequence(at(F.col("by1")), at(F.col("by2")))))
    found = lines.join(cells, ["page_id", "cell_x", "cell_y"]).where(F.col("cx").between(F.col("bx1"), F.col("bx2")) & F.col("cy").between(F.col("by1"), F.col("by2")))
    # The minimum is pre-aggregated on the map side: no sort of all matches.
    best = found.groupBy("page_id", "det_idx", "class_idx").agg(F.min(F.struct("prio", "block_idx")).alias("m"))
    return best.select("page_id", "det_idx", "class_idx", F.col("m.prio").alias("prio"), F.col("m.block_idx").alias("block_idx"))


def independent_lines(det: DataFrame, least: float = 0.1) -> DataFrame:
    lines, _ = split(det, least)
    return lines.join(first_container(det, least).select("page_id", "det_idx"), ["page_id", "det_idx"], "left_anti")


def merge_candidates(det: DataFrame, reach: int = 50) -> DataFrame:
    """Pairs of text blocks of a page where all corners of the child are within ``reach`` pixels of the parent."""
    blocks = det.where("class_idx = 0").select("page_id", "det_idx", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"))
    child = blocks.select("page_id", *[F.col(c).alias("c_" + c) for c in ("det_idx", "x1", "y1", "x2", "y2")])
    parent = blocks.select("page_id", *[F.col(c).alias("p_" + c) for c in ("det_idx", "x1", "y1", "x2", "y2")])

    def far(x: str, y: str):
        dx = F.greatest(F.col("p_x1") - F.col(x), F.lit(0), F.col(x) - F.col("p_x2"))
        dy = F.greatest(F.col("p_y1") - F.col(y), F.lit(0), F.col(y) - F.col("p_y2"))
        return dx * dx + dy * dy

    near = F.greatest(far("c_x1", "c_y1"), far("c_x2", "c_y1"), far("c_x1", "c_y2"), far("c_x2", "c_y2")) <= reach * reach
    # A coarse range condition first, so that most pairs are dropped before the distances.
    box = (F.col("c_x1") >= F.col("p_x1") - reach) & (F.col("c_x2") <= F.col("p_x2") + reach) & (F.col("c_y1") >= F.col("p_y1") - reach) & (F.col("c_y2") <= F.col("p_y2") + reach)
    return child.join(parent, "page_id").where((F.col("c_det_idx") != F.col("p_det_idx")) & box & near).select("page_id", F.col("c_det_idx").alias("child"), F.col("p_det_idx").alias("parent"))
