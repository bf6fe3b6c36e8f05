"""Detector output: filters, rescaling, names, and per-class positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import half_up, rescale
from ..sources.dims import CLASSES, MIN_SCORE

LINE_CLASSES = [i for i, (n, _) in enumerate(CLASSES) if n.startswith("line_")]


def with_scores_above(raw: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """Strictly above: a score equal to the bound is dropped."""
    return raw.where(F.col("score") > least)


def postprocess(raw: DataFrame, images: DataFrame, classes: DataFrame, side: int, least: float = MIN_SCORE) -> DataFrame:
    """Raw detections to the detections table: score filter, rescale, label - 1, names, missing counts as 0."""
    named = F.coalesce(F.col("class_name"), F.format_string("class_%d", F.col("class_idx"))).alias("class_name")
    boxes = with_scores_above(raw, least).join(images.select("image_id", "width", "height"), "image_id").withColumn("class_idx", (F.col("label") - 1).cast("int"))
    corner = [rescale(F.col("box")[k], F.col("width"), F.col("height"), side).cast("int").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    count = F.coalesce(F.col("char_count"), F.lit(0)).alias("pred_char_cnt") if "char_count" in raw.columns else F.lit(0).cast("long").alias("pred_char_cnt")
    # 17 rows.
    return boxes.join(F.broadcast(classes), "class_idx", "left").select(F.col("image_id").alias("page_id"), "det_idx", "class_idx", named, F.col("score").cast("double").alias("conf"), *corner, count)


def known_classes(det: DataFrame) -> DataFrame:
    return det.where(F.col("class_idx").between(0, len(CLASSES) - 1))


def class_positions(det: DataFrame) -> DataFrame:
    """0-based position within page and class, in detection order."""
    return det.withColumn("cls_pos", F.row_number().over(Window.partitionBy("page_id", "class_idx").orderBy("det_idx")) - 1)


def without_tiny_blocks(det: DataFrame, least: int = 5) -> DataFrame:
    """Text blocks go if both sides are shorter than ``least``."""
    return det.where(~((F.col("class_idx") == 0) & (F.col("w") < least) & (F.col("h") < least)))


def lines_above(det: DataFrame, least: float = 0.1) -> DataFrame:
    """Containers stay whatever their score."""
    return det.where(F.col("class_idx").isin(0, 7, 15) | (F.col("conf") >= least))


def line_rect(x1, y1, x2, y2) -> list:
    return [half_up(x1).alias("x"), half_up(y1).alias("y"), half_up(x2 - x1).alias("w"), half_up(y2 - y1).alias("h")]
