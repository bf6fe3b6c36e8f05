"""Geometry as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Round half toward plus infinity."""
    return F.floor(x + F.lit(0.5))


def rescale(box: Column, width: Column, height: Column, side: int) -> Column:
    """A detector coordinate in image pixels: the longer side of the image was ``side``."""
    return half_up(box * F.greatest(width, height) / F.lit(float(side)))


def corners_to_rect(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(F.least(x1, x2).alias("x"), F.least(y1, y2).alias("y"), F.abs(x2 - x1).alias("width"), F.abs(y2 - y1).alias("height"))


def device_rect(x: Column, y: Column, w: Column, h: Column, dpr: Column, image_w: Column, image_h: Column) -> Column:
    """A selection in device pixels, clamped to the image; a ratio of 0 counts as 1."""
    d = F.when(dpr == 0, F.lit(1.0)).otherwise(dpr)
    sx, sy = F.greatest(F.lit(0), half_up(x * d)), F.greatest(F.lit(0), half_up(y * d))
    return F.struct(
        sx.alias("sx"), sy.alias("sy"), F.greatest(F.lit(1), F.least(image_w - sx, half_up(w * d))).alias("sw"), F.greatest(F.lit(1), F.least(image_h - sy, half_up(h * d))).alias("sh")
    )


def padding(w: Column, h: Column, ratio: float = 0.3, most: int = 50) -> Column:
    """Pixels to pad on each side; 0 without a positive ratio."""
    return F.lit(0) if ratio <= 0 else F.least(half_up(F.least(w, h) * ratio), F.lit(most))


def padded_rect(x: Column, y: Column, w: Column, h: Column, image_w: Column, image_h: Column, ratio: float = 0.3, most: int = 50) -> Column:
    p = padding(w, h, ratio, most)
    px, py = F.greatest(x - p, F.lit(0)), F.greatest(y - p, F.lit(0))
    return F.struct(px.alias("px"), py.alias("py"), (F.least(x + w + p, image_w) - px).alias("pw"), (F.least(y + h + p, image_h) - py).alias("ph"))


def canvas_point(client: Column, left: Column, canvas_size: Column, client_size: Column) -> Column:
    """A pointer position in canvas pixels."""
    return (client - left) * canvas_size / client_size


def in_box(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Closed containment."""
    return px.between(x1, x2) & py.between(y1, y2)


def signed_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance to the border of a rectangle: positive inside, negative outside."""
    zero = F.lit(0)
    outside = F.sqrt(F.pow(F.greatest(x1 - px, zero, px - x2), 2) + F.pow(F.greatest(y1 - py, zero, py - y2), 2))
    inside = F.least(px - x1, x2 - px, py - y1, y2 - py)
    return F.when(in_box(px, py, x1, y1, x2, y2), inside.cast("double")).otherwise(-outside)


def polygon_box(points: Column) -> Column:
    """x, y, w, h of an array<struct<x,y>>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(x.alias("bx"), y.alias("by"), (F.array_max(xs) - x).alias("bw"), (F.array_max(ys) - y).alias("bh"))


def point_in_polygon(px: Column, py: Column, points: Column) -> Column:
    """1 inside, 0 on an axis-parallel edge, -1 outside; even-odd rule over an array<struct<x,y>>."""
    edges = F.arrays_zip(points.alias("a"), F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1)).alias("b"))
    names = ("0", "1")

    def ends(e: Column) -> tuple[Column, Column]:
        return e[names[0]], e[names[1]]

    pairs = F.transform(edges, lambda e: F.struct(e.getField("a").alias("a"), e.getField("b").alias("b")))

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        flat = (a["y"] == b["y"]) & (py == a["y"]) & px.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
        steep = (a["x"] == b["x"]) & (px == a["x"]) & py.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        return flat | steep

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"])

    inside = F.size(F.filter(pairs, crossed)) % 2 == 1
    return F.when(F.exists(pairs, on), 0).when(inside, 1).otherwise(-1)


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Length of the overlap of two ranges, negative if they are apart."""
    return F.least(a2, b2) - F.greatest(a1, b1)


def overlap_over_smaller(a: tuple, b: tuple) -> Column:
    """Intersection over the smaller area of two (x, y, w, h); 0 without area."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    inter = F.greatest(overlap(ax, ax + aw, bx, bx + bw), F.lit(0)) * F.greatest(overlap(ay, ay + ah, by, by + bh), F.lit(0))
    least = F.least(aw * ah, bw * bh)
    return F.when(least == 0, F.lit(0.0)).otherwise(inter / least)


def mixed_iou(a: tuple, b: tuple) -> Column:
    """The leaf-assignment score of two (x0, y0, x1, y1).

    One pixel is added to the intersection's sides; the two areas run from each box's start to the other's
    end, so it isn't a true intersection over union; 0 if the union isn't positive.
    """
    inter = F.greatest(overlap(a[0], a[2], b[0], b[2]) + 1, F.lit(0)) * F.greatest(overlap(a[1], a[3], b[1], b[3]) + 1, F.lit(0))
    union = (a[2] - b[0] + 1) * (a[3] - b[1] + 1) + (b[2] - a[0] + 1) * (b[3] - a[1] + 1) - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(inter / union)


def dilated(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A narrow box widened by a tenth of its short side, half of it on each end, along that side alone."""
    narrow = w < h
    step = F.when(narrow, w).otherwise(h) * 0.1 / 2
    zero = F.lit(0.0)
    dx, dy = F.when(narrow, step).otherwise(zero), F.when(narrow, zero).otherwise(step)
    return F.struct((x - dx).alias("dx1"), (y - dy).alias("dy1"), (x + w + dx).alias("dx2"), (y + h + dy).alias("dy2"))


def any_prefix(c: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


#: The least side of a selection that counts, by place; the viewer wants more than five pixels.
LEAST_SIDE = {"content": 4, "viewer": 6}


def is_selected(rect: Column, place: str = "content") -> Column:
    """Whether both sides of a selection (whole pixels) are long enough."""
    return (rect["width"] >= LEAST_SIDE[place]) & (rect["height"] >= LEAST_SIDE[place])


def polygon_distance(px: Column, py: Column, corners: list[tuple[float, float]]) -> Column:
    """Distance to the border of a closed polygon: positive inside (even-odd rule), negative outside."""
    nearest, crossed = [], []
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]]):
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length)) if length else F.lit(0.0)
        nearest.append(F.sqrt(F.pow(px - ax - along * dx, 2) + F.pow(py - ay - along * dy, 2)))
        if dy:
            crossed.append(F.when(((F.lit(ay) > py) != (F.lit(by) > py)) & (px < dx * (py - ay) / dy + ax), 1).otherwise(0))
    inside = reduce(lambda x, y: x + y, crossed, F.lit(0)) % 2 == 1
    distance = F.least(*nearest) if len(nearest) > 1 else nearest[0]
    return F.when(inside, distance).otherwise(-distance)
