"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step groups links by vertex with map-side minima only (no vertex's neighbours are collected), and
its result is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import drop_durable, durable

#: Bytes that a step handles for each link, about: both directions and their minima.
LINK_BYTES = 128


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large-star links each larger neighbour to the least of the neighbourhood, small-star each smaller or equal one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex of a link; the component is the least vertex in it. ``edges`` is read twice, so it should be a durable table."""
    spark = edges.sparkSession
    now = durable(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "links", edges.count() * LINK_BYTES)
    most = now.count() * LINK_BYTES
    seen = None
    while True:
        new = durable(_star(_star(now, True), False), "links", most)
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        most = mark[0] * LINK_BYTES
        drop_durable(spark, now)
        now = new
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(now.select(F.col("b").alias("vertex"), F.col("b").alias("component"))).distinct()
