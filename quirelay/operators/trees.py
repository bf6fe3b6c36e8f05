"""Trees of any depth in tables (tree, id, parent, pos): document order, search by tag, parents and ancestors.

Each level is one step of a recursive query of Spark's SQL; a node's path is the list of its places from the root down, and paths in
order are the document order. Trees are apart from each other, so all of them walk down together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels a tree may have; a deeper one (or a circle below a root) raises an error.
DEPTH = 1000


def walked(nodes: DataFrame, tree: str = "tree", depth: int = DEPTH) -> DataFrame:
    """``nodes`` with level (0 at a root), path (array of places) and root.

    A node without a parent is a root. ``pos`` orders the children of a parent, equal ones go by id. Nodes that no root reaches have no row.
    """
    spark, name = nodes.sparkSession, f"tree_{uuid.uuid4().hex}"
    place = F.row_number().over(Window.partitionBy(tree, "parent").orderBy("pos", "id"))
    nodes.select(F.col(tree).alias("t"), "id", "parent", place.cast("long").alias("place")).createOrReplaceTempView(name)
    # Rows are those of the table, which no number bounds; read when the plan runs, so it stays set.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    found = spark.sql(f"""
        WITH RECURSIVE down (t, id, root, level, path) MAX RECURSION LEVEL {depth} AS (
          SELECT t, id, id, 0, array(place) FROM {name} WHERE parent IS NULL
          UNION ALL
          SELECT n.t, n.id, d.root, d.level + 1, concat(d.path, array(n.place)) FROM down d JOIN {name} n ON n.t = d.t AND n.parent = d.id
        ) SELECT t AS __tree, id AS __id, root, level, path FROM down""")
    return nodes.join(found, (nodes[tree] == found["__tree"]) & (nodes["id"] == found["__id"])).drop("__tree", "__id")


def find_all(walk: DataFrame, match: Column, tree: str = "tree") -> DataFrame:
    """The nodes below a root that match, with their number in document order within their tree; the roots themselves aren't searched."""
    return walk.where(match & (F.col("level") > 0)).withColumn("number", F.row_number().over(Window.partitionBy(tree).orderBy("path")) - 1)


def with_parent(walk: DataFrame, columns: list[str], tree: str = "tree") -> DataFrame:
    """``walk`` with ``columns`` of each node's parent as parent_<column>; null at a root."""
    up = walk.select(F.col(tree).alias("__t"), F.col("id").alias("__p"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    return walk.join(up, (walk[tree] == up["__t"]) & (walk["parent"] == up["__p"]), "left").drop("__t", "__p")


def rolled_up(walk: DataFrame, measure: Column, tree: str = "tree") -> DataFrame:
    """(tree, id, size, total) of each node: nodes and sum of ``measure`` in the part of the tree that hangs on it, itself included.

    Each node gives its measure to every node on its path, so rows grow with the depth, not with the square of the number of nodes.
    """
    given = walk.select(F.col(tree), measure.alias("m"), F.explode(F.expr("transform(sequence(1, size(path)), k -> slice(path, 1, k))")).alias("up"))
    sums = given.groupBy(tree, "up").agg(F.count(F.lit(1)).alias("size"), F.sum("m").alias("total"))
    own = walk.select(F.col(tree), "id", F.col("path").alias("up"))
    return own.join(sums, [tree, "up"]).select(tree, "id", "size", "total")
