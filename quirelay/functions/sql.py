"""Functions for SQL: ``clean_text`` and the table function ``xy_cut``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from ..operators.order import xy_cut
from .text import Rule, replacing


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, rules: list[Rule] = ()) -> None:
    """``clean_text(text)`` with the given rules, and ``xy_cut(TABLE(...) PARTITION BY page_id)``."""
    text = "text"
    for rule in (r for r in rules if r.enabled and r.pattern):
        if parts := replacing(spark, rule):
            text = f"regexp_replace({text}, {_quoted(parts[0])}, {_quoted(parts[1])})"
    # A function of SQL itself: the same built-in chain as the column form.
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION clean_text(text STRING) RETURNS STRING RETURN {text}")

    @F.udtf(returnType="page_id long, det_idx long, ord int")
    class XyCut:
        def __init__(self):
            self.rows: list[tuple] = []

        def eval(self, row: Row) -> None:
            self.rows.append((row["page_id"], row["det_idx"], (row["x0"], row["y0"], row["x1"], row["y1"])))

        def terminate(self) -> Iterator[tuple]:
            rows = sorted(self.rows, key=lambda r: r[1])
            for (page, i, _), o in zip(rows, xy_cut([b for *_, b in rows])):
                yield page, i, o

    spark.udtf.register("xy_cut", XyCut)
