"""Stored rules, settings and message catalogues, and notices; sinks of results are in ``sinks``."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MESSAGES, RULES

SETTINGS = "show_result_alert boolean"


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Stored rules; a folder without rows is an empty list."""
    return spark.read.schema(RULES).json(path)


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(df: DataFrame, path: str) -> None:
    """Replace the whole table, which ``df`` may read.

    Rows are written beside it first: if that fails, the old table stays as it is. Then the folders change places.
    """
    spark, tag = df.sparkSession, uuid.uuid4().hex
    df.write.json(f"{path}.new-{tag}")
    (new, fs), (now, _), (old, _) = (_folder(spark, p) for p in (f"{path}.new-{tag}", path, f"{path}.old-{tag}"))
    had = fs.exists(now)
    if had and not fs.rename(now, old):
        raise OSError(f"{path} can't be replaced")
    if not fs.rename(new, now):
        if had:
            fs.rename(old, now)
        raise OSError(f"{path} can't be replaced")
    if had:
        fs.delete(old, True)


def update_settings(spark: SparkSession, path: str, **changes) -> None:
    """Read, change and write the settings; those not named keep their values, unknown ones too."""
    place, fs = _folder(spark, path)
    stored = [json.loads(r["value"]) for r in spark.read.text(path).limit(2).collect()] if fs.exists(place) else []
    if len(stored) > 1:
        raise ValueError(f"{path} has more than one row of settings")
    merged = json.dumps((stored[0] if stored else {}) | changes)
    save(spark.createDataFrame([(merged,)], "j string").select(F.from_json("j", F.schema_of_json(F.lit(merged))).alias("s")).select("s.*"), path)


def settings(spark: SparkSession, path: str) -> DataFrame:
    """One row; what isn't set has its default."""
    found = spark.read.schema(SETTINGS).json(path)
    return found.agg(F.coalesce(F.max("show_result_alert"), F.lit(True)).alias("show_result_alert"))


def messages(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, MESSAGES)


def filled(template: Column, args: list[Column]) -> Column:
    """Positional placeholders $1, $2, ... replaced."""
    for k, a in enumerate(args, 1):
        template = F.replace(template, F.lit(f"${k}"), a.cast("string"))
    return template


def preset(presets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted (job_id, preset_id) with its preset, else the default one, with overriding addresses."""
    base = F.broadcast(presets.where("id = 'default'").select(*[F.col(c).alias("d_" + c) for c in presets.columns]))  # one row
    found = wanted.join(F.broadcast(presets), wanted["preset_id"] == presets["id"], "left").crossJoin(base)
    own = [c for c in ("detector_url", "recogniser_url") if f"own_{c}" in wanted.columns]
    return found.select("job_id", *[F.coalesce(*([F.col(f"own_{c}")] if c in own else []), F.col(c), F.col("d_" + c)).alias(c) for c in presets.columns])


def notified(results: DataFrame, config: DataFrame) -> DataFrame:
    """Results with the notice to show: the number of characters, or null where notices are off."""
    n = F.length("text")
    return results.crossJoin(F.broadcast(config)).select(*results.columns, F.when(F.col("show_result_alert"), F.when(n > 0, F.format_string("%d characters copied", n)).otherwise(F.lit("no text found"))).alias("notice"))
