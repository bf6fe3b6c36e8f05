"""Sinks of results: texts, notices and structured pages, each batch of a stream written once.

A batch is a folder named by its number. A replayed batch (after a crash between writing and the stream's commit)
replaces its own folder and nothing else, so readers see every result once. Readers take whole batches alone: a
batch counts once its ``_SUCCESS`` file is there, which Spark writes last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The texts' sink: ids and order stay with the text.
TEXT = ["job_id", "page_id", "line_pos", "text"]


def write_batch(rows: DataFrame, path: str, batch: int, kind: str = "json") -> None:
    """Write ``rows`` as batch number ``batch``; the same number again replaces it."""
    rows.write.mode("overwrite").format(kind).save(f"{path}/batch={batch}")


def batches(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """All whole batches with their number."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    glob = hadoop.Path(f"{path}/batch=*/_SUCCESS")
    done = [str(f.getPath().getParent()) for f in glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []]
    fields = f"{schema}, batch long"
    return spark.read.schema(fields).option("basePath", path).format(kind).load(done) if done else spark.createDataFrame([], fields)


def texts(results: DataFrame) -> DataFrame:
    """K1: one text for each job, its pages' lines in order, with the number of lines; lines without a text count as ''."""
    line = F.struct("page_id", "line_pos", F.coalesce("text", F.lit("")).alias("text"))
    listed = results.groupBy("job_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return listed.select("job_id", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"), F.size("lines").alias("n_lines"))


def structured(pages: DataFrame, lines: DataFrame, detections: DataFrame) -> DataFrame:
    """K8: a row for each page with its lines in order and its detections; a page without any has empty lists. Rows meet by page alone."""
    # The first field decides the order, and is unique in a page.
    line = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_pos", "x", "y", "w", "h", "conf", "text"))).alias("lines"))
    found = detections.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("det_idx", "class_idx", "conf", "x1", "y1", "x2", "y2"))).alias("detections"))
    kinds = {n: d.schema[n].dataType for n, d in (("lines", line), ("detections", found))}
    joined = pages.join(line, "page_id", "left").join(found, "page_id", "left")
    return joined.select(*pages.columns, *[F.coalesce(F.col(n), F.array().cast(t)).alias(n) for n, t in kinds.items()])


def stream_to(stream: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows, kind: str = "json", trigger: dict | None = None):
    """Start a query that shapes each batch and writes it under its number; ``trigger`` as for ``DataStreamWriter.trigger``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, number: write_batch(shape(rows), path, number, kind))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
