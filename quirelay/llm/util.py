"""Helpers shared by the operators: reading, durable intermediates, exact ranks, salting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[str] = []
#: Bytes for a file of a table whose size is known before.
FILE_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); an own one only where it is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quirelay-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def durable(df: DataFrame, name: str = "step", most: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor loses nothing.

    ``most`` says how many bytes the step reads or writes at most, about. A small table then isn't dealt over a file
    for each shuffle partition, but over two for each core, or as many as these bytes need: each file makes its executor
    start processes (on local disks Hadoop sets permissions by ``chmod``), and these stand for its whole memory until they run.
    """
    if most is not None:
        df = df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-most // FILE_BYTES)))
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_durable(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by :func:`durable` which no later plan reads."""
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(spark, parent)


@contextmanager
def only_result(spark: SparkSession) -> Iterator[None]:
    """Delete what :func:`durable` wrote inside, but for the last table: the result that later steps read."""
    first = len(_made)
    yield
    for path in _made[first:-1]:
        _delete(spark, path)
    del _made[first:-1]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` agrees on texts of ASCII only and is far cheaper there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """True for rows whose crc32 of the id as text is divisible by 5; a null id counts as the text ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5) == 0


def exact_rank(df: DataFrame, keys: list[str], bin_col: str, order: list, out: str, total: str, per_group: int = 128) -> DataFrame:
    """Add the exact 0-based rank within ``keys`` and the number of rows there, without one task per key.

    ``bin_col`` is a non-negative int that rises with the order; rows are counted by (keys, bin), the
    counts are summed up in two levels, and only the rows of one bin are sorted together.
    ``df`` is read twice, so it should be a durable table.
    """
    hi = F.floor(F.col(bin_col) / F.lit(per_group)).cast("int")
    counts = df.groupBy(*keys, bin_col).agg(F.count(F.lit(1)).alias("__c")).withColumn("__hi", hi)
    low = Window.partitionBy(*keys, "__hi").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    high = Window.partitionBy(*keys).orderBy("__hi").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        counts.groupBy(*keys, "__hi")
        .agg(F.sum("__c").alias("__g"))
        .withColumn("__before", F.coalesce(F.sum("__g").over(high), F.lit(0)))
        .withColumn(total, F.sum("__g").over(Window.partitionBy(*keys)))
    )
    offsets = (
        counts.withColumn("__within", F.coalesce(F.sum("__c").over(low), F.lit(0)))
        .join(groups, [*keys, "__hi"])
        .select(*keys, bin_col, (F.col("__before") + F.col("__within")).alias("__offset"), total)
    )
    row = F.row_number().over(Window.partitionBy(*keys, bin_col).orderBy(*order)) - 1
    return df.withColumn("__row", row).join(offsets, [*keys, bin_col]).withColumn(out, F.col("__offset") + F.col("__row")).drop("__row", "__offset")
