"""Files that arrive in chunks: progress in bytes, verified assembly, and a cache asked before the source.

Chunks are rows (name, pos, n_chunks, n_bytes, body, digest); ``n_chunks`` and ``n_bytes`` are those of the whole file, the
digest is that of the chunk. A chunk may come twice and in any order. A file is put together in one row, so it is bounded by what
a row can hold; its chunks meet in one group of the names' shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KIND = "name string, pos long, n_chunks long, n_bytes long, body binary, digest string"
CACHE = "name string, content binary, digest string"


def chunked(files: DataFrame, size: int) -> DataFrame:
    """Files (name, content) as chunks of ``size`` bytes; an empty file is one empty chunk."""
    n = F.octet_length("content").cast("long")
    count = F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("long")
    body = F.substring(F.col("content"), (F.col("pos") * size + 1).cast("int"), F.lit(size))
    at = files.select("name", "content", count.alias("n_chunks"), n.alias("n_bytes"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("pos"))
    return at.withColumn("body", body).select("name", "pos", "n_chunks", "n_bytes", "body", F.md5("body").alias("digest"))


def progress(chunks: DataFrame, order: str = "pos") -> DataFrame:
    """(name, pos, loaded, total, pct): bytes loaded with each chunk, a running sum over narrow rows."""
    loaded = F.sum(F.octet_length("body").cast("long")).over(Window.partitionBy("name").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = chunks.select("name", "pos", order, loaded.alias("loaded"), F.col("n_bytes").alias("total")) if order != "pos" else chunks.select("name", "pos", loaded.alias("loaded"), F.col("n_bytes").alias("total"))
    return rows.select("name", "pos", "loaded", "total", F.when(F.col("total") > 0, F.floor(F.lit(100.0) * F.col("loaded") / F.col("total") + 0.5)).cast("long").alias("pct"))


def assembled(chunks: DataFrame) -> DataFrame:
    """(name, content, digest, status) for each file: 'ok', or 'missing' or 'corrupt' without content.

    Chunks whose digest doesn't fit are left out, so a good copy of the same chunk mends them.
    """
    marked = chunks.withColumn("good", F.coalesce(F.md5("body") == F.col("digest"), F.lit(False)))
    # One copy of each chunk, a good one if there is any.
    once = marked.groupBy("name", "pos").agg(F.max("n_chunks").alias("n_chunks"), F.max("n_bytes").alias("n_bytes"), F.max("good").alias("good"), F.max_by("body", "good").alias("body"))
    parts = once.groupBy("name").agg(
        F.max("n_chunks").alias("n_chunks"), F.max("n_bytes").alias("n_bytes"), F.count_if(F.col("pos").between(0, F.col("n_chunks") - 1)).alias("n"), F.min("good").alias("good"),
        F.expr("listagg(body) WITHIN GROUP (ORDER BY pos)").alias("content"),
    )
    status = F.when(F.col("n") < F.col("n_chunks"), "missing").when(~F.col("good") | (F.octet_length("content") != F.col("n_bytes")), "corrupt").otherwise("ok")
    content = F.when(F.col("status") == "ok", F.col("content"))
    return parts.withColumn("status", status).select("name", content.alias("content"), F.md5(content).alias("digest"), "status")


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The cache's files; a folder that isn't there yet is an empty cache."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def fetch(wanted: DataFrame, source, path: str) -> DataFrame:
    """(name, content, digest, origin, error) for each wanted name: 'cache', or 'source' after it has been added to the cache at ``path``.

    ``source`` is a function that gives the chunks; it isn't called if all names are cached. Only whole files are added; one that
    is missing or corrupt has an error, and is asked for again by the next fetch. Of a file added by two fetches at once one copy is used.
    """
    spark = wanted.sparkSession
    names = wanted.select("name").distinct()
    have = cached(spark, path)
    absent = names.join(have.select("name"), "name", "left_anti")
    known = have.join(names, "name", "left_semi").dropDuplicates(["name"]).select("name", "content", "digest", F.lit("cache").alias("origin"), F.lit(None).cast("string").alias("error"))
    if absent.isEmpty():
        return known
    got = assembled(source().join(absent, "name", "left_semi"))
    got.where("status = 'ok'").select("name", "content", "digest").write.mode("append").parquet(path)
    fresh = absent.join(cached(spark, path).dropDuplicates(["name"]), "name", "left").join(got.where("status != 'ok'").select("name", "status"), "name", "left")
    error: Column = F.when(F.col("digest").isNull(), F.coalesce("status", F.lit("unknown")))
    # What was cached before is read without the files added just now.
    return known.unionByName(fresh.select("name", "content", "digest", F.when(F.col("digest").isNotNull(), "source").alias("origin"), error.alias("error")))
