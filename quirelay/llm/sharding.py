"""Proportional stratified interleaving: every shard holds the mixture of the sources.

Rows of each source are put in a seeded random order and ranked; the fractional rank
``(rank + 1/2) / rows of the source`` spreads each source evenly over [0, 1), the rows are sorted by
it, and the sorted sequence is cut into equal shards. Only DataFrame functions are used.

The law is ``rows``: shard sizes differ by one row at most. Ranks are exact and never need all rows of
a source in one task (see :func:`quirelay.llm.util.exact_rank`).

Defined cases: a null source is a source of its own; a null id takes part with the text's checksum
alone; a null text has size 1; equal rows are interchangeable and each gets its own slot; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import durable, exact_rank, read

#: Bins of a rank: 15 bits.
BINS = 32768


def shard_plan(docs: DataFrame, n_shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One narrow row for each row of ``docs``: id, size, text_crc32, stratum, shard, slot."""
    text = F.col(text_col)
    narrow = durable(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
        ).withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("~"), F.col("text_crc32").cast("string"))))))
        .withColumn("bin", F.shiftright(F.conv(F.substring("key", 1, 4), 16, 10).cast("int"), 1)),
        "shard-rows",
    )
    ranked = exact_rank(narrow, ["stratum"], "bin", ["key", F.col("id").asc_nulls_first(), "size", "text_crc32"], "rank", "n")
    spread = durable(
        ranked.withColumn("place", (F.col("rank").cast("double") + 0.5) / F.col("n").cast("double")).select(
            "id", "size", "text_crc32", "stratum", "rank", "place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("stratum"))).alias("stratum_key"), F.floor(F.col("place") * BINS).cast("int").alias("bin")
        ),
        "shard-places",
    )
    placed = exact_rank(spread, [], "bin", ["place", "stratum_key", "stratum", "rank"], "at", "rows")
    # Shard s takes the ranks from floor(s * rows / shards) on; integers throughout, far below 2**63.
    shard = F.expr(f"cast((at * {n_shards}L + {n_shards - 1}L) div rows as int)")
    return placed.withColumn("shard", shard).select("id", "size", "text_crc32", "stratum", "shard", F.expr(f"at - ((shard * rows) div {n_shards}L)").cast("long").alias("slot"))


def write_shards(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` (with unique ids) as one folder for each shard, rows in slot order within a file."""
    keyed = docs.join(plan.select(F.col("id").alias(id_col), "shard", "slot"), id_col)
    keyed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    plan = shard_plan(read(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
