"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelay.llm import bpe, decontam, langid, linededup, setsketch
from quirelay.llm.util import durable, only_result, read


def as_dealt(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` in no more partitions than ``docs``: it has no more bytes, and each file makes its executor start processes."""
    return out.coalesce(docs.rdd.getNumPartitions())


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the calibrated model rejects go; it learns from the rows that aren't held out."""
    return langid.keep_recognised(docs, langid.fit_model(langid.learning_rows(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that earlier documents have go; a document of which nothing else remains goes as well."""
    out = linededup.without_shared_blocks(docs).where((F.col("removed_lines") == 0) | (F.col("text") != ""))
    return as_dealt(out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity of 0.8 or more)."""
    return as_dealt(setsketch.keep_one(docs), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words in benchmark windows go."""
    return as_dealt(decontam.clean_documents(docs, read(spark, sf_dir, "benchmark")), docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every remaining text, with digests of the ids and of the text they decode to."""
    coded = bpe.encode_decode(docs, bpe.default_path())
    return coded.select(
        F.col("id").alias("doc_id"), (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe_encoding", bpe_encoding)]

#: Line runs, registers and the trained model have no SQL form; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with only_result(spark):
        for name, stage in STAGES[:-1]:
            with only_result(spark):
                docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
