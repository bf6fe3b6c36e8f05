"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over every training text.

Words are runs outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F`` of the text with A-Z lower-cased. A window is
13 consecutive words of an item; an item with 1 to 12 words is one window. Scanning has three steps, all
of them DataFrame functions:

1. the hash set of the windows is a bitmap that travels with the plan: each window sets a bit for the xxhash64 of its
   leading words (at most three) and one for that of all its words. It has ``BITS_PER_WINDOW`` bits or more for each
   window, counted first, and ``MOST_BITS`` (16 MiB) at most. While a text is scanned, only positions with both bits set are kept;
2. the kept windows are joined with the test windows on their full text, so no hash decides a hit. Past
   ``MOST_BITS`` more positions are kept by mistake, and the join still decides; the plan is the same at any size;
3. hits are brought together for each row, and their intervals are merged in order.

No text is shuffled: the join and the aggregation see the id, a checksum and the few windows kept.

Defined cases: null texts and texts without words have no words, no hits, and are not contaminated; null
or empty items have no windows; equal rows are counted and each is returned; items with equal ids count
once; an item of 13 or more words and a text shorter than it share windows all the same; further columns
are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import ascii_lower, durable, read

WIDTH = 13
LEAD = 3
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BITS_PER_WINDOW, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 27


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct (window text, its length in words, hashes of its leading and of all words, sorted ids of the items that hold it)."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    at = words.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), width).alias("v")).withColumn("len", F.size("v"))
    return (
        at.select("item", "len", F.array_join("v", " ").alias("window"), F.xxhash64(F.slice("v", 1, LEAD)).alias("lead"), F.xxhash64("v", "len").alias("whole"))
        .groupBy("window", "len", "lead", "whole")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def bits_for(windows: int) -> int:
    """A power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (windows * BITS_PER_WINDOW - 1).bit_length())) if windows else LEAST_BITS


def bitmap(windows: DataFrame, bits: int) -> DataFrame:
    """One row: the bits as array<long>, set at the hashes of leading and of all words of ``windows``."""
    keys = windows.select(F.explode(F.array("lead", "whole")).alias("h")).select(F.expr(f"h & {bits - 1}L").alias("at"))
    words = keys.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    every = windows.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("word"), "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    return every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("bits"))


def _in(bits: Column, size: int, h: Column) -> Column:
    at = h.bitwiseAND(F.lit(size - 1).cast("long"))
    return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1


def _kept(lengths: list[int], bits: Column, size: int) -> Column:
    """Whether a window of one of ``lengths`` words at word ``i`` (from 1) has its leading words, and then all its words, in the bitmap."""
    tests = []
    for lead in sorted({min(LEAD, n) for n in lengths}):
        whole = [_is_window(n, bits, size) for n in lengths if min(LEAD, n) == lead]
        tests.append((F.col("i") + (lead - 1) <= F.col("n_words")) & _in(bits, size, F.xxhash64(F.slice("w", F.greatest("i", F.lit(1)), lead))) & reduce(or_, whole))
    return reduce(or_, tests, F.lit(False))


def _is_window(n: int, bits: Column, size: int) -> Column:
    return (F.col("i") + (n - 1) <= F.col("n_words")) & _in(bits, size, F.xxhash64(F.slice("w", F.greatest("i", F.lit(1)), n), F.lit(n)))


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, carry: list[str] | None = None) -> DataFrame:
    """A row for each row of ``docs``: id, n_words, hits (sorted struct<start, len> in words), items (sorted ids).

    ``carry`` names further columns of ``docs`` to be returned; they are shuffled with the row.
    """
    carry = list(carry or [])
    windows = durable(item_windows(items, item_id, item_text, width), "windows")
    kinds = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `width` rows
    size = bits_for(sum(kinds.values()))
    bits = bitmap(windows, size).scalar()
    text = F.col(text_col)
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("struct<x:int>")
    base = docs.select(F.col(id_col).alias("id"), carried.alias("carried"), words_of(text).alias("w"), F.xxhash64(text).alias("h64"), F.crc32(F.coalesce(text, F.lit(""))).alias("h32"), F.octet_length(text).alias("bytes"))
    base = base.withColumn("n_words", F.size("w"))

    # Word 0 stands for the row itself: a row without any window yields that one alone. Tests run on generated rows, in compiled code.
    at = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_words")))).where((F.col("i") == 0) | ((F.col("i") > 0) & _kept(sorted(kinds), bits, size)))
    windows_here = F.array_compact(
        F.array(
            *[F.when((F.col("i") > 0) & _is_window(n, bits, size), F.struct((F.col("i") - 1).alias("start"), F.lit(n).alias("len"), F.array_join(F.slice("w", F.greatest("i", F.lit(1)), n), " ").alias("window"))) for n in sorted(kinds)],
            F.lit(None).cast("struct<start:int,len:int,window:string>"),
        )
    )
    at = at.select("id", "carried", "n_words", "h64", "h32", "bytes", (F.col("i") == 0).alias("first"), F.explode_outer(windows_here).alias("k"))
    at = at.select("id", "carried", "n_words", "h64", "h32", "bytes", "first", F.col("k.start").alias("start"), F.col("k.len").alias("len"), F.col("k.window").alias("window"))
    table = windows.select("window", "items")
    hits = at.join(table, "window", "left")
    hit = F.when(F.col("items").isNotNull(), F.struct("start", "len"))
    rows = hits.groupBy("id", "n_words", "h64", "h32", "bytes", "carried").agg(
        F.sum(F.col("first").cast("long")).alias("copies"), F.sort_array(F.collect_set(hit)).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    rows = rows.withColumn("__copy", F.explode(F.expr("array_repeat(0, cast(copies as int))")))
    return rows.select("id", "n_words", "hits", "items", *[F.col("carried")[c].alias(c) for c in carry])


def covered(hits: Column) -> Column:
    """Words inside the union of sorted ``hits``."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, h: Column) -> Column:
        end = h["start"] + h["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(h["start"], acc["end"]), F.lit(0))).alias("n"))

    return F.aggregate(hits, zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """A row for each row of ``docs``: id, n_words, n_hit, hits, items, contaminated (a twentieth of the words, and one at least, is hit)."""
    found = scan(docs, items, **options).withColumn("n_hit", covered(F.col("hits")))
    return found.withColumn("n_words", F.col("n_words").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept; rows are told apart by id and text."""
    text_col = options.get("text_col", "text")
    keyed = docs.withColumn("__h", F.xxhash64(text_col))
    bad = decontaminate(keyed, items, id_col=id_col, carry=["__h"], **options).where("contaminated").select(F.col("id").alias("__bad"), F.col("__h").alias("__bad_h")).distinct()
    return keyed.join(bad, keyed[id_col].eqNullSafe(bad["__bad"]) & (keyed["__h"] == bad["__bad_h"]), "left_anti").select(*docs.columns)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
