"""Phrase collocations by top-order marginalisation.

Texts are cut into pieces at punctuation and line ends, pieces into words. Each word opens one window: itself and
lead columns with the next four words of its piece, null past the end. Only these longest windows are counted;
a Spark ROLLUP over their columns sums them to the counts of all shorter prefixes, so phrases of every length come from one
count. A phrase is scored at its weakest cut: how much more often it stands than its two parts would make it.

Windows end early where that changes no wanted count: a phrase that reaches the least count has no rarer phrase
inside. Words and pairs, then longer phrases of frequent pairs, are therefore counted by hash bucket first; a bucket's count is
never below that of its phrases, so a window ends where its prefix falls into a rare bucket. The frequent buckets are a bitmap of
fixed size (16 MiB); with more text more buckets are frequent and windows end less often, which changes the work alone.
Buckets travel as arrays of 3 bytes for each distinct one of a batch, and are added up in arrays of fixed size.

All counts are summed before they are shuffled, so no frequent pair, word or language gathers in one task; ranks are
taken in salted parts first.

Defined cases: a null text has no words; a null language is ``und``; phrases never span pieces or documents;
equal rows count each; overlapping occurrences all count; an empty table gives an empty result; further columns are
ignored; texts of any length count whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowio import arrow_map, pieces, split_at_blanks
from .util import LOWER, UPPER, durable, read

ORDER = 5
#: Buckets of the bitmap: 2 ** BITS.
BITS = 27
#: Languages up to which their totals are broadcast; more of them are joined by a shuffle.
LANGUAGES = 10_000
#: Bytes of text a task counts at once.
PIECE = 8 << 20
_WORDS = [f"w{k}" for k in range(1, ORDER + 1)]
_PLAIN = bytes.maketrans((UPPER + ".,;:!?\x0b\x0c\r\t").encode(), (LOWER + "\n" * 9 + " ").encode())


def stream(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """(codes of all words in order, -1 between pieces; the words) of some texts."""
    raw = b"\n".join(texts).translate(_PLAIN).replace(b"\n", b" \n ") + b" "
    tokens, _ = split_at_blanks(raw)
    words = [w[:-1] for w in tokens.dictionary.to_pylist()]
    codes = tokens.indices.to_numpy().astype(np.int64)
    if b"\n" in words:
        codes[codes == words.index(b"\n")] = -1
    return (codes[codes != words.index(b"")] if b"" in words else codes), words


def prefixes(codes: np.ndarray, words: list[bytes], lang: str, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 1, 2, ... ORDER words: (bucket of the phrase that begins at each position, whether it lies in one piece)."""
    seed = zlib.crc32(lang.encode())
    at = np.array([zlib.crc32(w, seed) for w in words] or [0], np.uint64)[codes] * np.uint64(0x9E3779B97F4A7C15)
    phrase, inside = at, codes >= 0
    for k in range(1, ORDER + 1):
        if k > 1:
            phrase = phrase[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + at[k - 1 :]
            inside = inside[:-1] & (codes[k - 1 :] >= 0)
        x = (phrase ^ (phrase >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield (x ^ (x >> np.uint64(32))) & np.uint64((1 << bits) - 1), inside


def often(bitmap: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bitmap[bucket >> np.uint64(3)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for batch, texts in pieces(batches, "text", PIECE):
        raw = texts.cast(pa.large_binary())
        langs = batch.column("lang").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, raw.filter(pa.array(langs.indices.to_numpy() == k)).to_pylist()


#: Buckets of one part of the bitmap.
PART = 1 << 16


def frequent_buckets(docs: DataFrame, least: int, bits: int = BITS, pairs: bytes | None = None) -> bytes:
    """The bitmap of the buckets that are reached ``least`` times, 2 ** ``bits`` bits (16 at least).

    Without ``pairs`` those of words and pairs; with the result of that, those of longer phrases whose pairs are all frequent.
    """
    known = docs.sparkSession.sparkContext.broadcast(pairs)
    count_type = np.uint8 if least < 256 else np.int32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if known.value is None else np.frombuffer(known.value, np.uint8)
        for lang, texts in by_language(batches):
            codes, words = stream(texts)
            found, steps = [], None
            for k, (bucket, inside) in enumerate(prefixes(codes, words, lang, bits), 1):
                if bitmap is None and k <= 2:
                    found.append(bucket[inside])
                elif bitmap is not None and k == 2:
                    steps = inside & often(bitmap, bucket)
                elif bitmap is not None and k > 2:
                    # A phrase of k words has k - 1 frequent pairs.
                    going = steps[: len(bucket)] if k == 3 else going[:-1]
                    going = going & steps[k - 2 :]
                    found.append(bucket[going])
                elif bitmap is None:
                    break
            # Counts past the least one say no more.
            all_, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            n = np.minimum(n, least).astype(count_type)
            part, first = np.unique(all_ // np.uint64(PART), return_index=True)
            low = (all_ % np.uint64(PART)).astype(np.uint16)
            ends = [*first[1:].tolist(), len(all_)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary())], names=["part", "low", "n"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(have >= least, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

        # Rows come sorted by part, so the sums of one part are held at a time.
        now, have = None, np.zeros(PART, np.int32)
        for batch in batches:
            for part, low, n in zip(*(batch.column(c).to_pylist() for c in ("part", "low", "n"))):
                if part != now:
                    if now is not None:
                        yield done()
                    now, have = part, np.zeros(PART, np.int32)
                # Low parts are distinct within a row; sums stop at the least count, so they never run over.
                at = np.frombuffer(low, np.uint16)
                have[at] = np.minimum(have[at] + np.frombuffer(n, count_type), least)
        if now is not None:
            yield done()

    counted = arrow_map(docs, count, "part int, low binary, n binary").repartition("part").sortWithinPartitions("part")
    whole = bytearray(max(1 << bits, PART) // 8)
    # 2 ** bits bits in all.
    for r in arrow_map(counted, add, "part int, bits binary").collect():
        whole[r["part"] * PART // 8 : (r["part"] + 1) * PART // 8] = r["bits"]
    return bytes(whole)


def windows(docs: DataFrame, least: int, bits: int = BITS) -> DataFrame:
    """(lang, w1 to w5, n): windows and how often they stand; without any word, the number of all words."""
    pairs = frequent_buckets(docs, least, bits)
    longer = frequent_buckets(docs, least, bits, pairs)
    both = (np.frombuffer(pairs, np.uint8) | np.frombuffer(longer, np.uint8)).tobytes()
    frequent = docs.sparkSession.sparkContext.broadcast(both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(frequent.value, np.uint8)
        for lang, texts in by_language(batches):
            codes, words = stream(texts)
            size = np.zeros(len(codes), np.int64)  # words of the window that begins here
            for k, (bucket, inside) in enumerate(prefixes(codes, words, lang, bits), 1):
                size[: len(bucket)][inside & (size[: len(bucket)] == k - 1) & often(bitmap, bucket)] = k
            # Words alone are counted here, windows of more words by Spark's partial aggregation.
            alone = np.bincount(codes[size == 1], minlength=len(words))
            single, at = np.flatnonzero(alone), np.flatnonzero(size > 1)
            padded = np.append(codes, [-1] * ORDER)
            lead = [np.concatenate([single if k == 0 else np.full(len(single), -1), np.where(size[at] > k, padded[at + k], -1)]) for k in range(ORDER)]
            values = pa.array(words, pa.binary()).cast(pa.string())
            columns = [values.take(pa.array(column, mask=column < 0)) for column in lead]
            n = np.concatenate([alone[single], np.ones(len(at), np.int64)])
            rows = pa.table([pa.array([lang] * len(n), pa.string()), *columns, pa.array(n)], names=["lang", *_WORDS, "n"])
            yield from rows.to_batches(max_chunksize=50_000)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), **{w: pa.array([None], pa.string()) for w in _WORDS}, "n": pa.array([int((codes >= 0).sum())], pa.int64())})

    return arrow_map(docs, run, f"lang string, {', '.join(w + ' string' for w in _WORDS)}, n long")


def prefix_counts(opened: DataFrame, least: int) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of 1 to ORDER words that stand ``least`` times, by ROLLUP of the longest windows; f of no words is that of all words."""
    longest = opened.groupBy("lang", *_WORDS).agg(F.sum("n").alias("n"))
    # Bits of grouping_id are set for the columns that are summed over; nulls of padded windows are no phrases.
    rolled = longest.rollup("lang", *_WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("over")).where(F.col("f") >= least)
    size = F.lit(ORDER) - F.bit_count("over")
    columns = F.array(*_WORDS)
    words = F.when((size == ORDER) & F.col("w1").isNull(), F.slice(columns, 1, 0)).when(size >= 1, F.slice(columns, F.lit(1), size))
    whole = rolled.withColumn("words", words).where(F.col("words").isNotNull() & ~F.exists("words", lambda w: w.isNull()))
    return whole.select("lang", "words", F.array_join("words", " ").alias("phrase"), "f")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, bits: int = BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language that no equally frequent longer one holds."""
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    counted = durable(prefix_counts(windows(slim, least, bits), least), "collocation-counts")
    totals = counted.where("size(words) = 0").select("lang", F.col("f").alias("n"))
    if totals.count() <= LANGUAGES:
        totals = F.broadcast(totals)
    counts = counted.where("size(words) > 0")
    phrases = counts.where(F.size("words") > 1).select("lang", "words", "phrase", F.col("f").alias("a"))
    cut = phrases.select("lang", "words", "phrase", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"), F.expr("array_join(slice(words, k + 1, size(words)), ' ')").alias("rest"))
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    joined = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    exact = F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    weakest = joined.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    # A longer phrase is never more frequent, so one that is equally frequent has an equally frequent one of one word more inside.
    inner = F.explode(F.expr("array(array_join(slice(words, 1, size(words) - 1), ' '), array_join(slice(words, 2, size(words)), ' '))"))
    held = phrases.where(F.size("words") > 2).select("lang", inner.alias("phrase"), "a")
    scored = weakest.join(held, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    salted = scored.withColumn("salt", F.pmod(F.crc32("phrase"), F.lit(64)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
