"""Ranked lexical search by pipelined term partitioning.

Every term has an owner (a hash of it). Documents are indexed in slices of some thousand rows; a block holds
the postings of one slice for the terms of one owner, with the lengths and ids of the slice's documents. Items
are dealt to bundles of about ``BUNDLE``; for each slice a bundle carries sparse accumulators (item, document, score) from owner to
owner. In each stage Spark cogroups the bundles with the blocks of the owner they have reached; contributions of
that owner's terms are added as 64-bit integers and the bundle goes on. Bundles start at different owners, so
all owners work in all stages; after the last one each slice gives its best documents for each item, and the best of all slices are
selected. No group is larger than a slice of documents and a bundle of items, however frequent a term or large the corpus.

Accumulators that can't reach the best of their slice any more, by upper bounds of the terms still to come,
are left out. That is exact: as many documents of the slice already have more, and a document left out that enters again
has less than its true score, which is too low as well.

Only terms of items are indexed: documents' words are looked up in a bitmap of the items' terms of fixed size (1 MiB); words kept by
mistake meet no item.

Defined cases: null or empty texts have no terms and are neither counted in N nor found; items without
terms have no rows; items with equal or null ids are items each by itself, as are documents; equal
scores go by ascending id, a null id first; an empty table gives an empty result; further columns are ignored; texts of
any length are indexed whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .arrowio import arrow_map, pieces, split_at_blanks
from .util import durable, read

#: Owners of terms, and so stages.
OWNERS = 4
#: Documents of a slice at most; a slice has about 4 MB of text besides.
SLICE = 4096
BUNDLE = 64
#: Bits of the bitmap of query terms: 2 ** BITS.
BITS = 23
#: Weights of the ranking formula (fixed values of its definition): scale, saturation and length normalisation in hundredths.
SCALE, TERM_FREQUENCY, SATURATION, LENGTH = 1_000_000_000, 1000, 12, 25
_ALNUM = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct terms, term of each word in order, text of each word)."""
    tokens, ends = split_at_blanks((b" ".join(texts) + b" ").translate(_ALNUM))
    words = [w[:-1] for w in tokens.dictionary.to_pylist()]
    codes = tokens.indices.to_numpy()
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), ends)
    if b"" in words:
        real = codes != words.index(b"")
        return words, codes[real], owner[real]
    return words, codes, owner


def item_terms(items: DataFrame) -> DataFrame:
    """(key, term, times) of a table (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            words, codes, row = _tokens(texts.cast(pa.large_binary()).to_pylist())
            pair, times = np.unique(row * len(words) + codes, return_counts=True)
            terms = pa.array(words, pa.binary()).cast(pa.string()).take(pa.array(pair % max(1, len(words))))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(pair // max(1, len(words)))), terms, pa.array(times.astype(np.int64))], names=["key", "term", "times"])

    return arrow_map(items, run, "key long, term string, times long")


def term_bitmap(terms: DataFrame, bits: int = BITS) -> bytes:
    """2 ** ``bits`` bits (15 at least), set at the checksums of ``terms``; parts are built on the executors."""
    at = F.crc32("term").bitwiseAND((1 << bits) - 1)
    parts = terms.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(32767)).alias("bits"))
    whole = bytearray((1 << bits) // 8)
    # 1 MiB in all.
    for r in parts.collect():
        whole[r["part"] * 4096 : r["part"] * 4096 + len(r["bits"])] = r["bits"]
    return bytes(whole)


def _posting_blocks(bits, owners: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, number = bits.value, TaskContext.get().partitionId() << 32
        for piece, texts in pieces(batches, "text"):
            for first in range(0, len(piece), rows):
                ids = piece.column("id").slice(first, rows)
                words, codes, row = _tokens(texts.slice(first, rows).cast(pa.large_binary()).to_pylist())
                size = np.bincount(row, minlength=len(ids)).astype(np.int64)
                sums = [zlib.crc32(w) for w in words]
                wanted = np.array([bitmap[(c % (8 * len(bitmap))) >> 3] >> (c & 7) & 1 for c in sums], bool)
                owner = np.array(sums, np.int64) % owners
                mine = wanted[codes]
                pair, tf = np.unique(codes[mine].astype(np.int64) * len(ids) + row[mine], return_counts=True)
                code, doc = pair // len(ids), pair % len(ids)
                for k in range(owners):
                    own = owner[code] == k
                    term, start, df = np.unique(code[own], return_index=True, return_counts=True)
                    most = np.maximum.reduceat(tf[own], start) if len(term) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "slice": pa.array([number], pa.int64()),
                        "owner": pa.array([k], pa.int32()),
                        "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        "sizes": pa.array([size.tobytes()], pa.binary()),
                        "terms": pa.array([[words[t].decode("utf-8", "replace") for t in term]], pa.list_(pa.string())),
                        "df": pa.array([df.tolist()], pa.list_(pa.int64())),
                        "most": pa.array([most.tolist()], pa.list_(pa.int64())),
                        "docs": pa.array([doc[own].astype(np.uint16).tobytes()], pa.binary()),
                        "tf": pa.array([tf[own].astype(np.int32).tobytes()], pa.binary()),
                        "n_docs": pa.array([int((size > 0).sum())], pa.int64()),
                        "n_terms": pa.array([int(size.sum())], pa.int64()),
                    })
                number += 1

    return run


def share(tf, m):
    """The integer part of a contribution that the weight multiplies."""
    return (SCALE * tf) // (TERM_FREQUENCY * tf + SATURATION * m)


_BUNDLE = "slice long, bundle long, keys array<long>, terms array<string>, weights array<long>, tops array<long>, at binary, score binary"


def _bundle_row(row: dict, at: np.ndarray, score: np.ndarray) -> dict:
    return row | {"at": at.astype(np.int32).tobytes(), "score": score.astype(np.int64).tobytes()}


def _stage(stage: int, owners: int, top: int, n_docs: int, n_terms: int, bundle_schema: pa.Schema, out_schema: pa.Schema):
    """Adds one owner's contributions to bundles; the last stage selects the slice's best documents."""
    last = stage == owners - 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows or not right.num_rows:
            return (out_schema if last else bundle_schema).empty_table()
        block = {c: right.column(c)[0].as_py() for c in ("owner", "sizes", "terms", "df", "docs", "tf")}
        m = 100 - LENGTH + (LENGTH * np.frombuffer(block["sizes"], np.int64) * n_docs) // n_terms
        docs, tf = np.frombuffer(block["docs"], np.uint16).astype(np.int64), np.frombuffer(block["tf"], np.int32).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(block["df"])]).astype(np.int64)
        place = {t: (ends[k], ends[k + 1]) for k, t in enumerate(block["terms"])}
        part = share(tf, m[docs])
        ids = right.column("ids").combine_chunks().flatten()
        order = np.empty(len(ids), np.int64)
        order[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        out, found = [], []
        for row in rows:
            keys, item = np.unique(row["keys"], return_inverse=True)
            weights, tops = np.array(row["weights"], np.int64), np.array(row["tops"], np.int64)
            owner = np.array([zlib.crc32(t.encode()) % owners for t in row["terms"]])
            acc = np.zeros((len(keys), len(m)), np.int64)
            acc.reshape(-1)[np.frombuffer(row["at"], np.int32)] = np.frombuffer(row["score"], np.int64)
            for k in np.flatnonzero(owner == block["owner"]):
                if span := place.get(row["terms"][k]):
                    acc[item[k], docs[span[0] : span[1]]] += weights[k] * part[span[0] : span[1]]
            visited = (owner - row["bundle"]) % owners <= stage
            rest = np.bincount(item[~visited], weights=tops[~visited], minlength=len(keys)) if not visited.all() else np.zeros(len(keys))
            if acc.shape[1] > top:
                least = np.partition(acc, acc.shape[1] - top, axis=1)[:, acc.shape[1] - top]
                # Bounds are rounded up by more than a double can lose.
                acc[acc + np.ceil(rest * (1 + 1e-9)).astype(np.int64)[:, None] < least[:, None]] = 0
            if not last:
                at = np.flatnonzero(acc)
                out.append(_bundle_row(row, at, acc.reshape(-1)[at]))
                continue
            for i, key in enumerate(keys.tolist()):
                have = np.flatnonzero(acc[i])
                best = have[np.lexsort((order[have], -acc[i, have]))[:top]]
                found.append(pa.table([pa.array([key] * len(best), pa.int64()), ids.take(pa.array(best)), pa.array(acc[i, best])], schema=out_schema))
        if last:
            return pa.concat_tables(found) if found else out_schema.empty_table()
        return pa.Table.from_pylist(out, schema=bundle_schema)

    return run


def search(docs: DataFrame, items: DataFrame, top: int = 20, owners: int = OWNERS, slice_rows: int = SLICE, bundle: int = BUNDLE, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item, rank, id, score: for each row of ``items`` its ``top`` documents with a score above 0, equal scores by ascending id."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    ship(spark)
    keyed = durable(items.select(F.monotonically_increasing_id().alias("key"), F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), "search-items")
    queries = durable(item_terms(keyed.select("key", "text")), "search-terms")
    bitmap = spark.sparkContext.broadcast(term_bitmap(queries, bits))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType
    block_schema = f"slice long, owner int, ids array<{id_type.simpleString()}>, sizes binary, terms array<string>, df array<long>, most array<long>, docs binary, tf binary, n_docs long, n_terms long"
    blocks = durable(arrow_map(slim, _posting_blocks(bitmap, owners, slice_rows), block_schema), "search-blocks")
    each = blocks.where("owner = 0")
    total = each.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    out = spark.createDataFrame([], "key long").select("key", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("long").alias("score"))
    if total["terms"]:
        posted = blocks.select(F.explode(F.arrays_zip("terms", "df", "most")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.df").alias("df"), F.max("p.most").alias("most"))
        # Doubles, as the weight is defined.
        weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * total["docs"] + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("long")
        weighted = queries.join(posted, "term").withColumn("weight", weight * F.col("times"))
        ceiling = F.expr(f"({SCALE}L * most) div ({TERM_FREQUENCY}L * most + {SATURATION * (100 - LENGTH)}L)")
        n_bundles = max(1, math.ceil(keyed.count() / bundle))
        term = F.struct("key", "term", "weight", (F.col("weight") * ceiling).alias("top"))
        bundles = weighted.groupBy(F.pmod(F.xxhash64("key"), F.lit(n_bundles)).cast("long").alias("bundle")).agg(F.sort_array(F.collect_list(term)).alias("q"))
        none = F.lit(b"").cast("binary")
        dealt = each.select(F.col("slice").alias("slice"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bundles - 1).cast("long"))).alias("bundle")).join(bundles, "bundle")
        carried = dealt.select("slice", "bundle", F.col("q.key").alias("keys"), F.col("q.term").alias("terms"), F.col("q.weight").alias("weights"), F.col("q.top").alias("tops"), none.alias("at"), none.alias("score"))
        found = f"key long, id {id_type.simpleString()}, score long"
        schema = to_arrow_schema(carried.schema)
        wanted = blocks.select("slice", "owner", "ids", "sizes", "terms", "df", "docs", "tf").groupBy("slice", "owner")
        for stage in range(owners):
            run = _stage(stage, owners, top, total["docs"], total["terms"], schema, to_arrow_schema(out.schema))
            here = carried.withColumn("owner", F.pmod(F.col("bundle") + stage, F.lit(owners)).cast("int")).groupBy("slice", "owner")
            carried = here.cogroup(wanted).applyInArrow(run, found if stage == owners - 1 else _BUNDLE)
        out = carried
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_first("id")))
    best = out.withColumn("rank", first).where(F.col("rank") <= top)
    return best.join(keyed.select("key", "item"), "key").select("item", "rank", "id", "score")


def op11_search(spark, sf_dir: str) -> DataFrame:
    found = search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
