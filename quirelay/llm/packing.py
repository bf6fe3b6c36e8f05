"""Best-fit packing of documents into sequences of a fixed number of tokens, by hierarchical residual packing.

Documents are encoded, closed with an end id, and cut only if they are longer than a sequence. Each partition
packs its own pieces: best fit, longest first. Bins in which fewer than ``NEARLY`` tokens are free are done. The
others are items of the next round: they are dealt to groups of about ``GROUP`` bins, best fit runs in each
group, and so on up a tree whose width shrinks by what was filled, until one group held all bins or a round
no longer joins a hundredth of them (bins of more than half a sequence can't be joined). The length of the tree's
tables is that of the underfull bins; no task sees more than one partition or one group.

Words are looked up in a table of bounded size in each worker and otherwise encoded by the public library, a batch
of new words at once; plain words are joined by blanks and parted again where tokens end a word. A-Z are lower-cased before, but for texts with
combining marks or openings of added tokens. That is exact for tokenizers that lower-case, drop white space and split at it, as the
default file does.

Defined cases: a null or empty text is the end id alone; a piece of exactly the limit fills a sequence; equal rows
and rows with null ids are packed each by itself; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .arrowio import arrow_map, pieces, split_at_blanks
from .bpe import SPACE, default_path
from .util import LOWER, UPPER, durable, read

LIMIT, END = 4096, 1
#: A bin with fewer free tokens is done.
NEARLY = 64
#: Bins of one group of the tree.
GROUP = 50_000
#: Words whose ids a worker keeps, those it meets first; the frequent ones are among them.
WORDS = 400_000
#: Bytes of text encoded at once: a word of them is looked up once.
PIECE = 8 << 20
#: Plain words that are encoded as one text.
JOINED = 500

_ASCII_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_LOWER = bytes.maketrans(b"\t\n\x0b\x0c\r" + UPPER.encode(), b"     " + LOWER.encode())
#: First bytes of the combining marks that compose with A-Z or a-z.
_MARKS = (b"\xcc", b"\xcd")
WORD_END = "</w>"
#: Signs that often follow a word; a pre-tokenizer parts them from letters.
SIGNS = ".,;:!?"
_WIDE_SPACE = [c.encode() for c in SPACE if ord(c) > 127]


class WordIds:
    """Ids of texts through a table of words; new words go to the library together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.opening = [t.content[:2].encode() for t in self.library.get_added_tokens_decoder().values()]
        self.signs = dict(zip(SIGNS, self._each(list(SIGNS))))
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith(WORD_END)]] = True

    def _each(self, words: list[str]) -> list[bytes]:
        return [array("I", c.ids).tobytes() for c in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, each of which ends with one token that ends a word."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out = []
        for group, coded in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, np.uint32)
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            raw = ids.astype("<u4").tobytes()
            if len(cuts) == len(group) and cuts[-1] == len(raw):
                out += [raw[a:b] for a, b in zip([0, *cuts.tolist()], cuts.tolist())]
            else:
                out += self._each(group)
        return out

    def _ids(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        ids = list(map(known.get, words))
        plain, other = [], []
        for k, x in enumerate(ids):
            if x is None:
                # The last byte of a word is the blank after it.
                w = words[k][:-1].decode("utf-8", "replace")
                # A sign after letters is a token of its own.
                sign = self.signs.get(w[-1:], b"")
                stem = w[:-1] if sign else w
                if not (stem.isalpha() and (stem.isascii() or max(stem) < "\u0250")):
                    other.append((k, w))
                elif sign and (x := known.get(words[k][:-2] + b" ")) is not None:
                    ids[k] = x + sign
                else:
                    plain.append((k, stem))
        for some, encode in ((plain, self._plain), (other, self._each)):
            for (k, w), x in zip(some, encode([w for _, w in some]), strict=True):
                ids[k] = x + self.signs.get(words[k][-2:-1].decode("latin-1"), b"") if some is plain else x
                if len(known) < WORDS and len(w) <= 64:
                    known[words[k]] = ids[k]
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        kept = (*_MARKS, *self.opening)
        raw = b" ".join([t.translate(_ASCII_SPACE if any(m in t for m in kept) else _LOWER) for t in texts]) + b" "
        for c in _WIDE_SPACE:
            if c in raw:
                raw = raw.replace(c, b" " * len(c))
        tokens, ends = split_at_blanks(raw)
        ids = self._ids(tokens.dictionary.to_pylist())
        codes = tokens.indices.to_numpy()
        values = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        upto = np.concatenate([[0], np.cumsum(size[codes])])
        flat = memoryview(values[np.repeat(first[codes] - upto[:-1], size[codes]) + np.arange(upto[-1])].tobytes())
        # Every text ends at a blank, so at the end of a token.
        cuts = (4 * upto[np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts])) + 1]).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One table for all tasks of a worker."""
    return WordIds(path)


def best_fit(lengths: list[int], limit: int = LIMIT) -> tuple[list[int], list[int], list[int]]:
    """Longest first, each item into the fullest bin that still takes it: (bin, offset) of each item and the fill of each bin."""
    bins, offsets, fills = [0] * len(lengths), [0] * len(lengths), []
    free: list[list[int]] = [[] for _ in range(limit + 1)]  # bins by free tokens
    some = 0  # bit r: a bin has r free tokens
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = some >> n
        if fitting:
            rest = n + (fitting & -fitting).bit_length() - 1
            b = free[rest].pop()
            if not free[rest]:
                some ^= 1 << rest
        else:
            rest, b = limit, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        free[rest - n].append(b)
        some |= 1 << (rest - n)
    return bins, offsets, fills


def _local(path: str, limit: int, end: int, keep_ids: bool):
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        owners, number, start, length, crc, bodies = [], [], [], [], [], []
        for batch, texts in pieces(batches, "text", PIECE):
            rows = []
            for row, body in enumerate(encoder.encode(texts.cast(pa.large_binary()).to_pylist())):
                whole = bytes(body) + last
                for k, at in enumerate(range(0, len(whole), 4 * limit)):
                    part = whole[at : at + 4 * limit]
                    rows.append(row)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        bodies.append(part)
            owners.append(batch.column("id").take(pa.array(rows, pa.int64())))
        if not owners:
            return
        bins, offsets, fills = best_fit(length, limit)
        base = TaskContext.get().partitionId() << 32
        columns = {
            "id": pa.chunked_array(owners).combine_chunks(),
            "piece": pa.array(number, pa.int32()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
            "bin": pa.array([base + b for b in bins], pa.int64()),
            "offset": pa.array(offsets, pa.int64()),
            "fill": pa.array([fills[b] for b in bins], pa.int64()),
        } | ({"ids": pa.array(bodies, pa.binary())} if keep_ids else {})
        whole = pa.RecordBatch.from_pydict(columns)
        for first in range(0, len(whole), 10_000):
            yield whole.slice(first, 10_000)

    return run


def _group_fit(limit: int):
    def run(table: pa.Table) -> pa.Table:
        # The order of arrival must not matter: the smallest numbers come first among equal fills.
        table = table.sort_by("bin")
        bins, offsets, fills = best_fit(table.column("fill").to_pylist(), limit)
        own = table.column("bin").to_pylist()
        first = {}
        for i, (b, at) in enumerate(zip(bins, offsets)):
            if at == 0:
                first[b] = own[i]
        return pa.table({"bin": pa.array(own, pa.int64()), "parent": pa.array([first[b] for b in bins], pa.int64()), "shift": pa.array(offsets, pa.int64()), "parent_fill": pa.array([fills[b] for b in bins], pa.int64())})

    return run


def merge_underfull(bins: DataFrame, limit: int = LIMIT, nearly: int = NEARLY, group: int = GROUP) -> DataFrame | None:
    """(bin, root, shift) for the underfull ``bins`` (bin, fill), by rounds of best fit up a tree; None if there is none."""
    ship(bins.sparkSession)
    total, count, turn = None, bins.count(), 0
    while count:
        groups = math.ceil(count / group)
        dealt = bins.withColumn("part", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)))
        step = durable(dealt.groupBy("part").applyInArrow(_group_fit(limit), "bin long, parent long, shift long, parent_fill long"), "packing-round")
        if total is None:
            total = step.select("bin", F.col("parent").alias("root"), "shift")
        else:
            up = step.select(F.col("bin").alias("root"), "parent", F.col("shift").alias("more"))
            total = total.join(up, "root", "left").select("bin", F.coalesce("parent", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        bins = step.where((F.col("shift") == 0) & (F.col("parent_fill") <= limit - nearly)).select(F.col("parent").alias("bin"), F.col("parent_fill").alias("fill"))
        left = bins.count()
        if groups == 1 or left > 0.99 * count:
            break
        count, turn = left, turn + 1
    return total


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end: int = END, nearly: int = NEARLY, group: int = GROUP, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document: id, piece, start, length, ids_crc32, sequence_id, offset, with ``keep_ids`` also ids."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long" + ", ids binary" * keep_ids
    local = durable(arrow_map(slim, _local(tokenizer_path, limit, end, keep_ids), schema), "packing-pieces")
    underfull = local.where((F.col("offset") == 0) & (F.col("fill") <= limit - nearly)).select("bin", "fill")
    moved = merge_underfull(underfull, limit, nearly, group)
    columns = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    if moved is None:
        return local.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    return local.join(moved, "bin", "left").select(*columns, F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of the result of :func:`pack` with ids; a sequence's pieces are bounded by its limit."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, 0L, (n, p) -> n + octet_length(p.ids) div 4)").alias("n_tokens"), F.expr("aggregate(parts, cast('' as binary), (x, p) -> concat(x, p.ids))").alias("ids")
    )


def op13_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack(read(spark, sf_dir, "documents"), default_path())
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
