"""Line dedup by pairwise alignment: common blocks of lines go from the later document.

1. Each text gives hashes of its lines. Lines of few words (menus, closings) are common and say nothing about
   overlap, so the rare hashes are those of lines of ``min_words`` words and, where a line is shorter, of the
   shortest run of lines from it on, and back to it, that has so many words.
2. A later document is paired with the earliest document of each of its shared hashes, whichever that is, so
   every common run of ``min_words`` words or more stands in a pair of which the earlier document holds it whole.
   These pairs grow with the lines, not with the square of the documents that share them.
3. Each pair is aligned by patience diff: lines matched once on both sides are anchors, the longest sequence of
   anchors that rises in both documents is kept, and the gaps between anchors are aligned in the same way; where
   a gap has no anchor, its longest rising sequence of matches is taken. Matched lines that follow each other on
   both sides are blocks. What isn't aligned (a moved passage, a passage repeated in the later document)
   is aligned again, for ``ROUNDS`` rounds; what is left then is a block of its own.
4. The blocks of all pairs go from the later document.

So a line goes if, and only if, it stands in a run of consecutive lines of ``min_words`` words or more that some
earlier document holds as consecutive lines.

Lines and runs are compared by 128-bit hashes of their whole text; a task aligns one document at a time, and sees
no group of documents.

Defined cases: a null text has no lines and stays null; blank lines are never shared, and don't interrupt a
run or block; a carriage return at the end of a line doesn't count; a text of which all lines go becomes ''; ids order documents (whole
numbers as such, others as text), a null id comes last, and rows with
equal ids are ordered by a hash of their text; rows equal in id and text are one document and change alike;
further columns are passed through, but for those with the names of the appended ones.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowio import arrow_map, pieces
from .util import durable, read

MIN_WORDS, ROUNDS = 10, 8
#: Bytes that a step handles for each run of lines, about.
RUN_BYTES = 96
#: Stands for a null id, after all others.
LAST_NUMBER, LAST_TEXT = 2**63 - 1, "\U0010ffff"


def keyed_runs(text: str, min_words: int) -> list[tuple[int, int, int, int]]:
    """(high, low, first line, lines) of the least runs of ``min_words`` words that a line opens or closes."""
    ends, digests = [0], []
    for line in text.split("\n"):
        if n := len(line.split()):
            ends.append(ends[-1] + n)
            digests.append(xxhash.xxh3_128_digest(line.removesuffix("\r").encode()))
    least = max(min_words, 1)
    opened = ((k, bisect_left(ends, e + least)) for k, e in enumerate(ends))
    closed = ((bisect_right(ends, e - least) - 1, k) for k, e in enumerate(ends))
    spans = {(a, b) for a, b in opened if b < len(ends)} | {(a, b) for a, b in closed if a >= 0}
    out = []
    for a, b in sorted(spans):
        whole = xxhash.xxh3_128_intdigest(b"".join(digests[a:b]))
        out.append(((whole >> 64) - 2**63, (whole & (2**64 - 1)) - 2**63, a, b - a))
    return out


def rising(pairs: list[tuple[int, int]]) -> list[int]:
    """Indices of a longest run of ``pairs`` (sorted by the first number) that rises in both numbers."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tails, b)
        back.append(at[i - 1] if i else -1)
        if i == len(tails):
            tails.append(b)
            at.append(k)
        else:
            tails[i], at[i] = b, k
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """An alignment out of distinct matches (line of the later, line of the earlier document), rising in both."""
    out, todo = [], [sorted(matches)]
    while todo:
        part = todo.pop()
        later, earlier = Counter(a for a, _ in part), Counter(b for _, b in part)
        once = [m for m in part if later[m[0]] == 1 == earlier[m[1]]]
        anchors = [once[k] for k in rising(once)]
        if not anchors:
            part.sort(key=lambda m: (m[0], -m[1]))
            out += [part[k] for k in rising(part)]
            continue
        out += anchors
        at, gaps = [a for a, _ in anchors], {}
        for a, b in part:
            k = bisect_left(at, a)
            below, above = anchors[k - 1] if k else (-1, -1), anchors[k] if k < len(anchors) else None
            if below[1] < b and (above is None or (a < above[0] and b < above[1])):
                gaps.setdefault(k, []).append((a, b))
        todo += gaps.values()
    return sorted(out)


def common_blocks(shared: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Blocks (line, line of the earlier document, lines) of one pair, out of its shared runs in the same form."""
    rest, out = sorted(set(shared)), []
    for left in range(ROUNDS, -1, -1):
        if not rest:
            break
        blocks: list[list[int]] = []
        for a, b in patience(list({(a + k, b + k) for a, b, n in rest for k in range(n)})) if left else ():
            if blocks and (a, b) == (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]):
                blocks[-1][2] += 1
            else:
                blocks.append([a, b, 1])
        starts, used, missed = [x[0] for x in blocks], set(), []
        for a, b, n in rest:
            k = bisect_right(starts, a) - 1
            if k >= 0 and blocks[k][1] - blocks[k][0] == b - a and a + n <= blocks[k][0] + blocks[k][2]:
                used.add(k)
            else:
                missed.append((a, b, n))
        if not used:
            return out + missed
        out += [tuple(blocks[k]) for k in sorted(used)]
        rest = missed
    return out


def _key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_NUMBER)) if whole else F.coalesce(F.col(id_col).cast("string"), F.lit(LAST_TEXT))
    return own, F.xxhash64(F.col(text_col))


def _cut(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the lines in the blocks of ``gone`` (id, th, gone); blank lines have no number."""
    own_id, own_hash = _key(docs, id_col, text_col)
    names = docs.columns
    keyed = docs.withColumns({"__id": own_id, "__th": own_hash})
    joined = keyed.join(gone.withColumnsRenamed({"id": "__gid", "th": "__gth"}), (F.col("__id") == F.col("__gid")) & (F.col("__th") == F.col("__gth")), "left").select(*names, F.col("gone").alias("__gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index(text_col)
        for batch, _ in pieces(batches, text_col):
            texts, gone_lists = batch.column(place).to_pylist(), batch.column(len(names)).to_pylist()
            gone_words, gone_count = [0] * len(texts), [0] * len(texts)
            for k, lost in enumerate(gone_lists):
                if lost:
                    lost_set, rest, at = {x for b in lost for x in range(b["line"], b["line"] + b["lines"])}, [], 0
                    gone_count[k] = len(lost_set)
                    for line in texts[k].split("\n"):
                        words = len(line.split())
                        if not words or at not in lost_set:
                            rest.append(line)
                        else:
                            gone_words[k] += words
                        at += words > 0
                    texts[k] = "\n".join(rest) if any(x.split() for x in rest) else ""
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone_count, pa.int64()), pa.array(gone_words, pa.int64())], names=[*names, "removed_lines", "removed_words"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(joined, cut, f"{fields}, removed_lines long, removed_words long")


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each aligned pair: id, th (hash of the text), owner, owner_th, blocks array<struct<line, owner_line, lines>>.

    The owner is the earlier document. Lines are numbered from 0, blank ones left out.
    """
    return _alignments(docs, id_col, text_col, min_words)[0]


def _alignments(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, int]:
    """``alignments``, and how many bytes they read at most, about."""
    own_id, own_hash = _key(docs, id_col, text_col)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", 1 << 20):
            found = [keyed_runs(t, min_words) for t in texts.to_pylist()]
            take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int64))
            flat = [x for f in found for x in f]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("th").take(take), *[pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]],
                names=["id", "th", "hi", "lo", "line", "lines"],
            )

    slim = docs.select(own_id.alias("id"), own_hash.alias("th"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    runs = durable(arrow_map(slim, split, f"id {id_type}, th long, hi long, lo long, line int, lines int"), "runs")
    most = runs.count() * RUN_BYTES
    # Written, so that a run of very many documents can be split by the join.
    shared = durable(
        runs.groupBy("hi", "lo").agg(F.min(F.struct("id", "th", "line")).alias("first"), F.max(F.struct("id", "th")).alias("last")).where("struct(first.id, first.th) != last").select("hi", "lo", "first"),
        "shared-runs",
        most,
    )
    pair = ["id", "th", "owner", "owner_th"]
    matched = runs.join(shared, ["hi", "lo"]).where("struct(id, th) != struct(first.id, first.th)").select("id", "th", F.col("first.id").alias("owner"), F.col("first.th").alias("owner_th"), "line", F.col("first.line").alias("owner_line"), "lines")
    # Rows equal in id and text give equal runs; they count once.
    matched = matched.repartition("id", "th").dropDuplicates([*pair, "line", "owner_line", "lines"]).sortWithinPartitions(*pair)
    block = pa.list_(pa.struct([("line", pa.int32()), ("owner_line", pa.int32()), ("lines", pa.int32())]))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        types = None

        def table(rows: list) -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            blocks = [[{"line": a, "owner_line": b, "lines": n} for a, b, n in r[4]] for r in rows]
            return pa.RecordBatch.from_arrays([*columns, pa.array(blocks, block)], names=[*pair, "blocks"])

        for batch in batches:
            types, done = [c.type for c in batch.columns[:4]], []
            for *key, a, b, n in zip(*[c.to_pylist() for c in batch.columns]):
                if key != last:
                    if held:
                        done.append((*last, common_blocks(held)))
                    last, held = key, []
                held.append((a, b, n))
            if done:
                yield table(done)
        if held:
            yield table([(*last, common_blocks(held))])

    return arrow_map(matched, aligned, f"id {id_type}, th long, owner {id_type}, owner_th long, blocks array<struct<line:int,owner_line:int,lines:int>>"), most


def without_shared_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the blocks of ``min_words`` words or more that earlier documents have; ``removed_lines`` and ``removed_words`` are appended."""
    docs = docs.drop(*{"removed_lines", "removed_words"} - {id_col, text_col})
    found, most = _alignments(docs, id_col, text_col, min_words)
    gone = durable(found.groupBy("id", "th").agg(F.flatten(F.collect_list("blocks")).alias("gone")), "gone-blocks", most)
    return _cut(docs, gone, id_col, text_col)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return without_shared_blocks(docs)
