"""Arrow batches in pieces of bounded size, for operators that run Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..ship import ship

#: Bytes of text handled at once; a single longer text is a piece of its own.
PIECE = 4 << 20


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array, null as ''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def cuts(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows whose texts have about ``limit`` bytes together."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end
        first = end


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with their texts."""
    for batch in batches:
        texts = text_array(batch.column(text))
        for first, end in cuts(texts, limit):
            yield batch.slice(first, end - first), texts.slice(first, end - first)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes as uint8, offsets from 0) of a large_string array, without a copy of the bytes."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package sent along, for executors on which it isn't installed."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def split_at_blanks(raw: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Tokens of ``raw``, which ends with a blank, each with the one blank after it, and where they end; copies nothing."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return tokens.dictionary_encode(), ends
