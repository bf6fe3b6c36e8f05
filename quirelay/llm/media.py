"""Media columns with content-defined chunks that are stored once.

A payload (bytes of any kind; texts are UTF-8 padded with blanks to a multiple of ``UNIT``) is cut where a rolling
gear hash of its last 32 bytes is small, so equal passages give equal chunks wherever they stand. The steps:

1. one narrow row for each chunk: payload key, place, digest; digests with more than one row are shared;
2. a Bloom filter of the shared digests is broadcast; it has 16 bits for each, counted first, and ``MOST_BITS`` (8 MiB) at most.
   In a second pass each payload's record is stored: mark, payload size, number of chunks, length, stored
   length and digest of each, then the compressed bodies of chunks outside the
   filter. Bodies of the others go into a column of their own. A false positive moves a body
   there as well, and changes nothing else;
3. the store holds one body for each shared digest (map-side minima, then one join), records that need
   bodies from it get them by a join on the digest;
4. what was stored is read back: bodies are inflated, each chunk's digest is verified, and size, checksums and
   features come from those bytes.

The stored form of a payload is its record as it is written, so ``media_bytes`` and ``media_sha256`` are those of stored bytes,
and a shared chunk counts 24 bytes there, its body being in the store once; equal payloads have equal records.

Defined cases: null texts are empty payloads, padded like others; equal texts, one key and equal values;
equal rows are returned each; an empty table gives an empty one; a chunk that differs from its digest raises an error; further columns are
ignored; texts of any length are stored whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import arrow_map, pieces
from .util import drop_durable, durable, read

UNIT = 192
LEAST, MOST, SMALL = 512, 16384, np.uint32(1 << 21)  # cuts where the hash is below 2**21: 2 KiB on average after LEAST
LEAST_BITS, MOST_BITS, PROBES = 1 << 16, 1 << 26, 4
MARK = b"QCDC"
_rng = np.random.default_rng(31)
GEAR = _rng.integers(0, 2**32, 256, dtype=np.uint32)


def padded(text: str) -> bytes:
    raw = text.encode()
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


def cut(payload: bytes) -> list[bytes]:
    """Chunks of a payload; cuts depend on the 32 bytes before them and on the last cut alone."""
    n = len(payload)
    if n <= LEAST:
        return [payload]
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for w in (1, 2, 4, 8, 16):  # the hash over 2w bytes from that over w
        wide = h.copy()
        wide[w:] += h[:-w] << np.uint32(w)
        h = wide
    out, start = [], 0
    for end in (np.flatnonzero(h < SMALL) + 1).tolist():
        while end - start > MOST:
            out.append(payload[start : start + MOST])
            start += MOST
        if end - start >= LEAST:
            out.append(payload[start:end])
            start = end
    while n - start > MOST:
        out.append(payload[start : start + MOST])
        start += MOST
    return [*out, payload[start:]] if start < n else out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def record(parts: list[tuple[bytes, int, bytes | None]]) -> bytes:
    """The stored form from (digest, length, compressed body, or None for a shared chunk) in order."""
    table = b"".join(struct.pack("<II", size, len(body or b"")) + digest for digest, size, body in parts)
    return MARK + struct.pack("<QI", sum(size for _, size, _ in parts), len(parts)) + table + b"".join(body or b"" for *_, body in parts)


def listed_chunks(stored: bytes) -> list[tuple[int, int, bytes]]:
    """(length, stored length, digest) of a record's chunks; the stored length of a shared chunk is 0."""
    if stored[:4] != MARK:
        raise ValueError("not a record")
    n = struct.unpack_from("<QI", stored, 4)[1]
    return [(*struct.unpack_from("<II", stored, at), stored[at + 8 : at + 24]) for at in range(16, 16 + 24 * n, 24)]


def read_record(stored: bytes, shared: dict[bytes, bytes]) -> tuple[bytes, list[int]]:
    """(payload, chunk sizes) of a record and the bodies of its shared chunks by digest; every chunk is verified."""
    rows = listed_chunks(stored)
    at, out = 16 + 24 * len(rows), []
    for length, packed, digest in rows:
        chunk = zlib.decompress(stored[at : at + packed] if packed else shared[digest])
        if len(chunk) != length or digest_of(chunk) != digest:
            raise ValueError("a stored chunk differs from its digest")
        out.append(chunk)
        at += packed
    payload = b"".join(out)
    if len(payload) != struct.unpack_from("<Q", stored, 4)[0] or at != len(stored):
        raise ValueError("not a whole record")
    return payload, [r[0] for r in rows]


def described(stored: bytes, shared: dict[bytes, bytes]) -> dict:
    """What is computed from the stored bytes once they are read back."""
    payload, sizes = read_record(stored, shared)
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    feature = f"chunks={len(sizes)};longest={max(sizes)};symbols={int((counts > 0).sum())};bits={-(share * np.log2(share)).sum():.4f}"
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(stored),
        "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": feature,
    }


OUT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
NAMES = [x.split()[0] for x in OUT.split(", ")]


def _columns(rows: list[dict]) -> list[pa.Array]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return [pa.array([r[n] for r in rows], kinds[x.split()[1]]) for n, x in zip(NAMES, OUT.split(", "))]


def probes(digest: bytes, size: int) -> list[int]:
    a, b = struct.unpack("<QQ", digest)
    return [(a + k * (b | 1)) % size for k in range(PROBES)]


def bloom_of(shared: DataFrame) -> np.ndarray:
    """The bits as 32-bit words, set for every digest of ``shared``; at most MOST_BITS / 32 rows reach the driver."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * shared.count()).bit_length()))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, int] = {}
        for batch in batches:
            for d in batch.column(0).to_pylist():
                for p in probes(d, size):
                    words[p >> 5] = words.get(p >> 5, 0) | 1 << (p & 31)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.int32()), pa.array(list(words.values()), pa.int64())], names=["word", "bits"])

    rows = arrow_map(shared, bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 32, np.uint32)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored media table: id, key (of the payload), n_bytes, record, alone (it needs no shared chunk), bodies (of shared chunks: digest, body)."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "text"):
            rows = [digest_of(c) for t in texts.to_pylist() for c in cut(padded(t))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["digest"])

    shared = durable(arrow_map(slim, listed, "digest binary").groupBy("digest").count().where("count > 1").select("digest"), "shared-digests")
    bloom = slim.sparkSession.sparkContext.broadcast(bloom_of(shared))
    body = pa.list_(pa.struct([("digest", pa.binary()), ("body", pa.binary())]))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bloom.value
        for batch, texts in pieces(batches, "text"):
            keys, sizes, records, alone, bodies = [], [], [], [], []
            known: set[bytes] = set()
            for text in texts.to_pylist():
                payload = padded(text)
                keys.append(digest_of(payload))
                sizes.append(len(text.encode()))
                own, moved = [], []
                for c in cut(payload):
                    d = digest_of(c)
                    if all(words[p >> 5] >> np.uint32(p & 31) & np.uint32(1) for p in probes(d, 32 * len(words))):
                        own.append((d, len(c), None))
                        if d not in known:
                            known.add(d)
                            moved.append({"digest": d, "body": zlib.compress(c, 6)})
                    else:
                        own.append((d, len(c), zlib.compress(c, 6)))
                records.append(record(own))
                alone.append(all(b for *_, b in own))
                bodies.append(moved)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(records, pa.binary()), pa.array(alone, pa.bool_()), pa.array(bodies, body)],
                names=["id", "key", "n_bytes", "record", "alone", "bodies"],
            )

    return durable(arrow_map(slim, stored, f"id {id_type}, key binary, n_bytes long, record binary, alone boolean, bodies array<struct<digest:binary,body:binary>>"), "media")


def read_back(media: DataFrame) -> DataFrame:
    """A row for each row of the stored table: id, n_bytes and what is described of the bytes read back."""
    id_type = media.schema["id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(r, {}) for r in batch.column("record").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *_columns(rows)], names=["id", "n_bytes", *NAMES])

    alone = arrow_map(media.where("alone").select("id", "n_bytes", "record"), whole, f"id {id_type}, n_bytes long, {OUT}")
    store = durable(media.select(F.explode("bodies").alias("b")).groupBy(F.col("b.digest").alias("digest")).agg(F.min("b.body").alias("stored")), "chunk-store")
    records = durable(media.where("not alone").select("key", "record").dropDuplicates(["key"]), "records")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, d) for k, r in zip(batch.column("key").to_pylist(), batch.column("record").to_pylist()) for d in {d for _, packed, d in listed_chunks(r) if not packed}]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.binary())], names=["key", "digest"])

    found = arrow_map(records, wanted, "key binary, digest binary").join(store, "digest").select("key", "digest", F.col("stored").alias("body"))
    every = found.unionByName(records.select("key", F.lit(None).cast("binary").alias("digest"), F.col("record").alias("body")))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, shared, done = None, b"", {}, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), *_columns([d for _, d in done])], names=["key", *NAMES])

        for batch in batches:
            for k, d, body in zip(*[c.to_pylist() for c in batch.columns]):
                if k != key:
                    if key is not None:
                        done.append((key, described(own, shared)))
                    key, own, shared = k, b"", {}
                if d is None:
                    own = body
                else:
                    shared[d] = body
            if len(done) >= 1000:
                yield flush()
                done = []
        if key is not None:
            done.append((key, described(own, shared)))
        if done:
            yield flush()

    again = arrow_map(every.repartition("key").sortWithinPartitions("key").select("key", "digest", "body"), joined, f"key binary, {OUT}")
    copies = media.where("not alone").select("id", "key", "n_bytes").join(durable(again, "described"), "key").select("id", "n_bytes", *NAMES)
    drop_durable(media.sparkSession, store)
    drop_durable(media.sparkSession, records)
    return alone.unionByName(copies)


def op8_media(spark, sf_dir: str) -> DataFrame:
    found = read_back(store_texts(read(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id")
