"""Images: files, data URLs, decoding of PNG in plain Python where the JVM's reader can't be used."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Name patterns of picture files.
PATTERN = "*.{png,jpg,jpeg,gif,bmp,webp}"


def files(spark: SparkSession, path: str, pattern: str = PATTERN) -> DataFrame:
    """Picture files as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def arriving(spark: SparkSession, path: str, once: bool = False, archive: str | None = None) -> DataFrame:
    """A stream of picture files; with ``once`` a file is removed (or moved to ``archive``) after it was read."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", PATTERN)
    if once:
        reader = reader.option("cleanSource", "archive" if archive else "delete")
        if archive:
            reader = reader.option("sourceArchiveDir", archive)
    return reader.load(path)


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """Pictures decoded by the JVM: image_id, width, height, RGBA bytes."""
    img = F.col("image")
    return spark.read.format("image").option("dropInvalid", True).load(path).select(img["origin"].alias("image_id"), img["width"].alias("width"), img["height"].alias("height"), rgba(img["data"], img["nChannels"]).alias("content"))


def decode_png(png: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA bytes) of a PNG of 8 bits a sample, grey or colour, with or without alpha, not interlaced."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, [], None
    while at + 12 <= len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        part = png[at + 8 : at + 8 + size]
        if len(part) < size or zlib.crc32(kind + part) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a damaged PNG")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("a kind of PNG that isn't read")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * channels)
    rows, above = np.zeros((h, w, channels), np.uint8), np.zeros((w, channels), np.int32)
    for y in range(h):
        line = raw[y, 1:].reshape(w, channels).astype(np.int32)
        kind = raw[y, 0]
        if kind == 2:
            line = line + above
        elif kind in (1, 3, 4):
            left, corner = np.zeros(channels, np.int32), np.zeros(channels, np.int32)
            for x in range(w):
                up = above[x]
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                line[x] = (line[x] + guess) & 255
                left, corner = line[x], up
        above = line & 255
        rows[y] = above
    full = np.full((h, w, 4), 255, np.uint8)
    full[..., :3] = rows[..., :3] if channels >= 3 else rows[..., :1]
    if channels in (2, 4):
        full[..., 3] = rows[..., -1]
    return w, h, full.tobytes()


def decoded_content(files: DataFrame) -> DataFrame:
    """``files`` (path, content of PNG files, of a table or a stream) as path, width, height, RGBA content, error; a file that can't be read has its error alone."""
    from ..operators.errors import tried

    ship(files.sparkSession)
    read = tried(lambda png: dict(zip(("width", "height", "content"), decode_png(bytes(png)))), "struct<width:int,height:int,content:binary>")
    return files.select("path", read("content").alias("r")).select("path", "r.value.width", "r.value.height", "r.value.content", "r.error")


def rgba(data: Column, channels: Column) -> Column:
    """BGR or BGRA or grey bytes to RGBA."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for d, c in zip(data, channels):
            a = np.frombuffer(d, np.uint8).reshape(-1, c)
            full = np.full((len(a), 4), 255, np.uint8)
            full[:, :3] = a[:, [2, 1, 0]] if c >= 3 else a[:, :1]
            if c == 4:
                full[:, 3] = a[:, 3]
            out.append(full.tobytes())
        return pd.Series(out)

    return run(data, channels)


def data_url_bytes(url: Column) -> Column:
    return F.unbase64(F.substring_index(url, ",", -1))


def image_type(mime: Column) -> Column:
    return mime.startswith("image/")


def pasted(items: DataFrame, paste: str = "paste_id") -> DataFrame:
    """The first picture of each paste or drop: of its items (pos, mime, content) in order, the first whose kind is a picture's. Others have no row."""
    pictures = items.where(image_type(F.col("mime")))
    return pictures.groupBy(paste).agg(F.min_by(F.struct("pos", "mime", "content"), "pos").alias("first")).select(paste, "first.*")


def encode_png(rgba_bytes: bytes, width: int, height: int) -> bytes:
    """An 8-bit RGBA PNG."""
    rows = np.frombuffer(rgba_bytes, np.uint8).reshape(height, width * 4)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")
