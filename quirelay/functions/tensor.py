"""Pixel arrays as Column expressions (RGBA rows, flattened)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _channels(pixels: Column, order: tuple[int, ...]) -> Column:
    """The channels of every RGBA pixel in the given order, flattened."""
    n = (F.size(pixels) / 4).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(*[F.get(pixels, i * 4 + c) for c in order])))


def standardise(pixels: Column, mean: tuple[float, ...], std: tuple[float, ...]) -> Column:
    """(v / 255 - mean) / std by channel, alpha dropped."""
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    return F.transform(_channels(pixels, (0, 1, 2)), lambda v, i: (v / F.lit(255.0) - F.get(m, i % 3)) / F.get(s, i % 3))


def bgr(pixels: Column) -> Column:
    """2 v / 255 - 1, blue first, alpha dropped."""
    return F.transform(_channels(pixels, (2, 1, 0)), lambda v: F.lit(2) * v / F.lit(255.0) - 1)


def planes(pixels: Column, area: int, stride: int, channels: int) -> Column:
    """Interleaved channels to one plane after another."""
    return F.transform(F.sequence(F.lit(0), F.lit(area * channels - 1)), lambda i: F.get(pixels, (i % area) * stride + F.floor(i / area).cast("int")))
