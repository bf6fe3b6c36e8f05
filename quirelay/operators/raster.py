"""Pixels: crops, padding, letterboxing, rotation, resampling, homographies. numpy inside pandas UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = "struct<width:int,height:int,content:binary>"


def pixels(content: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(content, np.uint8).reshape(height, width, 4)


def crop_replicated(a: np.ndarray, x: int, y: int, w: int, h: int, ratio: float = 0.3, most: int = 50) -> np.ndarray:
    """The part inside the image, padded on all sides with its edge pixels."""
    part = a[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
    if not part.size:
        return np.zeros((1, 1, 4), np.uint8)
    pad = 0 if ratio <= 0 else min(int(np.floor(min(part.shape[:2]) * ratio + 0.5)), most)
    return np.pad(part, ((pad, pad), (pad, pad), (0, 0)), mode="edge")


def crop_clamped(a: np.ndarray, x: float, y: float, w: float, h: float) -> np.ndarray:
    """Clamped to the image; nothing left gives one transparent pixel."""
    x0, y0 = max(0, int(np.floor(x))), max(0, int(np.floor(y)))
    part = a[y0 : max(y0, int(np.floor(y + h))), x0 : max(x0, int(np.floor(x + w)))]
    return part if part.size else np.zeros((1, 1, 4), np.uint8)


def resized(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = a.shape[:2]
    ys, xs = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    y0, x0 = np.clip(np.floor(ys).astype(int), 0, h - 1), np.clip(np.floor(xs).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None, None], np.clip(xs - x0, 0, 1)[None, :, None]
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.uint8)


def letterboxed(a: np.ndarray, side: int = 800) -> np.ndarray:
    """On a black square of the longer side, at its top left, resized to ``side``."""
    most = max(a.shape[:2])
    square = np.zeros((most, most, 4), np.uint8)
    square[..., 3] = 255
    square[: a.shape[0], : a.shape[1]] = a
    return resized(square, side, side)


def upright(a: np.ndarray, width: int = 768, height: int = 16) -> np.ndarray:
    """Tall crops turned a quarter counter-clockwise, then stretched to the recogniser's shape."""
    return resized(np.rot90(a) if a.shape[0] > a.shape[1] else a, width, height)


def standardised(a: np.ndarray, mean=(0.485, 0.456, 0.406), std=(0.229, 0.224, 0.225)) -> np.ndarray:
    """Channel planes (3, h, w) of (v / 255 - mean) / std."""
    return ((a[..., :3] / 255.0 - np.array(mean)) / np.array(std)).transpose(2, 0, 1).astype(np.float32)


def bgr_planes(a: np.ndarray) -> np.ndarray:
    return (2.0 * a[..., 2::-1] / 255.0 - 1.0).transpose(2, 0, 1).astype(np.float32)


# --- homographies ---------------------------------------------------------------------------------------------
def homography(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> np.ndarray:
    """The 3x3 matrix that takes four points to four points; raises without a unique one."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    a = np.array(rows, float)
    if np.linalg.matrix_rank(a) < 8:
        raise ValueError("the points don't determine a homography")
    return np.append(np.linalg.solve(a, np.array(right, float)), 1.0).reshape(3, 3)


def inverse(m: np.ndarray) -> np.ndarray:
    if abs(np.linalg.det(m)) < 1e-12:
        raise ValueError("the matrix has no inverse")
    return np.linalg.inv(m)


def warped(a: np.ndarray, m: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image under ``m``: inverse mapping, bilinear, opaque black outside."""
    back = inverse(m)
    xs, ys = np.meshgrid(np.arange(width), np.arange(height))
    p = back @ np.stack([xs.ravel(), ys.ravel(), np.ones(xs.size)])
    with np.errstate(divide="ignore", invalid="ignore"):
        sx, sy = p[0] / p[2], p[1] / p[2]
    h, w = a.shape[:2]
    inside = (sx >= 0) & (sy >= 0) & (sx <= w - 1) & (sy <= h - 1)
    sx, sy = np.where(inside, sx, 0), np.where(inside, sy, 0)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (sx - x0)[:, None], (sy - y0)[:, None]
    out = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
    out = np.floor(out + 0.5).astype(np.uint8)
    out[~inside] = (0, 0, 0, 255)
    return out.reshape(height, width, 4)


# --- columns --------------------------------------------------------------------------------------------------
def _struct(arrays: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"width": [a.shape[1] for a in arrays], "height": [a.shape[0] for a in arrays], "content": [a.tobytes() for a in arrays]})


def image_udf(f):
    """A column function (content, width, height) -> image struct from ``f(pixels) -> pixels``."""

    @F.pandas_udf(IMAGE)
    def run(content: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        return _struct([f(pixels(c, w, h)) for c, w, h in zip(content, width, height)])

    return run


def cropped(content: Column, width: Column, height: Column, x: Column, y: Column, w: Column, h: Column, ratio: float = 0.3) -> Column:
    @F.pandas_udf(IMAGE)
    def run(content: pd.Series, width: pd.Series, height: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        return _struct([crop_replicated(pixels(c, iw, ih), int(a), int(b), int(d), int(e), ratio) for c, iw, ih, a, b, d, e in zip(content, width, height, x, y, w, h)])

    return run(content, width, height, x, y, w, h)


# --- models ---------------------------------------------------------------------------------------------------
def infer(images: DataFrame, provider, schema: str) -> DataFrame:
    """``provider()`` is called once in each task and gives a function of (rows) -> rows; it holds the session.

    No model ships with this package; ``operators.recognition`` runs one whose file is given.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for batch in batches:
            if len(batch):
                yield model(batch)

    return images.mapInPandas(run, schema)


def recognise_lines(crops: list[np.ndarray], read, long: int = 98) -> list[str]:
    """Texts of line crops by ``read(list of crops) -> list of texts``.

    A text of ``long`` UTF-16 units or more is dropped, its crop halved on the long side once, and both halves read; an
    empty half is one transparent pixel.
    """
    texts = read(crops)
    again = [k for k, t in enumerate(texts) if len(t.encode("utf-16-le")) // 2 >= long]
    halves = []
    for k in again:
        a = crops[k]
        cut = max(a.shape[:2]) // 2
        halves += [a[:cut], a[cut:]] if a.shape[0] > a.shape[1] else [a[:, :cut], a[:, cut:]]
    found = read([a if a.size else np.zeros((1, 1, 4), np.uint8) for a in halves]) if halves else []
    for n, k in enumerate(again):
        texts[k] = found[2 * n] + found[2 * n + 1]
    return texts
