"""Pixels, homographies, PNG, model interface."""

import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from quirelay.functions import geometry as G
from quirelay.operators import raster as R
from quirelay.sources import images as I


def test_crops_and_padding():
    a = np.arange(6 * 8 * 4, dtype=np.uint8).reshape(6, 8, 4)
    c = R.crop_replicated(a, 2, 1, 4, 4, 0.5)
    assert c.shape == (8, 8, 4) and (c[0, 0] == a[1, 2]).all() and (c[-1, -1] == a[4, 5]).all() and (c[2:6, 2:6] == a[1:5, 2:6]).all()
    assert R.crop_clamped(a, -5, -5, 7, 7).shape == (2, 2, 4) and R.crop_clamped(a, 90, 0, 5, 5).tolist() == [[[0, 0, 0, 0]]]


def test_tensors():
    px = np.array([[[255, 128, 0, 255]]], np.uint8)
    assert np.allclose(R.bgr_planes(px).ravel(), [-1, 2 * 128 / 255 - 1, 1])
    assert R.standardised(np.zeros((2, 3, 4), np.uint8)).shape == (3, 2, 3)
    assert R.letterboxed(np.full((2, 4, 4), 9, np.uint8), 4)[3, 0].tolist() == [0, 0, 0, 255]
    assert R.upright(np.zeros((30, 4, 4), np.uint8)).shape == (16, 768, 4)


def test_homography():
    src, dst = [(0, 0), (10, 0), (10, 10), (0, 10)], [(1, 2), (11, 3), (12, 14), (0, 12)]
    m = R.homography(src, dst)
    for (x, y), (u, v) in zip(src, dst):
        p = m @ [x, y, 1]
        assert np.allclose(p[:2] / p[2], (u, v))
    assert np.allclose(R.inverse(m) @ m, np.eye(3))
    with pytest.raises(ValueError):
        R.homography([(0, 0)] * 4, dst)
    with pytest.raises(ValueError):
        R.inverse(np.zeros((3, 3)))
    a = np.random.default_rng(1).integers(0, 255, (5, 5, 4), dtype=np.uint8)
    assert (R.warped(a, np.eye(3), 5, 5) == a).all()
    shifted = R.warped(a, np.array([[1, 0, 2], [0, 1, 0], [0, 0, 1.0]]), 5, 5)
    assert shifted[0, 0].tolist() == [0, 0, 0, 255] and (shifted[:, 2:] == a[:, :3]).all()


def test_png(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 255, (3, 4, 4), dtype=np.uint8)
    a[..., 3] = 255
    png = I.encode_png(a.tobytes(), 4, 3)
    (tmp_path / "x.png").write_bytes(png)
    row = I.decoded(spark, str(tmp_path)).first()
    assert (row["width"], row["height"]) == (4, 3) and bytes(row["content"]) == a.tobytes()
    assert I.files(spark, str(tmp_path)).count() == 1 and zlib.crc32(png) and io.BytesIO(png)


def test_long_lines_are_halved():
    crop = np.zeros((2, 8, 4), np.uint8)
    read = lambda x: ["w" * (100 if a.shape[1] == 8 else a.shape[1]) for a in x]
    assert R.recognise_lines([crop, crop[:, :3]], read) == ["wwwwwwww", "www"]


def test_geometry(spark):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    tri = F.array(point(0, 0), point(10, 0), point(0, 10))
    got = spark.range(1).select(*[G.point_in_polygon(F.lit(x), F.lit(y), tri) for x, y in ((2.0, 2.0), (5.0, 0.0), (8.0, 8.0), (0.0, 3.0))]).first()
    assert list(got) == [1, 0, -1, 0]
    pads = [spark.range(1).select(G.padding(F.lit(w), F.lit(h), r)).first()[0] for w, h, r in ((600, 40, 0.5), (500, 500, 1.0), (300, 80, 0), (500, 24, 0.3))]
    assert pads == [20, 50, 0, 7]
