"""Detector and recogniser chains against one picture, one crop and one sign at a time; failing rows."""

import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from quirelay.operators import errors as E
from quirelay.operators import raster as R
from quirelay.operators import recognition as N
from quirelay.sources import dims

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models here travel to workers that can't import tests

SIGNS = list("あbc𠮷e")


def weights(seed=3):
    return np.random.default_rng(seed).normal(size=(3, 4, len(SIGNS) + 2))  # one id is beyond the signs


def line_provider():
    w = weights()

    def model(tensor):
        if not np.isfinite(tensor).all() or (tensor[:, :, 0, 0] > 0.999).all(axis=1).any():
            raise ValueError("a white corner")
        return np.einsum("nchw,chv->nwv", tensor.astype(float), w)

    return model


def plain_text(crop, width, height, long):
    """A crop's text, pixel by pixel."""
    h, w = crop.shape[:2]
    if h > w:
        crop = np.array([[crop[x][w - 1 - y] for x in range(h)] for y in range(w)])
    picture, out = R.resized(crop, width, height), []
    for x in range(width):
        scores = [sum((2.0 * picture[y][x][2 - c] / 255.0 - 1.0) * weights()[c][y][v] for c in range(3) for y in range(height)) for v in range(len(SIGNS) + 2)]
        best = max(range(len(scores)), key=lambda v: (scores[v], -v))
        if best == 0:
            break
        if best <= len(SIGNS):
            out.append(SIGNS[best - 1])
    text = "".join(out)
    if long and len(text.encode("utf-16-le")) // 2 >= long:
        cut = max(h, w) // 2
        original = crop if h <= w else None
        halves = (original[:, :cut], original[:, cut:]) if h <= w else None
        if halves is None:
            raise AssertionError("tall lines are tested short")
        return "".join(plain_text(a if a.size else np.zeros((1, 1, 4), np.uint8), width, height, 0) for a in halves)
    return text


@pytest.mark.parametrize("size,long", [(1, 98), (3, 4), (64, 98)])
def test_lines_against_single_pixels(spark, size, long):
    rng = np.random.default_rng(5)
    pictures = {p: rng.integers(0, 240, (rng.integers(3, 12), rng.integers(3, 12), 4), dtype=np.uint8) for p in range(6)}
    images = spark.createDataFrame([(p, a.shape[1], a.shape[0], a.tobytes(), "x") for p, a in pictures.items()], "page_id long, width int, height int, content binary, string string")
    rows = [(p, k, float(x := rng.integers(-2, 6)), float(y := rng.integers(-2, 6)), float(w), float(h)) for p in pictures for k, (w, h) in enumerate([(6, 2), (4, 1), (7, 4), (0, 3), (3, -1), (2, 2)])]
    lines = spark.createDataFrame(rows, "page_id long, det_idx int, x double, y double, w double, h double")
    got = {(r["page_id"], r["det_idx"]): r for r in N.recognised(images, lines, line_provider, SIGNS, f"t{size}{long}", (6, 4), size, long).collect()}
    assert len(got) == len(rows) and all(r["error"] is None for r in got.values())
    for p, k, x, y, w, h in rows:
        crop = R.crop_clamped(pictures[p], x, y, w, h)
        if w > 0 and h > 0 and crop.shape[0] > crop.shape[1] and long < 98:
            continue
        assert got[p, k]["string"] == ("" if w <= 0 or h <= 0 else plain_text(crop, 6, 4, long)), (p, k)


def test_shapes_by_crop_and_batches():
    tensors = [np.zeros((3, 2, n)) for n in (4, 8, 4, 4, 8)]
    assert [list(b) for b in N.in_batches(tensors, 2)] == [[0, 2], [3], [1, 4]]
    seen = []

    def model(t):
        seen.append(t.shape)
        return np.zeros((len(t), 3, 2))

    crops = [np.zeros((2, n, 4), np.uint8) for n in (3, 9, 3)]
    assert N.read_crops(crops, model, ["a"], lambda c: (4 if c.shape[1] < 5 else 8, 2), 10, 98) == ["", "", ""] and sorted(seen) == [(1, 3, 2, 8), (2, 3, 2, 4)]
    nan = math.nan
    assert N.best_ids(np.array([[nan, 1.0, 1.0], [nan, nan, nan], [0.0, -1.0, 0.5]])).tolist() == [1, 0, 2]
    assert N.decoded(np.array([[2, 9, 1, 0, 1], [0, 1, 1, 1, 1]]), ["a", "𠮷"]) == ["𠮷a", ""]


def test_a_broken_picture_and_crop_do_not_fail_the_job(spark, tmp_path):
    good, white = np.full((4, 4, 4), 7, np.uint8), np.full((4, 4, 4), 255, np.uint8)
    images = spark.createDataFrame([(1, 4, 4, good.tobytes()), (2, 4, 4, b"short"), (3, 4, 4, white.tobytes()), (4, None, 4, None)], "page_id long, width int, height int, content binary").coalesce(1)
    lines = spark.createDataFrame([(p, k, 0.0, 0.0, 4.0, 2.0) for p in (1, 2, 3, 4, 5) for k in (0, 1)], "page_id long, det_idx int, x double, y double, w double, h double")
    got = N.recognised(images, lines, line_provider, SIGNS, "broken", (6, 4), 64, 98)
    kept = E.contained(got, "recognise", ["page_id", "det_idx"], f"{tmp_path}/failed")
    assert sorted((r["page_id"], r["det_idx"]) for r in kept.collect()) == [(1, 0), (1, 1)] and "error" not in kept.columns
    failed = spark.read.parquet(f"{tmp_path}/failed")
    assert sorted(tuple(r) for r in E.counted(failed).collect()) == [("recognise", "ValueError", 4), ("recognise", "no picture", 4)]
    assert '{"page_id":2,"det_idx":1}' in {r["key"] for r in failed.collect()}


def page_provider():
    def model(tensor):
        if tensor.max() > 2.6:  # white
            raise RuntimeError("too bright\nmore")
        return [{"label": np.array([2, 40]), "box": np.array([[0, 0, t.shape[1], 1], [1, 1, 2, 2]], np.float32), "score": np.array([0.25, 0.9 if t.sum() > 0 else 0.5], np.float32)} for t in tensor]

    return model


def test_detections_by_single_pictures(spark):
    rng = np.random.default_rng(7)
    pictures = {f"p{k}": rng.integers(0, 200, (4, 5 + k, 4), dtype=np.uint8) for k in range(5)} | {"white": np.full((3, 3, 4), 255, np.uint8)}
    images = spark.createDataFrame([(p, a.shape[1], a.shape[0], a.tobytes()) for p, a in pictures.items()] + [("bad", 9, 9, b"")], "image_id string, width int, height int, content binary").coalesce(1)
    found, failed = N.detected(images, page_provider, "pages", dims.classes(spark), side=8, size=3)
    assert {(r["image_id"], r["error"].split(":")[0]) for r in failed.collect()} == {("white", "RuntimeError"), ("bad", "ValueError")}
    want = []
    for p, a in pictures.items():
        if p != "white":
            t = R.standardised(R.letterboxed(a, 8))
            side = max(a.shape[:2])
            corner = [int(math.floor(v * side / 8 + 0.5)) for v in (1, 1, 2, 2)]
            want.append((p, 1, 39, "class_39", float(np.float32(0.9 if t.sum() > 0 else 0.5)), *corner, 0))
    assert sorted(map(tuple, found.select("page_id", "det_idx", "class_idx", "class_name", "conf", "x1", "y1", "x2", "y2", "pred_char_cnt").collect())) == sorted(want)


def test_sessions_by_their_names():
    class Named:
        def __init__(self, name):
            self.name = name

    class Session:
        def __init__(self, inputs, outputs, f):
            self.inputs, self.outputs, self.f = inputs, outputs, f

        def get_inputs(self):
            return list(map(Named, self.inputs))

        def get_outputs(self):
            return list(map(Named, self.outputs))

        def run(self, _, feeds):
            return self.f(feeds)

    feeds = {}
    session = Session(["orig_target_sizes", "Images"], ["Scores", "Labels", "Boxes", "char_counts"], lambda f: feeds.update(f) or [np.ones((2, 1)), np.array([[3], [4]]), np.zeros((2, 1, 4)), np.array([[5], [6]])])
    got = N.page_model(session, 8)(np.zeros((2, 3, 8, 8), np.float32))
    assert feeds["Images"].shape == (2, 3, 8, 8) and feeds["orig_target_sizes"].tolist() == [[8, 8], [8, 8]]
    assert [(g["label"].tolist(), g["score"].tolist(), g["char_count"].tolist()) for g in got] == [([3], [1.0], [5]), ([4], [1.0], [6])]
    plain = Session(["x"], ["a", "b", "c"], lambda f: [np.array([[1]]), np.zeros((1, 1, 4)), np.ones((1, 1))])
    assert N.page_model(plain, 8)(np.zeros((1, 3, 8, 8)))[0].keys() == {"label", "box", "score"}
    assert N.line_model(Session(["in"], ["out"], lambda f: [f["in"] + 1]))(np.zeros(2)).tolist() == [1, 1]
    assert N.tensor_name(["a", "Score"], "score") == "Score" and N.tensor_name(["a", "b"], "x", 1) == "b"


def test_models_are_loaded_once(monkeypatch):
    monkeypatch.setattr(N, "_loaded", {})
    done = []

    class Model:
        def __init__(self):
            done.append("loaded")

        def close(self):
            done.append("closed")

    first, second = N.loaded("a", Model), N.loaded("b", Model)
    assert N.loaded("a", Model) is first and N.loaded("b", Model) is second and done == ["loaded"] * 2
    N.loaded("c", Model)
    assert done == ["loaded", "loaded", "closed", "loaded"] and list(N._loaded) == ["b", "c"]


def test_tried_and_parsed(spark):
    rows = spark.createDataFrame([(4, 2), (1, 0), (None, 1)], "a int, b int")
    got = rows.select(E.tried(lambda a, b: float(a) / float(b), "double")("a", F.col("b")).alias("r")).select("r.*").collect()
    assert got[0] == (2.0, None) and got[1][0] is None and got[1][1].startswith("ZeroDivisionError") and got[2][0] is None
    texts = spark.createDataFrame([('{"a": 1}',), ("{oops",), (None,), ('{"a": "x"}',), ("{}",)], "t string")
    out = E.parsed(texts, "t", "struct<a:int>").collect()
    assert [(r["value"] and r["value"]["a"], r["error"] is None) for r in out] == [(1, True), (None, False), (None, True), (None, False), (None, True)]


def test_charset(spark, tmp_path):
    (tmp_path / "signs.txt").write_text("aあ𠮷\U0001f600é\n", encoding="utf-8")
    assert [tuple(r) for r in dims.charset(spark, f"{tmp_path}/signs.txt").orderBy("idx").collect()] == [(1, "a"), (2, "あ"), (3, "𠮷"), (4, "\U0001f600"), (5, "é")]
