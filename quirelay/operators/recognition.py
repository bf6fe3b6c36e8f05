"""From pictures to detections and from lines to texts: batches of tensors through a model, decoded to signs.

A page's picture travels once, with the list of its lines. In a task the lines' crops are brought to the model's shape,
collected over pages into batches of equal shape, and each batch is one call of the model. No model ships with the
package: a provider loads one, once for each worker process and key.

A picture or a crop that can't be handled doesn't fail the job: its rows have an ``error`` and no result, see
``operators.errors``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from ..sources.dims import DETECTOR_SIDE, MIN_SCORE, RECOGNISER_SHAPE
from .detections import postprocess
from .errors import said
from .raster import bgr_planes, crop_clamped, letterboxed, pixels, recognise_lines, standardised, upright

#: A model of lines: tensor (n, 3, height, width) to scores (n, steps, signs). One of pages: tensor (n, 3, side, side) to a
#: list of n dicts with label, box, score and optionally char_count.
Model = Callable[[np.ndarray], np.ndarray]

#: Models that a worker process keeps: a detector and a recogniser.
KEPT = 2
_loaded: dict[str, object] = {}


def loaded(key: str, provider: Callable[[], object]) -> object:
    """The provider's model, loaded once in this process; of more than ``KEPT`` the one loaded first goes, and is closed if it can be."""
    if key not in _loaded:
        while len(_loaded) >= KEPT:
            getattr(_loaded.pop(next(iter(_loaded))), "close", lambda: None)()
        _loaded[key] = provider()
    return _loaded[key]


def best_ids(scores: np.ndarray) -> np.ndarray:
    """The first largest score of each step; NaN never wins, 0 if there is none."""
    return np.where(np.isnan(scores), -np.inf, scores).argmax(axis=-1)


def decoded(ids: np.ndarray, charset: list[str]) -> list[str]:
    """One text for each row: up to the first 0; id i is the i-th sign; other ids are skipped."""
    out = []
    for row in ids:
        zero = np.flatnonzero(row == 0)
        upto = row[: zero[0]] if len(zero) else row
        out.append("".join(charset[i - 1] for i in upto.tolist() if 0 < i <= len(charset)))
    return out


def in_batches(tensors: list[np.ndarray], size: int) -> Iterator[list[int]]:
    """Numbers of tensors of equal shape, at most ``size`` together."""
    order = sorted(range(len(tensors)), key=lambda k: (tensors[k].shape, k))
    for _, same in groupby(order, key=lambda k: tensors[k].shape):
        ks = list(same)
        yield from (ks[i : i + size] for i in range(0, len(ks), size))


def read_crops(crops: list[np.ndarray], model: Model, charset: list[str], shape: Callable[[np.ndarray], tuple[int, int]], size: int, long: int) -> list[str]:
    """Texts of line crops; a text of ``long`` units or more is dropped and its crop's halves are read instead."""

    def read(some: list[np.ndarray]) -> list[str]:
        tensors = [bgr_planes(upright(c, *shape(c))) for c in some]
        texts = [""] * len(some)
        for ks in in_batches(tensors, size):
            for k, t in zip(ks, decoded(best_ids(np.asarray(model(np.stack([tensors[k] for k in ks])))), charset)):
                texts[k] = t
        return texts

    return recognise_lines(crops, read, long)


def recognised(images: DataFrame, lines: DataFrame, provider: Callable[[], Model], charset: list[str], key: str, shape=RECOGNISER_SHAPE, size: int = 64, long: int = 98) -> DataFrame:
    """(page_id, det_idx, string, error) for every line (page_id, det_idx, x, y, w, h) of the pictures (page_id, width, height, content).

    Lines without area have '' and are not read; lines whose page has no picture have an error. ``shape`` is (width,
    height) or a function of the crop that gives it.
    """
    ship(images.sparkSession)
    shape_of = shape if callable(shape) else lambda crop: shape
    page_type = lines.schema["page_id"].dataType.simpleString()
    place = F.struct(F.col("det_idx").cast("long").alias("det_idx"), *[F.col(c).cast("double").alias(c) for c in "xywh"])
    listed = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(place)).alias("lines"))
    rows = listed.join(images.select("page_id", "width", "height", "content"), "page_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(key, provider)
        waiting: list[tuple] = []  # (page, det, crop)

        def read() -> pd.DataFrame:
            crops, ids = [c for *_, c in waiting], [(p, d) for p, d, _ in waiting]
            waiting.clear()
            try:
                found = [(*i, t, None) for i, t in zip(ids, read_crops(crops, model, charset, shape_of, size, long))]
            except Exception:  # one by one, so that a bad crop has its own error
                found = []
                for i, c in zip(ids, crops):
                    try:
                        found.append((*i, *read_crops([c], model, charset, shape_of, size, long), None))
                    except Exception as e:
                        found.append((*i, None, said(e)))
            return pd.DataFrame(found, columns=["page_id", "det_idx", "string", "error"])

        for batch in batches:
            done = []
            for r in batch.itertuples():
                try:
                    picture = pixels(r.content, int(r.width), int(r.height))
                except Exception as e:
                    done += [(r.page_id, v["det_idx"], None, "no picture" if r.content is None else said(e)) for v in r.lines]
                    continue
                for v in r.lines:
                    if v["w"] <= 0 or v["h"] <= 0:
                        done.append((r.page_id, v["det_idx"], "", None))
                    else:
                        waiting.append((r.page_id, v["det_idx"], crop_clamped(picture, v["x"], v["y"], v["w"], v["h"]).copy()))
                if len(waiting) >= size:
                    yield read()
            if done:
                yield pd.DataFrame(done, columns=["page_id", "det_idx", "string", "error"])
        if waiting:
            yield read()

    return rows.mapInPandas(run, f"page_id {page_type}, det_idx long, string string, error string")


_RAW = "det_idx int, label long, box array<float>, score float, char_count long, error string"


def raw_detections(images: DataFrame, provider: Callable[[], Callable[[np.ndarray], list[dict]]], key: str, side: int = DETECTOR_SIDE, size: int = 8) -> DataFrame:
    """(image_id, det_idx, label, box, score, char_count, error): every picture letterboxed and standardised, ``size`` in one call.

    A picture that fails has one row, with its error and without a detection.
    """
    ship(images.sparkSession)
    kind = images.schema["image_id"].dataType.simpleString()
    names = ["image_id", "det_idx", "label", "box", "score", "char_count", "error"]

    def rows_of(image_id, got: dict) -> list[tuple]:
        count = got.get("char_count")
        return [(image_id, k, int(got["label"][k]), [float(x) for x in got["box"][k]], float(got["score"][k]), 0 if count is None else int(count[k]), None) for k in range(len(got["score"]))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(key, provider)
        for batch in batches:
            for first in range(0, len(batch), size):
                ids, tensors, out = [], [], []
                for r in batch.iloc[first : first + size].itertuples():
                    try:
                        tensors.append(standardised(letterboxed(pixels(r.content, int(r.width), int(r.height)), side)))
                        ids.append(r.image_id)
                    except Exception as e:
                        out.append((r.image_id, None, None, None, None, None, said(e)))
                try:
                    found = model(np.stack(tensors)) if tensors else []
                    for i, got in zip(ids, found, strict=True):
                        out += rows_of(i, got)
                except Exception:
                    for i, t in zip(ids, tensors):
                        try:
                            out += rows_of(i, model(t[None])[0])
                        except Exception as e:
                            out.append((i, None, None, None, None, None, said(e)))
                frame = pd.DataFrame(out, columns=names)
                for c in ("det_idx", "label", "char_count"):
                    frame[c] = frame[c].astype("Int64")
                yield frame

    return images.select("image_id", "width", "height", "content").mapInPandas(run, f"image_id {kind}, {_RAW}")


def detected(images: DataFrame, provider, key: str, classes: DataFrame, side: int = DETECTOR_SIDE, size: int = 8, least: float = MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """(detections in picture coordinates, pictures that failed with their error)."""
    raw = raw_detections(images, provider, key, side, size)
    return postprocess(raw.where("error is null"), images, classes, side, least), raw.where("error is not null").select("image_id", "error")


# --- models in files --------------------------------------------------------------------------------------------
def tensor_name(names: list[str], hint: str, fallback: int = 0) -> str:
    """The tensor whose name contains ``hint``, whatever the case."""
    return next((n for n in names if hint in n.lower()), names[fallback])


def onnx_session(path: str):
    import onnxruntime as ort

    return ort.InferenceSession(path, providers=["CPUExecutionProvider"])


def line_model(session) -> Model:
    """The first input and the first output of a session."""
    name = session.get_inputs()[0].name
    return lambda tensor: session.run(None, {name: tensor})[0]


def page_model(session, side: int = DETECTOR_SIDE) -> Callable[[np.ndarray], list[dict]]:
    """A session's tensors told apart by their names: pictures and sizes in; labels, boxes, scores and counts out."""
    inputs, outputs = [i.name for i in session.get_inputs()], [o.name for o in session.get_outputs()]
    picture = tensor_name(inputs, "image")

    def run(tensor: np.ndarray) -> list[dict]:
        sizes = np.full((len(tensor), 2), side, np.int64)
        got = dict(zip(outputs, session.run(None, {n: tensor if n == picture else sizes for n in inputs})))
        named = {k: got[tensor_name(outputs, k, i)] for i, k in enumerate(("label", "box", "score"))}
        count = next((got[n] for n in outputs if "char_count" in n.lower()), None)
        if count is not None:
            named["char_count"] = count
        return [{k: np.asarray(v)[i] for k, v in named.items()} for i in range(len(tensor))]

    return run
