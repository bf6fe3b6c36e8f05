"""Reading order of one page: XY-cut, tolerance sort, duplicate removal, warichu groups, smoothing.

These are sequential folds over one page, so a page is one row of lists; pages spread over
the cluster, many to a batch. Inside a page everything is numpy or short Python. Functions here take and return plain
Python values; ``page_order`` and the others at the end apply them to DataFrames.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cmp_to_key

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

NOTE = "割注"
#: Fixed value: cells of the grid along the short side of a page of one box.
CELLS = 100
#: Strips of a window up to which lists are used.
SHORT = 200


# --- XY-cut ---------------------------------------------------------------------------------------------------
def grid_boxes(boxes: np.ndarray) -> np.ndarray:
    """Boxes on a grid of about CELLS sqrt(n) cells along the page's short side."""
    b = boxes.astype(float).copy()
    b[:, 2] = np.where(b[:, 0] >= b[:, 2], b[:, 0], b[:, 2])
    b[:, 3] = np.where(b[:, 1] >= b[:, 3], b[:, 1], b[:, 3])
    low, high = b[:, :2].min(axis=0), b[:, 2:].max(axis=0)
    extent = high - low
    if (extent <= 0).any():
        return b.astype(np.int64)
    side = CELLS * math.sqrt(len(b))
    w, h = extent
    target = np.array([side if w < h else side * w / h, side if h < w else side * h / w])
    return np.maximum(0, np.floor((b - np.tile(low, 2)) * np.tile(target, 2) / np.tile(extent, 2))).astype(np.int64)


def longest_minimum(counts: np.ndarray, widths: np.ndarray | None = None) -> tuple[int, int, float]:
    """(start, end, score) of the first longest run of the minimum; the score is -min / max, 0 without a maximum.

    ``counts`` may stand for strips of ``widths`` cells each; starts and ends are then numbers of strips.
    """
    if (len(counts) if widths is None else widths.sum()) <= 1:
        return 0, 1, 0.0
    low = counts == counts.min()
    edges = np.flatnonzero(np.diff(np.concatenate(([False], low, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    at = np.arange(len(counts) + 1) if widths is None else np.concatenate(([0], np.cumsum(widths)))
    k = int(np.argmax(at[ends] - at[starts]))
    top = counts.max()
    return int(starts[k]), int(ends[k]), float(-counts.min() / top) if top > 0 else 0.0


def _short_minimum(counts: list[int], at: list[int]) -> tuple[int, int, float]:
    """:func:`longest_minimum` for few strips with edges ``at``, for which lists are faster."""
    if at[-1] - at[0] <= 1:
        return 0, 1, 0.0
    low, top, best, i = min(counts), max(counts), (0, 0, 0), 0
    for j, c in enumerate(counts):
        if c != low:
            i = j + 1
        elif at[j + 1] - at[i] > best[0]:
            best = (at[j + 1] - at[i], i, j + 1)
    return best[1], best[2], -low / top if top > 0 else 0.0


class Node:
    __slots__ = ("box", "children", "lines", "n", "tall")

    def __init__(self, box: tuple[int, int, int, int]):
        self.box, self.children, self.lines, self.n, self.tall = box, [], [], 0, 0


def strips(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x edges, y edges, mesh): the grid cut at the boxes' edges into strips within which all cells are alike; the mesh says which are covered."""
    xs, ys = (np.unique(np.concatenate([[0, grid[:, k + 2].max() + 1], grid[:, k], grid[:, k + 2]])) for k in (0, 1))
    mesh = np.zeros((len(ys) - 1, len(xs) - 1), bool)
    x0, y0, x1, y1 = (np.searchsorted(e, grid[:, k]) for e, k in ((xs, 0), (ys, 1), (xs, 2), (ys, 3)))
    for a, b, c, d in zip(y0, y1, x0, x1):
        mesh[a:b, c:d] = True
    return xs, ys, mesh


def cut(xs: np.ndarray, ys: np.ndarray, mesh: np.ndarray) -> Node:
    """Cut at the emptiest run of the two marginals until neither can be cut; no recursion on the stack. Boxes are in strips."""
    widths, heights = np.diff(xs), np.diff(ys)
    # Covered cells above and left of each strip, so that the marginals of any window are differences.
    down = np.concatenate([np.zeros((1, len(widths)), np.int64), np.cumsum(mesh * heights[:, None], axis=0)])
    right = np.concatenate([np.zeros((len(heights), 1), np.int64), np.cumsum(mesh * widths[None, :], axis=1)], axis=1)
    columns, rows = down.T.copy(), right.copy()
    x_at, y_at = xs.tolist(), ys.tolist()
    root = Node((0, 0, len(widths), len(heights)))
    todo = [root]
    while todo:
        node = todo.pop()
        x0, y0, x1, y1 = node.box
        covered = (columns[x0:x1, y1] - columns[x0:x1, y0], rows[y0:y1, x1] - rows[y0:y1, x0])
        (xa, xb, xscore), (ya, yb, yscore) = (
            _short_minimum(c.tolist(), at[a : b + 1]) if b - a <= SHORT else longest_minimum(c, w[a:b]) for c, at, w, a, b in ((covered[0], x_at, widths, x0, x1), (covered[1], y_at, heights, y0, y1))
        )
        if (xa, xb) == (0, x1 - x0) and (ya, yb) == (0, y1 - y0):
            continue
        along_x = xscore < yscore or (xscore == yscore and x_at[x0 + xb] - x_at[x0 + xa] >= y_at[y0 + yb] - y_at[y0 + ya])
        if along_x:
            parts = [(x0, y0, x0 + xa, y1), (x0 + xa, y0, x0 + xb, y1), (x0 + xb, y0, x1, y1)]
        else:
            parts = [(x0, y0, x1, y0 + ya), (x0, y0 + ya, x1, y0 + yb), (x0, y0 + yb, x1, y1)]
        node.children = [Node(p) for p in parts if p[0] < p[2] and p[1] < p[3] and p != node.box]
        todo += node.children
    return root


def leaves(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.children:
            todo += node.children[::-1]
        else:
            out.append(node)
    return out


def leaf_scores(boxes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The leaf-assignment score of every box with every leaf (see ``functions.geometry.mixed_iou``)."""
    a, b = boxes[:, None, :], cells[None, :, :]
    inter = np.maximum(0, np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]) + 1) * np.maximum(0, np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]) + 1)
    union = (a[..., 2] - b[..., 0] + 1) * (a[..., 3] - b[..., 1] + 1) + (b[..., 2] - a[..., 0] + 1) * (b[..., 3] - a[..., 1] + 1) - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def xy_cut(boxes: list[tuple[int, int, int, int]]) -> list[int]:
    """Rank of each (x0, y0, x1, y1) in reading order: a permutation of 0..n-1."""
    if not len(boxes):
        return []
    grid = grid_boxes(np.asarray(boxes, dtype=np.int64).reshape(-1, 4))
    xs, ys, mesh = strips(grid)
    root = cut(xs, ys, mesh)
    cells = leaves(root)
    corners = np.array([(xs[c.box[0]], ys[c.box[1]], xs[c.box[2]], ys[c.box[3]]) for c in cells])
    for first in range(0, len(grid), 256):  # blocks bound the memory
        part = leaf_scores(grid[first : first + 256], corners).argmax(axis=1)
        for k, leaf in enumerate(part):
            cells[leaf].lines.append(first + k)
    # Orientation counts from the leaves upwards, children before parents.
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    for node in reversed(order):
        if node.children:
            node.n, node.tall = sum(c.n for c in node.children), sum(c.tall for c in node.children)
        else:
            sides = grid[node.lines, 2:] - grid[node.lines, :2]
            node.n, node.tall = len(node.lines), int((sides[:, 0] < sides[:, 1]).sum()) if node.lines else 0
        vertical = node.n < 2 * node.tall
        if node.children:
            # Children side by side (all of the node's height) are columns; vertical writing runs from the right.
            if vertical and all(c.box[1] == node.box[1] and c.box[3] == node.box[3] for c in node.children):
                node.children.reverse()
        elif vertical:
            node.lines.sort(key=lambda i: (-grid[i, 0], grid[i, 1]))
        else:
            node.lines.sort(key=lambda i: (grid[i, 1], grid[i, 0]))
    rank = [0] * len(boxes)
    at = 0
    for leaf in leaves(root):
        for i in leaf.lines:
            rank[i] = at
            at += 1
    return rank


# --- sorting and duplicates -----------------------------------------------------------------------------------
def upper_median(values: list[float]) -> float:
    return sorted(values)[len(values) // 2]


def tolerance_sort(lines: list[dict]) -> list[dict]:
    """Lines of one block: by centre across the writing direction with a dead band of 0.3 median spans, then along it."""
    if not lines:
        return []
    vertical = len(lines) < 2 * sum(x["w"] < x["h"] for x in lines)
    band = 0.3 * upper_median([x["w"] if vertical else x["h"] for x in lines])

    def compare(a: dict, b: dict) -> float:
        dx = (a["x"] + a["w"] / 2) - (b["x"] + b["w"] / 2)
        dy = (a["y"] + a["h"] / 2) - (b["y"] + b["h"] / 2)
        if vertical:
            return -dx if abs(dx) > band else dy
        return dy if abs(dy) > band else dx

    return sorted(lines, key=cmp_to_key(compare))


def same_place(a: dict, b: dict, least: float = 0.8) -> bool:
    w = max(0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
    h = max(0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
    small = min(a["w"] * a["h"], b["w"] * b["h"])
    return small > 0 and w * h / small > least


def without_duplicates(items: list[dict]) -> list[dict]:
    """Compare each item with the last one kept; on the same place the higher confidence stays, the earlier one on ties.

    Items with ``kind`` other than 'line' or 'group' pass; a missing confidence counts as -1.
    """
    kept: list[dict] = []
    conf = lambda x: -1.0 if x.get("conf") is None else x["conf"]
    for item in items:
        plain = {"line", "group"}
        if kept and item.get("kind", "line") in plain and kept[-1].get("kind", "line") in plain and same_place(kept[-1], item):
            if conf(kept[-1]) < conf(item):
                kept[-1] = item
        else:
            kept.append(item)
    return kept


# --- warichu --------------------------------------------------------------------------------------------------
def widened(line: dict) -> tuple[float, float, float, float]:
    x, y, w, h = line["x"], line["y"], line["w"], line["h"]
    dx, dy = (w * 0.1 / 2, 0.0) if w < h else (0.0, h * 0.1 / 2)
    return x - dx, y - dy, x + w + dx, y + h + dy


def note_groups(lines: list[dict]) -> list[list[int]]:
    """Each line not yet grouped takes every later ungrouped one that overlaps it (the seed, not the group)."""
    boxes = [widened(x) for x in lines]
    free = list(range(len(lines)))
    out = []
    while free:
        seed, rest = free[0], free[1:]
        a = boxes[seed]
        hit = [j for j in rest if min(a[2], boxes[j][2]) > max(a[0], boxes[j][0]) and min(a[3], boxes[j][3]) > max(a[1], boxes[j][1])]
        out.append([seed, *hit])
        free = [j for j in rest if j not in set(hit)]
    return out


def group_box(lines: list[dict]) -> dict:
    x, y = min(v["x"] for v in lines), min(v["y"] for v in lines)
    return {"x": x, "y": y, "w": max(v["x"] + v["w"] for v in lines) - x, "h": max(v["y"] + v["h"] for v in lines) - y}


def with_note_groups(nodes: list[dict]) -> list[dict]:
    """``nodes`` (lines, and blocks and containers with 'children') with overlapping notes of the whole page put into 'group' nodes.

    The group stands before its first member inside a text block, else before its first member.
    """
    notes = [(n, c) for n in nodes for c in (n["children"] if "children" in n else [n]) if c.get("type") == NOTE]
    if not notes:
        return nodes
    moved: set[int] = set()
    before: dict[int, dict] = {}
    for members in note_groups([c for _, c in notes]):
        found = [notes[m] for m in members]
        anchor = next((c for n, c in found if n["kind"] == "block"), found[0][1])
        lines = [c for _, c in found]
        before[id(anchor)] = {"kind": "group", **group_box(lines), "conf": None, "order": upper_median([x["order"] for x in lines]), "children": lines}
        moved |= {id(x) for x in lines}

    def rebuilt(items: list[dict]) -> list[dict]:
        out = []
        for n in items:
            if id(n) in before:
                out.append(before[id(n)])
            if id(n) not in moved:
                out.append({**n, "children": rebuilt(n["children"])} if "children" in n else n)
        return out

    return rebuilt(nodes)


# --- page -----------------------------------------------------------------------------------------------------
def block_key(lines: list[dict]) -> float:
    return upper_median([x["order"] for x in lines]) if lines else -1


def sort_page(nodes: list[dict], smooth: bool = False, diagonal: float = 1.0) -> list[dict]:
    """Lines of a page in reading order.

    ``nodes`` are dicts of kind 'line' or 'block' (a text block with 'children') with x, y, w, h, conf, order,
    or of kind 'container' (a table, an advertisement, a figure, with 'children'); containers come last. Notes are grouped
    over the whole page while it is sorted; smoothing sees their single lines again.
    """
    done = dissolved(_sorted_level(with_note_groups(nodes)))
    return [x for n in (_smoothed_level(done, diagonal) if smooth else done) for x in flattened(n)]


def _sorted_level(nodes: list[dict]) -> list[dict]:
    """Lines, groups and text blocks by their order without duplicates, then the containers, each sorted inside."""

    def inside(n: dict) -> dict:
        return {**n, "children": without_duplicates(tolerance_sort(n["children"]))} if n["kind"] == "group" else n

    keyed = []
    for n in nodes:
        if n["kind"] == "block":
            children = [inside(c) for c in n["children"]]
            keyed.append((block_key(children), {**n, "children": without_duplicates(tolerance_sort(children))}))
        elif n["kind"] != "container":
            keyed.append((n["order"], inside(n)))
    containers = [{**n, "children": _sorted_level(n["children"])} for n in nodes if n["kind"] == "container"]
    return without_duplicates([n for _, n in sorted(keyed, key=lambda t: t[0])]) + containers


def dissolved(nodes: list[dict]) -> list[dict]:
    """Groups replaced by their lines, at every level."""
    out = []
    for n in nodes:
        inner = dissolved(n["children"]) if "children" in n else None
        out += inner if n["kind"] == "group" else [n if inner is None else {**n, "children": inner}]
    return out


def _smoothed_level(nodes: list[dict], diagonal: float) -> list[dict]:
    containers = [{**n, "children": _smoothed_level(n["children"], diagonal)} for n in nodes if n["kind"] == "container"]
    return smoothed([n for n in nodes if n["kind"] != "container"], diagonal) + containers


def flattened(node: dict) -> list[dict]:
    return [node] if node["kind"] == "line" else [x for c in node["children"] for x in flattened(c)]


# --- smoothing ------------------------------------------------------------------------------------------------
def cheapest_path(n: int, weight: Callable[[int, int], float]) -> list[int] | None:
    """The cheapest way from 0 to n-1 through every node, with steps of one or two positions; the one that steps on by one where equal ways part.

    From twenty nodes on steps are of one position, so the only way is the given order. A node that is passed over can be
    left again only towards the node after its successor, so a way consists of single steps on and of leaps: two on, one back, two on.
    """
    if n <= 2 or n >= 20:
        return list(range(n))
    on = [weight(i, i + 1) for i in range(n - 1)]
    leap = [(weight(i, i + 2), weight(i + 2, i + 1), weight(i + 1, i + 3)) for i in range(n - 3)]
    # (cost, starts of leaps) of the cheapest way to each node through all before it; costs are added up in the order of the way.
    best: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for i in range(1, n):
        cost, leaps = best[i - 1]
        cost += on[i - 1]
        if i >= 3:
            other = best[i - 3][0]
            for w in leap[i - 3]:
                other += w
            if abs(other - cost) <= 1e-12 * (abs(other) + abs(cost)):
                return _first_cheapest(n, on, leap)  # the rounding of later sums may decide
            if other < cost:
                cost, leaps = other, (*best[i - 3][1], i - 3)
        best.append((cost, leaps))
    return _way(n, best[-1][1])


def _way(n: int, leaps: tuple[int, ...]) -> list[int]:
    path = list(range(n))
    for i in leaps:
        path[i + 1], path[i + 2] = i + 2, i + 1
    return path


def _first_cheapest(n: int, on: list[float], leap: list[tuple[float, float, float]]) -> list[int] | None:
    """:func:`cheapest_path` among all ways, at most 595; the first of the cheapest, single steps before leaps."""
    best: tuple[float, tuple[int, ...] | None] = (math.inf, None)
    todo: list[tuple[float, int, tuple[int, ...]]] = [(0.0, 0, ())]
    while todo:
        cost, i, leaps = todo.pop()
        if cost >= best[0]:
            continue
        if i == n - 1:
            best = (cost, leaps)
            continue
        if i + 3 < n:
            other = cost
            for w in leap[i]:
                other += w
            todo.append((other, i + 3, (*leaps, i)))
        todo.append((cost + on[i], i + 1, leaps))
    return None if best[1] is None else _way(n, best[1])


def smoothed(nodes: list[dict], diagonal: float) -> list[dict]:
    """Reorder neighbours where the way through the page gets shorter; nodes without lines keep their place."""
    place, ends = [], []
    for k, n in enumerate(nodes):
        lines = flattened(n)
        if lines:
            first, last = lines[0], lines[-1]
            order = lines[len(lines) // 2]["order"]
            place.append(k)
            ends.append(((first["x"] + first["w"] / 2, first["y"]), (last["x"] + last["w"] / 2, last["y"] + last["h"]), order))
    if not ends:
        return nodes
    spread = max(e[2] for e in ends) - min(e[2] for e in ends)
    if spread <= 0:
        return nodes
    path = cheapest_path(len(ends), lambda i, j: math.dist(ends[i][1], ends[j][0]) / diagonal + abs(ends[i][2] - ends[j][2]) / spread)
    if path is None:
        return nodes
    out = list(nodes)
    for slot, i in zip(place, path):
        out[slot] = nodes[place[i]]
    return out


# --- DataFrames -----------------------------------------------------------------------------------------------
def _by_page(df: DataFrame, f: Callable[..., list], out: str, columns: list[str]) -> DataFrame:
    """``out`` for each row: ``f`` gets the lists of ``columns`` of one page, in ``det_idx`` order, and gives a list of whole numbers or None.

    A page is one row of lists, so a batch of Python's holds many pages; they are taken apart in the JVM.
    """
    ship(df.sparkSession)

    @F.pandas_udf("array<int>")
    def run(lists: pd.DataFrame) -> pd.Series:
        return pd.Series([f(*(c.tolist() if hasattr(c, "tolist") else list(c) for c in row)) for row in lists.itertuples(index=False, name=None)])

    pages = df.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("det_idx", *[c for c in df.columns if c not in ("page_id", "det_idx")]))).alias("rows"))
    numbered = pages.select("page_id", "rows", run(F.struct(*[F.col("rows")[c].alias(c) for c in columns])).alias("numbers"))
    each = numbered.select("page_id", F.inline(F.arrays_zip("rows", "numbers")))
    return each.select("page_id", *[F.col("rows")[c].alias(c) for c in df.columns if c != "page_id"], F.col("numbers").alias(out)).select(*df.columns, out)


def page_order(lines: DataFrame) -> DataFrame:
    """``ord`` for each line (page_id, det_idx, x1, y1, w, h) by XY-cut."""
    return _by_page(lines, lambda x, y, w, h: xy_cut([(a, b, a + c, b + d) for a, b, c, d in zip(x, y, w, h)]), "ord", ["x1", "y1", "w", "h"])


def _as_lines(class_idx: list, x: list, y: list, w: list, h: list, conf: list) -> list[dict]:
    return [{"kind": "line", "i": i, "x": v[1], "y": v[2], "w": v[3], "h": v[4], "conf": v[5], "type": NOTE if v[0] == 4 else "", "order": 0} for i, v in enumerate(zip(class_idx, x, y, w, h, conf))]


_LINE = ["class_idx", "x1", "y1", "w", "h", "conf"]


def _positions(f: Callable[[list[dict]], list[dict]], lines: DataFrame) -> DataFrame:
    """``line_pos`` of the lines that ``f`` keeps."""

    def one(*columns: list) -> list:
        place: list = [None] * len(columns[0])
        for k, x in enumerate(f(_as_lines(*columns))):
            place[x["i"]] = k
        return place

    return _by_page(lines, one, "line_pos", _LINE).where(F.col("line_pos").isNotNull())


def tolerance_sorted(lines: DataFrame) -> DataFrame:
    return _positions(tolerance_sort, lines)


def deduplicated(lines: DataFrame) -> DataFrame:
    return _positions(lambda x: without_duplicates(tolerance_sort(x)), lines)


def grouped_notes(lines: DataFrame) -> DataFrame:
    """``note_group`` for each line of class 4."""

    def one(*columns: list) -> list:
        number = [0] * len(columns[0])
        for k, members in enumerate(note_groups(_as_lines(*columns))):
            for m in members:
                number[m] = k
        return number

    return _by_page(lines.where(F.col("class_idx") == 4), one, "note_group", _LINE)
