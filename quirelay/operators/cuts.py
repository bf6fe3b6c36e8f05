"""The XY-cut of many pages at once: the same ranks as :func:`order.xy_cut` for each page, all nodes of a depth in a few numpy calls.

A single page is too small to be worth an array operation, so pages of like size are cut together, breadth first. Pages with many lines, or without an
extent, are cut one by one.
"""

from __future__ import annotations

import math

import numpy as np

from . import order as O

#: Lines of a page up to which it is cut together with others.
MANY = 128
#: Strips across times strips along of all pages that are cut together; bounds the memory.
ROOM = 1 << 21
#: Scores of lines with leaves that are computed together.
SCORES = 1 << 18


def xy_cuts(boxes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rank of each (x0, y0, x1, y1) on its page; the first ``counts[0]`` boxes are of the first page, and so on."""
    rank = np.zeros(len(boxes), np.int64)
    first = np.cumsum(counts) - counts
    todo = []
    filled = np.flatnonzero(counts)
    if not len(filled):
        return rank
    at = first[filled]
    low, high = np.minimum.reduceat(boxes[:, :2], at), np.maximum.reduceat(np.maximum(boxes[:, 2:], boxes[:, :2]), at)
    extent = (high - low).astype(float)
    # Below 2^28 cells on a side no sum of this module leaves 32 bits.
    side = O.CELLS * np.sqrt(counts[filled])
    slim = (extent > 0).all(axis=1) & (counts[filled] <= MANY)
    slim[slim] = side[slim] * extent[slim].max(axis=1) / extent[slim].min(axis=1) < 1 << 28
    for p in filled[~slim]:
        here = slice(first[p], first[p] + counts[p])
        rank[here] = O.xy_cut(boxes[here])
    todo = filled[slim]
    todo = todo[np.argsort(counts[todo], kind="stable")]
    done = 0
    while done < len(todo):
        # Pages come by size, so the last of a chunk is its largest.
        room = ROOM // (2 * counts[todo[done:]] + 2) ** 2
        size = max(1, int((np.arange(1, len(room) + 1) <= room).sum()))
        pages = todo[done : done + size]
        done += size
        rows = np.repeat(first[pages] - (np.cumsum(counts[pages]) - counts[pages]), counts[pages]) + np.arange(counts[pages].sum())
        rank[rows] = _ranks(boxes[rows], counts[pages])
    return rank


def _grids(boxes: np.ndarray, counts: np.ndarray, first: np.ndarray, page: np.ndarray) -> np.ndarray:
    """:func:`order.grid_boxes` of every page; all pages have an extent."""
    b = boxes.astype(float)
    b[:, 2:] = np.maximum(b[:, 2:], b[:, :2])
    low, high = np.minimum.reduceat(b[:, :2], first), np.maximum.reduceat(b[:, 2:], first)
    extent = high - low
    w, h = extent[:, 0], extent[:, 1]
    side = np.array([O.CELLS * math.sqrt(n) for n in counts.tolist()])
    target = np.stack([np.where(w < h, side, side * w / h), np.where(h < w, side, side * h / w)], axis=1)
    return np.maximum(0, np.floor((b - np.tile(low, 2)[page]) * np.tile(target, 2)[page] / np.tile(extent, 2)[page])).astype(np.int64)


def _edges(low: np.ndarray, high: np.ndarray, first: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edges by page, filled up with the last one; number of strips; the strips of ``low`` and of ``high``)."""
    far = np.maximum.reduceat(high, first) + 1
    k = int(far.max()) + 1
    own = np.arange(len(first)) * k
    every = np.unique(np.concatenate([own, own + far, page * k + low, page * k + high]))
    begin = np.searchsorted(every, own)
    count = np.diff(np.append(begin, len(every)))
    column = np.minimum(np.arange(count.max()), count[:, None] - 1)
    return every[begin[:, None] + column] - own[:, None], count - 1, np.searchsorted(every, page * k + low) - begin[page], np.searchsorted(every, page * k + high) - begin[page]


def _minima(sheet: np.ndarray, at: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, o0: np.ndarray, o1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, cells, score) of the first longest run of the minimum in each window (see :func:`order.longest_minimum`).

    ``sheet`` has the covered cells of each strip up to each edge across it, so the marginal of a window from ``o0`` to ``o1`` is a difference.
    """
    _, across, along = sheet.shape
    size = hi - lo
    starts = np.cumsum(size) - size
    node = np.repeat(np.arange(len(p)), size)
    i = np.arange(len(node))
    flat, base = sheet.ravel(), p * across
    counts = flat[((base + o1) * along + lo - starts)[node] + i] - flat[((base + o0) * along + lo - starts)[node] + i]
    least, top = np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)
    low = counts == least[node]
    before, after = np.empty_like(low), np.empty_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[starts] = after[starts + size - 1] = False
    begin, end = np.flatnonzero(low & ~before), np.flatnonzero(low & ~after)
    of = node[begin]
    shift = (lo - starts)[of]
    s, e = begin + shift, end + shift + 1
    edge, row = at.ravel(), p * at.shape[1]
    cells = edge[row[of] + e] - edge[row[of] + s]
    runs = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    longest = np.maximum.reduceat(cells, runs)
    best = np.flatnonzero(cells == longest[of])
    best = best[np.concatenate([[True], of[best][1:] != of[best][:-1]])]
    plain = (edge[row + hi] - edge[row + lo] <= 1) | (top <= 0)
    return s[best], e[best], longest, np.where(plain, 0.0, -least / np.where(plain, 1, top))


class _Level:
    """Nodes of one depth: page, box (x0, y0, x1, y1) in strips, place of the parent in the level above. Children of a node are neighbours."""

    def __init__(self, page: np.ndarray, box: np.ndarray, parent: np.ndarray):
        self.page, self.box, self.parent = page, box, parent
        self.split = np.zeros(len(page), bool)

    def before(self, sizes: np.ndarray) -> np.ndarray:
        """The sum of ``sizes`` over the elder siblings of each node."""
        total = np.cumsum(sizes) - sizes
        eldest = np.concatenate([[True], self.parent[1:] != self.parent[:-1]])
        return total - total[np.flatnonzero(eldest)[np.cumsum(eldest) - 1]]


def _levels(xs: np.ndarray, ys: np.ndarray, nx: np.ndarray, ny: np.ndarray, down: np.ndarray, right: np.ndarray) -> list[_Level]:
    """The trees of all pages (see :func:`order.cut`), by depth."""
    zero = np.zeros(len(nx), np.int64)
    levels = [_Level(np.arange(len(nx)), np.stack([zero, zero, nx, ny], axis=1), zero)]
    while True:
        level = levels[-1]
        x0, y0, x1, y1 = level.box.T
        open_ = np.flatnonzero((x1 - x0 > 1) | (y1 - y0 > 1))  # a single cell of strips can't be cut
        if not len(open_):
            return levels
        p, box = level.page[open_], level.box[open_]
        x0, y0, x1, y1 = box.T
        xa, xb, xlong, xscore = _minima(down, xs, p, x0, x1, y0, y1)
        ya, yb, ylong, yscore = _minima(right, ys, p, y0, y1, x0, x1)
        along_x = (xscore < yscore) | ((xscore == yscore) & (xlong >= ylong))
        parts = np.repeat(box[:, None, :], 3, axis=1)
        for on, lo, hi, a, b in ((along_x, 0, 2, xa, xb), (~along_x, 1, 3, ya, yb)):
            parts[on, 0, hi] = parts[on, 1, lo] = a[on]
            parts[on, 1, hi] = parts[on, 2, lo] = b[on]
        whole = (xa == x0) & (xb == x1) & (ya == y0) & (yb == y1)
        kept = (parts[..., 0] < parts[..., 2]) & (parts[..., 1] < parts[..., 3]) & (parts != box[:, None, :]).any(axis=2) & ~whole[:, None]
        of = np.nonzero(kept)[0]
        if not len(of):
            return levels
        level.split[open_[of]] = True
        levels.append(_Level(p[of], parts[kept], open_[of]))


def _best_leaves(grid: np.ndarray, counts: np.ndarray, first: np.ndarray, page: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The first leaf of the highest score for each box; ``corners`` are the leaves of each page in order, filled up with -1."""
    place = np.arange(len(grid)) - first[page]
    padded = np.zeros((len(counts), int(counts.max()), 4), np.int64)
    padded[page, place] = grid
    out = np.empty(padded.shape[:2], np.int64)
    step = max(1, SCORES // (padded.shape[1] * corners.shape[1]))
    for k in range(0, len(counts), step):
        a, b = padded[k : k + step, :, None, :], corners[k : k + step, None, :, :]
        ax0, ay0, ax1, ay1 = (a[..., i] for i in range(4))
        bx0, by0, bx1, by1 = (b[..., i] for i in range(4))
        inter = np.maximum(0, np.minimum(ax1, bx1) - np.maximum(ax0, bx0) + 1) * np.maximum(0, np.minimum(ay1, by1) - np.maximum(ay0, by0) + 1)
        union = (ax1 - bx0 + 1) * (ay1 - by0 + 1) + (bx1 - ax0 + 1) * (by1 - ay0 + 1) - inter
        scores = np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)
        out[k : k + step] = np.where(bx0 < 0, -1.0, scores).argmax(axis=2)
    return out[page, place]


def _ranks(boxes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    first, page = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    grid = _grids(boxes, counts, first, page)
    (xs, nx, x0, x1), (ys, ny, y0, y1) = (_edges(grid[:, k], grid[:, k + 2], first, page) for k in (0, 1))
    shape = (len(counts), ys.shape[1], xs.shape[1])
    corner = lambda y, x: np.bincount((page * shape[1] + y) * shape[2] + x, minlength=math.prod(shape))
    steps = (corner(y0, x0) - corner(y0, x1) - corner(y1, x0) + corner(y1, x1)).astype(np.int32).reshape(shape)
    mesh = (steps.cumsum(axis=1).cumsum(axis=2) > 0)[:, :-1, :-1]
    down, right = np.zeros((shape[0], shape[1], shape[2] - 1), np.int32), np.zeros((shape[0], shape[2], shape[1] - 1), np.int32)
    np.cumsum(mesh * np.diff(ys, axis=1).astype(np.int32)[:, :, None], axis=1, out=down[:, 1:])
    np.cumsum(mesh.transpose(0, 2, 1) * np.diff(xs, axis=1).astype(np.int32)[:, :, None], axis=1, out=right[:, 1:])
    levels = _levels(xs, ys, nx, ny, down, right)

    # Leaves in order: how many each node has, then how many are before it.
    above = levels[:-1]
    leaves = [(~v.split).astype(np.int64) for v in levels]
    for k in range(len(above), 0, -1):
        leaves[k - 1] += np.bincount(levels[k].parent, leaves[k], len(leaves[k - 1])).astype(np.int64)
    place = [np.zeros(len(counts), np.int64)]
    for v, n in zip(levels[1:], leaves[1:]):
        place.append(place[-1][v.parent] + v.before(n))
    offset = np.cumsum([0, *(len(v.page) for v in levels)])
    corners, number = np.full((len(counts), int(leaves[0].max()), 4), -1, np.int64), np.zeros((len(counts), int(leaves[0].max())), np.int64)
    for v, at, start in zip(levels, place, offset):
        leaf = ~v.split
        p, box = v.page[leaf], v.box[leaf]
        corners[p, at[leaf]] = np.stack([xs[p, box[:, 0]], ys[p, box[:, 1]], xs[p, box[:, 2]], ys[p, box[:, 3]]], axis=1)
        number[p, at[leaf]] = start + np.flatnonzero(leaf)
    node = number[page, _best_leaves(grid, counts, first, page, corners)]

    # Lines and tall lines below each node, children before parents; then the lines before each node, parents before children.
    tall = grid[:, 2] - grid[:, 0] < grid[:, 3] - grid[:, 1]
    split = lambda values: np.split(values, offset[1:-1])
    n, high = split(np.bincount(node, minlength=offset[-1])), split(np.bincount(node[tall], minlength=offset[-1]))
    for k in range(len(above), 0, -1):
        for below in (n, high):
            below[k - 1] = below[k - 1] + np.bincount(levels[k].parent, below[k], len(below[k - 1])).astype(np.int64)
    start = [np.zeros(len(counts), np.int64)]
    for k, v in enumerate(levels[1:], 1):
        up = levels[k - 1]
        apart = (v.box[:, 1] != up.box[v.parent, 1]) | (v.box[:, 3] != up.box[v.parent, 3])
        # Children side by side (all of the node's height) are columns; vertical writing runs from the right.
        turned = (n[k - 1] < 2 * high[k - 1]) & (np.bincount(v.parent[apart], minlength=len(up.page)) == 0)
        elder = v.before(n[k])
        start.append(start[-1][v.parent] + np.where(turned[v.parent], n[k - 1][v.parent] - elder - n[k], elder))
    n, high, start = np.concatenate(n), np.concatenate(high), np.concatenate(start)
    vertical = (n < 2 * high)[node]
    lines = np.lexsort((np.where(vertical, grid[:, 1], grid[:, 0]), np.where(vertical, -grid[:, 0], grid[:, 1]), start[node], page))
    rank = np.empty(len(grid), np.int64)
    rank[lines] = np.arange(len(grid)) - first[page]
    return rank
