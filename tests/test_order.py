"""Page operators in plain Python: fixed relations, invariants, and brute force."""

import functools
import math
import random
from decimal import ROUND_HALF_UP, Decimal
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from quirelay.functions.text import fixed3_text
from quirelay.operators import blocks as B
from quirelay.operators import order as O


def line(x, y, w, h, conf=0.9, kind="", order=0):
    return {"kind": "line", "x": x, "y": y, "w": w, "h": h, "conf": conf, "type": kind, "order": order}


def test_stacked_and_columns():
    r = O.xy_cut([(10, 100, 200, 130), (10, 10, 200, 40), (10, 200, 200, 230)])
    assert r[1] < r[0] < r[2]
    r = O.xy_cut([(100, 10, 130, 300), (200, 10, 230, 300), (10, 10, 40, 300)])
    assert r[1] < r[0] < r[2]  # tall columns run from the right
    assert O.xy_cut([(10, 10, 200, 30), (10, 50, 200, 70), (300, 10, 500, 30), (300, 50, 500, 70)]) == [0, 1, 2, 3]


def test_ranks_are_permutations():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randint(0, 20)
        boxes = [(x := rng.randint(0, 500), y := rng.randint(0, 500), x + rng.randint(-2, 200), y + rng.randint(-2, 80)) for _ in range(n)]
        assert sorted(O.xy_cut(boxes)) == list(range(n))


def test_minimum_run():
    assert O.longest_minimum(np.array([1, 0, 0, 2, 0])) == (1, 3, 0.0)
    assert O.longest_minimum(np.array([2, 1, 1, 2])) == (1, 3, -0.5)
    assert O.longest_minimum(np.array([5])) == (0, 1, 0.0) and O.longest_minimum(np.array([0, 0])) == (0, 2, 0.0)


def test_duplicates():
    assert len(O.without_duplicates([line(10, 10, 200, 30, 0.9), line(12, 11, 198, 29, 0.5)])) == 1
    assert O.without_duplicates([line(10, 10, 200, 30, 0.5), line(12, 11, 198, 29, 0.9)])[0]["conf"] == 0.9
    assert len(O.without_duplicates([line(0, 0, 0, 10), line(0, 0, 0, 10)])) == 2


def test_notes():
    got = O.with_note_groups([line(100, 10, 50, 20, 0.8, O.NOTE), line(100, 25, 50, 20, 0.8, O.NOTE)])
    assert [(g["kind"], g["x"], g["y"], g["w"], g["h"]) for g in got] == [("group", 100, 10, 50, 35)]
    assert len(O.with_note_groups([line(10, 10, 50, 20, 0.8, O.NOTE), line(500, 500, 50, 20, 0.8, O.NOTE)])) == 2
    assert O.note_groups([line(0, 0, 10, 10), line(8, 0, 10, 10), line(16, 0, 10, 10)]) == [[0, 1], [2]]  # the seed alone absorbs


def test_page_keeps_lines():
    rng = random.Random(3)
    for _ in range(20):
        lines = [line(60 * k, rng.randint(0, 900), 50, 20, 0.9, rng.choice(["", O.NOTE]), k) for k in range(rng.randint(1, 12))]
        nodes = [*lines[::2], {"kind": "block", **O.group_box(lines[1::2]), "children": lines[1::2]}] if len(lines) > 1 else lines
        for smooth in (False, True):
            assert sorted(id(x) for x in O.sort_page(nodes, smooth, 1000.0)) == sorted(map(id, lines))


@pytest.mark.parametrize("n", [3, 4, 6])
def test_path_by_brute_force(n):
    rng = random.Random(n)
    for _ in range(20):
        w = {(i, j): rng.random() for i in range(n) for j in range(n)}
        every = [(0, *p, n - 1) for p in permutations(range(1, n - 1)) if all(abs(a - b) <= 2 for a, b in zip((0, *p), (*p, n - 1)))]
        best = min(sum(w[a, b] for a, b in zip(p, p[1:])) for p in every)
        got = O.cheapest_path(n, lambda i, j: w[i, j])
        assert math.isclose(sum(w[a, b] for a, b in zip(got, got[1:])), best)
    assert O.cheapest_path(25, lambda i, j: 1.0) == list(range(25))


def plainly_merged(blocks: list[dict], reach: int = 50) -> list[dict]:
    out = [{**b, "members": list(b["members"])} for b in blocks]

    def near(c: dict, p: dict) -> bool:
        for x in (c["x1"], c["x2"]):
            for y in (c["y1"], c["y2"]):
                dx, dy = max(p["x1"] - x, 0, x - p["x2"]), max(p["y1"] - y, 0, y - p["y2"])
                if dx * dx + dy * dy > reach * reach:
                    return False
        return True

    for c in out:
        for p in out:
            if p is not c and p["members"] is not None and near(c, p):
                p["members"] += c["members"] or [(0, c["i"])]
                c["members"] = None
                break
    for b in out:
        if b["members"] and all(k == 0 for k, _ in b["members"]):
            b["members"] = []
    return out


def merged(spark, blocks):
    rows = [(b["i"], float(b["x1"]), float(b["y1"]), float(b["x2"]), float(b["y2"]), True, [tuple(m) for m in b["members"]]) for b in blocks]
    df = spark.createDataFrame([(rows,)], "b array<struct<det_idx:long,x1:double,y1:double,x2:double,y2:double,alive:boolean,members:array<struct<class_idx:long,det_idx:long>>>>")
    return [[tuple(m) for m in b["members"]] if b["alive"] else None for b in df.select(B.merge_blocks(F.col("b")).alias("b")).first()["b"]]


def test_merging_blocks(spark):
    box = lambda i, x1, y1, x2, y2, m=(): {"i": i, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "members": list(m)}
    assert merged(spark, [box(0, 0, 0, 500, 500, [(1, 7)]), box(1, 10, 10, 100, 100, [(1, 8)]), box(2, 20, 20, 90, 90)]) == [[(1, 7), (1, 8), (0, 2)], None, None]
    assert merged(spark, [box(0, 0, 0, 500, 500), box(1, 10, 10, 100, 100)]) == [[(0, 1)], None]
    rng = random.Random(4)
    for n in (1, 2, 5, 12):
        blocks = [box(i, x := rng.randrange(300), y := rng.randrange(300), x + rng.randrange(1, 200), y + rng.randrange(1, 200), [(1, 100 + i)] if rng.random() < 0.5 else []) for i in range(n)]
        got = merged(spark, blocks)
        wanted = [b["members"] for b in plainly_merged(blocks)]
        assert [None if m is None else [] if all(k == 0 for k, _ in m) else m for m in got] == wanted


def test_xml(spark):
    none = F.array().cast("array<string>")
    inner = B.element_xml(F.lit("D"), F.lit(""), none, 1)
    values = [0.8125, 1.0005, 0.9, 0.0, -0.0625, 999999.9995, *[k / 2000 for k in range(1, 400, 2)], *[random.Random(5).random() for _ in range(50)]]
    row = spark.range(1).select(B.element_xml(F.lit("A"), B.attributes({"b": F.lit('x"<'), "c": F.lit(None), "d": F.lit("\"'&")}), F.array(inner)).alias("xml")).first()
    assert row["xml"] == "<A b='x\"&lt;' d=\"&quot;'&amp;\">\n  <D></D>\n</A>"
    got = [r["t"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", fixed3_text(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got[:3] == ["0.813", "1.000", "0.900"]
    assert got == [str(Decimal(v).quantize(Decimal("0.001"), ROUND_HALF_UP)) for v in values]


class Element:
    """A page tree for a sort written apart from the operators: recursive, in place, over parents and children."""

    def __init__(self, tag, children=(), **attrs):
        self.tag, self.children, self.a = tag, list(children), attrs


def every_line(e):
    return [x for c in e.children for x in ([c] if c.tag == "LINE" else every_line(c))]


def parent_of(e, x):
    if any(c is x for c in e.children):
        return e
    return next((p for p in (parent_of(c, x) for c in e.children) if p), None)


def grow(x):
    a = x.a
    d = 0.1 * min(a["w"], a["h"]) / 2
    return (a["x"] - d, a["y"], a["x"] + a["w"] + d, a["y"] + a["h"]) if a["w"] < a["h"] else (a["x"], a["y"] - d, a["x"] + a["w"], a["y"] + a["h"] + d)


def overlap(p, q):
    return max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))


def put_notes_together(page):
    notes = [(x, parent_of(page, x)) for x in every_line(page) if x.a["type"] == O.NOTE]
    while notes:
        group = [n for n in notes if n is notes[0] or overlap(grow(notes[0][0]), grow(n[0])) > 0]
        notes = [n for n in notes if not any(n is g for g in group)]
        xs = [x for x, _ in group]
        x0, y0 = min(x.a["x"] for x in xs), min(x.a["y"] for x in xs)
        box = Element("GROUP", xs, x=x0, y=y0, w=max(x.a["x"] + x.a["w"] for x in xs) - x0, h=max(x.a["y"] + x.a["h"] for x in xs) - y0, conf=-1, order=sorted(x.a["order"] for x in xs)[len(xs) // 2])
        at, home = next((g for g in group if g[1].tag == "TEXTBLOCK"), group[0])
        home.children.insert(next(i for i, c in enumerate(home.children) if c is at), box)
        for x, p in group:
            del p.children[next(i for i, c in enumerate(p.children) if c is x)]


def drop_repeated(children):
    out = []
    for c in children:
        p = out[-1] if out else None
        if p and {c.tag, p.tag} <= {"LINE", "GROUP"}:
            b = [(v.a["x"], v.a["y"], v.a["x"] + v.a["w"], v.a["y"] + v.a["h"]) for v in (p, c)]
            least = min(v.a["w"] * v.a["h"] for v in (p, c))
            if least > 0 and overlap(*b) / least > 0.8:
                if p.a["conf"] >= c.a["conf"]:
                    continue
                out.pop()
        out.append(c)
    return out


def sort_inside(e):
    """The median order of the lines; -1 without any."""
    lines = list(e.children)
    if not lines:
        return -1
    tall = sum(c.a["w"] < c.a["h"] for c in lines) * 2 > len(lines)
    band = 0.3 * sorted(c.a["w" if tall else "h"] for c in lines)[len(lines) // 2]
    middle = lambda c: (c.a["x"] + c.a["w"] / 2, c.a["y"] + c.a["h"] / 2)

    def before(p, q):
        (px, py), (qx, qy) = middle(p), middle(q)
        across, along = (qx - px, py - qy) if tall else (py - qy, px - qx)
        return across if abs(across) > band else along

    e.children = drop_repeated(sorted(lines, key=functools.cmp_to_key(before)))
    orders = sorted(c.a["order"] for c in lines)
    return orders[len(orders) // 2]


def sort_tree(e):
    keyed, rest = [], []
    for c in e.children:
        if c.tag == "BLOCK":
            sort_tree(c)
            rest.append(c)
            continue
        for g in c.children if c.tag == "TEXTBLOCK" else []:
            if g.tag == "GROUP":
                sort_inside(g)
        keyed.append((c.a["order"] if c.tag == "LINE" else sort_inside(c), c))
    e.children = drop_repeated([c for _, c in sorted(keyed, key=lambda t: t[0])]) + rest


def take_apart(e):
    for c in e.children:
        take_apart(c)
    e.children = [x for c in e.children for x in (c.children if c.tag == "GROUP" else [c])]


def smooth_tree(e, diagonal):
    nodes, empty, rest = [], [], []
    for c in e.children:
        if c.tag == "BLOCK":
            smooth_tree(c, diagonal)
            rest.append(c)
        elif c.tag == "LINE" or c.children:
            xs = [c] if c.tag == "LINE" else c.children
            nodes.append((xs[len(xs) // 2].a["order"], (xs[0].a["x"] + xs[0].a["w"] / 2, xs[0].a["y"]), (xs[-1].a["x"] + xs[-1].a["w"] / 2, xs[-1].a["y"] + xs[-1].a["h"]), c))
    n = len(nodes)
    spread = max((v[0] for v in nodes), default=0) - min((v[0] for v in nodes), default=0)
    if spread <= 0:
        return
    best = [math.inf, None]

    def walk(path, cost):
        if cost >= best[0]:
            return
        if len(path) == n:
            if path[-1] == n - 1:
                best[:] = [cost, path]
            return
        i = path[-1]
        for j in [i - 1, i + 1] + ([i - 2, i + 2] if n < 20 else []):
            if 0 <= j < n and j not in path:
                walk([*path, j], cost + (math.dist(nodes[i][2], nodes[j][1]) / diagonal + abs(nodes[i][0] - nodes[j][0]) / spread))

    walk([0], 0.0)
    if best[1]:
        e.children = [nodes[i][3] for i in best[1]] + empty + rest


def test_pages_against_a_tree_sorted_apart():
    """Notes that span text blocks, containers and the page; duplicates; blocks without lines; with and without smoothing."""
    rng = random.Random(11)
    crossed = 0
    for _ in range(2000):
        number = iter(range(10**6))
        size = rng.choice([120, 300, 900])
        # Unequal numbers for orders keep equal ways rare; their ties are decided alike all the same.
        fresh = lambda: {"i": next(number), "x": rng.randrange(size), "y": rng.randrange(size), **dict(zip("wh", rng.choice([(50, 20), (20, 60), (30, 31)]))), "conf": rng.choice([None, 0.5, 0.9]), "type": rng.choice(["", O.NOTE]), "order": rng.randrange(30)}
        plan = [(rng.choice(["line", "line", "block", "container"]), [fresh() for _ in range(rng.choice([0, 1, 2, 5]))], fresh()) for _ in range(rng.choice([1, 4, 9, 26]))]
        nodes = [{"kind": "line", **own} if kind == "line" else {"kind": kind, **{k: own[k] for k in "xywh"}, "children": [{"kind": "line", **c} for c in inner]} for kind, inner, own in plan]
        made = lambda v: Element("LINE", **{**v, "conf": -1 if v["conf"] is None else v["conf"]})
        page = Element("PAGE", [made(own) if kind == "line" else Element({"block": "TEXTBLOCK", "container": "BLOCK"}[kind], map(made, inner)) for kind, inner, own in plan])
        smooth, diagonal = rng.random() < 0.7, math.hypot(size, size)
        parents = {id(x): parent_of(page, x) for x in every_line(page)}
        put_notes_together(page)
        crossed += any(len({id(parents[id(x)]) for x in g.children}) > 1 for b in [page, *page.children] for g in b.children if g.tag == "GROUP")
        sort_tree(page)
        take_apart(page)
        if smooth:
            smooth_tree(page, diagonal)
        assert [x["i"] for x in O.sort_page(nodes, smooth, diagonal)] == [x.a["i"] for x in every_line(page)]
    assert crossed > 200


def plainly_cut(boxes):
    """Ranks by recursion over a mesh of single cells, written apart."""
    grid = [list(map(int, b)) for b in O.grid_boxes(np.asarray(boxes, dtype=np.int64).reshape(-1, 4))]
    width, height = max(b[2] for b in grid) + 1, max(b[3] for b in grid) + 1
    mesh = [[any(x0 <= x < x1 and y0 <= y < y1 for x0, y0, x1, y1 in grid) for x in range(width)] for y in range(height)]

    def emptiest(counts):
        if len(counts) <= 1:
            return 0, 1, 0.0
        low, runs, i = min(counts), [], 0
        while i < len(counts):
            j = i
            while j < len(counts) and counts[j] == low:
                j += 1
            if j > i:
                runs.append((i, j))
            i = max(j, i + 1)
        a, b = max(runs, key=lambda r: (r[1] - r[0], -r[0]))
        return a, b, -low / max(counts) if max(counts) > 0 else 0.0

    found = []

    def go(x0, y0, x1, y1):
        """The tree as ((box), children)."""
        xa, xb, xs = emptiest([sum(mesh[y][x] for y in range(y0, y1)) for x in range(x0, x1)])
        ya, yb, ys = emptiest([sum(mesh[y][x] for x in range(x0, x1)) for y in range(y0, y1)])
        if (xa, xb, ya, yb) == (0, x1 - x0, 0, y1 - y0):
            leaf = ((x0, y0, x1, y1), [], [])
            found.append(leaf)
            return leaf
        if xs < ys or (xs == ys and xb - xa >= yb - ya):
            parts = [(x0, y0, x0 + xa, y1), (x0 + xa, y0, x0 + xb, y1), (x0 + xb, y0, x1, y1)]
        else:
            parts = [(x0, y0, x1, y0 + ya), (x0, y0 + ya, x1, y0 + yb), (x0, y0 + yb, x1, y1)]
        parts = [p for p in parts if p[0] < p[2] and p[1] < p[3] and p != (x0, y0, x1, y1)]
        if not parts:
            leaf = ((x0, y0, x1, y1), [], [])
            found.append(leaf)
            return leaf
        return ((x0, y0, x1, y1), [go(*p) for p in parts], None)

    tree = go(0, 0, width, height)
    for k, a in enumerate(grid):
        def score(b):
            inter = max(0, min(a[2], b[2]) - max(a[0], b[0]) + 1) * max(0, min(a[3], b[3]) - max(a[1], b[1]) + 1)
            union = (a[2] - b[0] + 1) * (a[3] - b[1] + 1) + (b[2] - a[0] + 1) * (b[3] - a[1] + 1) - inter
            return inter / union if union > 0 else 0.0

        scores = [score(leaf[0]) for leaf in found]
        found[scores.index(max(scores))][2].append(k)

    def read(node):
        """(lines in order, number of lines, number of tall ones)."""
        box, children, own = node
        if not children:
            tall = sum(grid[k][2] - grid[k][0] < grid[k][3] - grid[k][1] for k in own)
            key = (lambda k: (-grid[k][0], grid[k][1])) if len(own) < 2 * tall else (lambda k: (grid[k][1], grid[k][0]))
            return sorted(own, key=key), len(own), tall
        parts = [read(c) for c in children]
        n, tall = sum(p[1] for p in parts), sum(p[2] for p in parts)
        if n < 2 * tall and all(c[0][1] == box[1] and c[0][3] == box[3] for c in children):
            parts.reverse()
        return [k for p in parts for k in p[0]], n, tall

    rank = [0] * len(grid)
    for at, k in enumerate(read(tree)[0]):
        rank[k] = at
    return rank


def test_cuts_against_single_cells(monkeypatch):
    rng = random.Random(13)
    for n in range(150):
        size = rng.choice([12, 40, 90])
        count = rng.choice([1, 2, 4, 7])
        boxes = [(x := rng.randint(0, size), y := rng.randint(0, size), x + rng.choice([0, 1, 5, 30]), y + rng.choice([0, 2, 9, 40])) for _ in range(count)]
        if n % 2:  # smaller cells keep the plain mesh small; the grid is the same for both
            monkeypatch.setattr(O, "CELLS", 12)
        monkeypatch.setattr(O, "SHORT", rng.choice([0, 200]))  # arrays or lists
        assert O.xy_cut(boxes) == plainly_cut(boxes), boxes
        monkeypatch.undo()
