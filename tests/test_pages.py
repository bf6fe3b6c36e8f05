"""Pages taken together: cuts of many pages at once against single ones, ways against all ways, plans that build a page's elements once."""

import functools
import random
import re
import time
from itertools import permutations

import numpy as np
import pytest
from quirelay.operators import cuts as C
from quirelay.operators import order as O
from quirelay.plans import catalog


def test_pages_cut_together(monkeypatch):
    """Empty pages, pages without an extent, long ones and chunks of one page among the others."""
    rng = random.Random(17)
    for n in range(40):
        size = rng.choice([1, 3, 12, 90, 900])
        pages = [[(x := rng.randint(-5, size), y := rng.randint(-5, size), x + rng.choice([-2, 0, 1, 5, 60]), y + rng.choice([-2, 0, 2, 9, 60])) for _ in range(rng.choice([0, 1, 2, 5, 14, 30]))] for _ in range(30)]
        pages += [[(0, 0, 10**9, 1), (5, 0, 9, 1)], [(3, 3, 9, 3)], [(3, 3, 9, 8)]]
        monkeypatch.setattr(C, "ROOM", rng.choice([1, 1 << 21]))
        monkeypatch.setattr(C, "SCORES", rng.choice([1, 1 << 18]))
        monkeypatch.setattr(C, "MANY", rng.choice([20, 128]))
        boxes = np.array([b for p in pages for b in p], np.int64).reshape(-1, 4)
        assert C.xy_cuts(boxes, np.array([len(p) for p in pages])).tolist() == [k for p in pages for k in O.xy_cut(p)]
    assert C.xy_cuts(np.zeros((0, 4), np.int64), np.zeros(2, np.int64)).tolist() == []


@pytest.mark.parametrize("name", ["page_sort", "smooth_order"])
def test_elements_are_built_once(spark, tmp_path, name):
    row = "(1L, 1L, 1L, 1, 1.0D, 1.0D, 0.1D, 0.1D, 'N', 'O', timestamp'2020-01-01')"
    spark.sql(f"select * from values {row} as t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.queries()[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\baggregate\(", plan)) == 1  # the fold that merges blocks
    assert "Window" in plan and found.count() == 1


def ways(n):
    """Every way, in the order of trial: single steps before leaps."""
    every = [(0, *p, n - 1) for p in permutations(range(1, n - 1)) if all(abs(a - b) <= 2 for a, b in zip((0, *p), (*p, n - 1)))]
    return sorted(every, key=lambda p: [b - a for a, b in zip(p, p[1:])])


@pytest.mark.parametrize("n", [3, 4, 7, 9])
def test_paths_with_equal_ways(n):
    rng = random.Random(n)
    every = ways(n)
    for _ in range(100):
        w = {(i, j): rng.choice([rng.randrange(3) * 0.1, rng.random()]) if n % 2 else rng.randrange(2) * 0.1 for i in range(n) for j in range(n)}
        assert O.cheapest_path(n, lambda i, j: w[i, j]) == list(min(every, key=lambda p: functools.reduce(lambda c, e: c + w[e], zip(p, p[1:]), 0.0)))


def test_path_through_many_places():
    """Leaps are cheap, so no way can be given up early; the work must not grow with the number of ways that lead nowhere."""
    began = time.process_time()
    for _ in range(100):
        got = O.cheapest_path(19, lambda i, j: 1.0 if j == i + 1 else 0.01)
    assert got == [0, *(k for i in range(0, 18, 3) for k in (i + 2, i + 1, i + 3))]
    assert time.process_time() - began < 3


@pytest.mark.parametrize("name", ["page_chain_text", "page_chain_xml"])
def test_chains_keep_pages_whole(spark, tmp_path, name):
    """A page is put together once, after one shuffle, and stays one list; a page without elements has no row."""
    rows = [f"({8 * k}L, {part}L, 1L, 1, 1.0D, 1.0D, {tenths}D, 0.1D, 'N', 'O', timestamp'2020-01-01')" for k, part, tenths in ((0, 1, 0.1), (0, 17, 0.1), (1, 1, 0.0), (2, 8, 0.1))]
    spark.sql(f"select * from values {', '.join(rows)} as t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.queries()[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\baggregate\(", plan)) == 1 and plan.count("Aggregate [") == 1 and plan.count("Repartition") == 1 and "Generate" not in plan
    got = {r["page_id"]: r[1] for r in found.collect()}
    assert sorted(got) == ([0, 2] if name == "page_chain_xml" else [0])  # page 2 has no line, page 1 nothing of enough score
    assert "line 0" in got[0]
