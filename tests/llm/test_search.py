"""Ranked search against scores computed document by document."""

import math
import random
import re
from collections import Counter

import pytest
from quirelay.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    """docs: (id, text), items: (id, text); rows (item, rank, id, score)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counted:
            m = 75 + 25 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is not None, i or 0, i, score))
        out += [(item, k + 1, i, s) for k, (*_, i, s) in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return out


def same(spark, docs, items, top=20, **more):
    d = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, key string").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, slice int").repartition(2)
    got = search.search(d, q, top, **more)
    assert got.columns == ["item", "rank", "id", "score"]
    order = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(brute(docs, items, top), key=order)
    assert sorted(map(tuple, got.collect()), key=order) == want
    return want


@pytest.mark.parametrize("seed,owners,bundle,cut,top", [(1, 4, 64, 4096, 20), (2, 3, 2, 5, 3), (3, 1, 1, 1, 2), (4, 5, 3, 7, 1)])
def test_random(spark, seed, owners, bundle, cut, top):
    rng = random.Random(seed)
    words = ["the", "The", "of", "Été", "été", "x1", "42", "　", "don't", "ÀB"] + [f"w{k}" for k in range(40)]
    weights = [40, 5, 30, 3, 3, 2, 2, 1, 2, 1] + [1] * 40
    text = lambda n: rng.choice([" ", "-", "  ."]).join(rng.choices(words, weights, k=rng.randint(0, n)))
    docs = [(i, text(60)) for i in range(150)] + [(900, None), (901, " ..")] + [(1000 + i, "the same text w1 w2") for i in range(30)]
    items = [(i, text(12)) for i in range(12)] + [(50, "w1 same w1"), (51, None), (52, "nowhere"), (53, ""), (54, "the the")]
    assert len(same(spark, docs, items, top, owners=owners, bundle=bundle, slice_rows=cut)) > 10


def test_ties_repeats_and_nulls(spark):
    """Equal rows are found each by itself, null ids first; items with one id are ranked each by itself."""
    docs = [(5, "b c d"), (5, "b c d"), (None, "b c d"), (2, "b c d"), (7, "e"), (8, "f f f")]
    same(spark, docs, [(1, "b"), (2, "d d e"), (None, "f")], 4)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "e"), (1, "f")], "item_id long, text string")
    assert sorted(map(tuple, search.search(d, q).collect())) == sorted(brute(docs, [(1, "e")], 20) + brute(docs, [(1, "f")], 20))


def test_empty_and_string_ids(spark):
    d = spark.createDataFrame([("b", "x y"), ("a", "x z")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "x y q")], "item_id long, text string")
    assert [(r["id"], r["rank"]) for r in search.search(d, q).orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    assert search.search(d.limit(0), q).count() == 0 and search.search(d, q.limit(0)).count() == 0


def test_no_term_of_the_items_is_missed_by_a_small_bitmap(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(f"t{rng.randint(0, 3000)}" for _ in range(50))) for i in range(40)]
    same(spark, docs, [(i, " ".join(f"t{rng.randint(0, 3000)}" for _ in range(20))) for i in range(5)], bits=15)
