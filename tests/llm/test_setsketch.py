"""Near-duplicates against brute force over all pairs, and components against a union-find."""

import random
import re

import numpy as np
from quirelay.llm import components as C
from quirelay.llm import setsketch as K

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng, n, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_near_duplicates(spark):
    rng = random.Random(8)
    texts = [None, "", "  \n", "one two", "ONE  two", "é É", "One\x00two three four five"]
    texts += family(rng, 60, 14) + family(rng, 5, 3) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(20)]
    texts += [texts[10]] * 5 + [texts[10].upper()]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, component string").repartition(3)
    small, bytes_ = K.BLOCK, K.SET_BYTES
    try:
        K.BLOCK, K.SET_BYTES = 16, 20_000  # so that buckets have several blocks, and blocks several parts
        got = {r["id"]: (r["n_shingles"], r["component"]) for r in K.near_duplicates(frame, shingle=4).collect()}
    finally:
        K.BLOCK, K.SET_BYTES = small, bytes_
    assert got == brute(docs, 4, 80)
    kept = sorted(r["doc_id"] for r in K.keep_one(frame, shingle=4).collect())
    assert kept == sorted(i for i, (_, c) in brute(docs, 4, 80).items() if i == c)


def test_defined_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = sorted((r["id"] or 0, r["n_shingles"], r["component"] or 0) for r in K.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 0), (0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert K.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_percent(spark):
    rng = random.Random(3)
    docs = list(enumerate(family(rng, 25, 40) + family(rng, 10, 90)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in K.near_duplicates(frame, shingle=2, percent=40).collect()}
    assert got == brute(docs, 2, 40)


def test_text_ids_and_one_id_with_two_texts(spark):
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [("b", "a b c d e f g"), ("a", "A b c d e f g"), ("c", "other words than these"), (None, "a b c d e f g"), ("10", long), ("9", long + " end")]
    got = {r["id"]: (r["class"], r["component"]) for r in K.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": ("a", "a"), "b": ("a", "a"), "c": ("c", "c"), None: (None, None), "10": ("10", "10"), "9": ("9", "10")}
    kept = {r["doc_id"] for r in K.keep_one(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert kept == {"a", "c", None, "10"}
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v w"), (2, "a b c d e f g"), (3, "p q r s t u v w"), (4, "P q r s t u v w x")]
    found = K.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=5).collect()
    assert sorted((r["id"], r["n_shingles"], r["component"]) for r in found) == [(1, 3, 1), (1, 4, 1), (2, 3, 1), (3, 4, 3), (4, 5, 3)]


def test_misses_of_the_bands():
    """Simulated with independent registers: fewer than 1e-5 of the pairs at the wanted similarity share no band."""
    layout = K.band_layout(80)
    counts = np.bincount(layout.ravel(), minlength=K.REGISTERS)
    assert layout.shape == (K.BANDS, 5) and counts.min() >= 1 and counts.max() <= 2 and all(len(set(b)) == 5 for b in layout.tolist())
    rng = np.random.default_rng(2)
    missed = sum(int((~(rng.random((50_000, K.REGISTERS), dtype=np.float32) < 0.8)[:, layout].all(axis=2).any(axis=1)).sum()) for _ in range(10))
    assert missed <= 8


def test_query(spark, tmp_path):
    rows = [(7, "a b c d e f"), (3, "A b c d e f"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in K.op4_setsketch(spark, str(tmp_path)).collect())
    assert got == [(3, 3, 3, True), (7, 3, 3, False), (9, 0, 9, True)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
    both = K.sketch([np.concatenate([a, b])])[0]
    assert (np.maximum(K.sketch([a])[0], K.sketch([b])[0]) == both).all()
    assert abs((K.sketch([a])[0] == both).mean() - 0.8) < 0.15


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["vertex"]: r["component"] for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in links if a != b for v in (a, b)}
