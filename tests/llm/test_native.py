"""Sharding and decontamination: laws, brute force, plans without Python, defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F
from quirelay.llm import decontam as D
from quirelay.llm import sharding as S
from quirelay.llm.util import held_out

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_shards(spark):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randint(0, 5), rng.choice(["a", "a", "a", "b", None]), 1, 2) for i in range(500)]
    rows += [(1000, "same", "a", 1, 2)] * 3 + [(None, None, "c", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, size int").repartition(5)
    got = S.shard_plan(docs).collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
        mix = Counter(r["stratum"] for r in got if r["shard"] == s)
        total = Counter(r["stratum"] for r in got)
        assert all(abs(mix[k] - n / 8) <= 3 for k, n in total.items())
    text = {i: t for i, t, *_ in rows}
    for r in got:
        raw = text[r["id"]] or ""
        assert (r["size"], r["text_crc32"]) == (len(raw.encode()) + 1, zlib.crc32(raw.encode()))
    again = S.shard_plan(docs.repartition(2)).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert S.shard_plan(docs.limit(0)).count() == 0


def brute(docs, items):
    windows = {}
    for item, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(item))
    out = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out.append((-1 if i is None else i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_decontamination(spark):
    rng = random.Random(6)
    vocabulary = ["the", "of", "a", "b", "ü1", "X"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 13, 20, 30])))) for k in range(6)] + [(99, None), (98, "..."), (97, "q r s t u v w x y z a b c"), (97, "q r s t u v w x y z a b c")]
    docs = []
    for i in range(150):
        w = [rng.choice([*vocabulary, f"z{rng.randrange(99)}"]) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            w[rng.randrange(len(w) + 1) : 0] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i, ", ".join(w)))
    docs += [(3, docs[3][1])] * 2 + [(None, "q r s t u v w x y z a b c"), (500, None), (501, "")]
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, n_words int, items string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    usual = D.LEAST_BITS, D.MOST_BITS
    for bits in (usual, (64, 64)):  # a bitmap that is large enough, and one that is full
        D.LEAST_BITS, D.MOST_BITS = bits
        try:
            got = sorted((-1 if r["id"] is None else r["id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in D.decontaminate(frame, bench).collect())
        finally:
            D.LEAST_BITS, D.MOST_BITS = usual
        assert got == brute(docs, items)
    clean = {r["doc_id"] for r in D.clean_documents(frame, bench).collect()}
    assert clean == {i for i, t in docs if i is not None and not dict((x[0], x[4]) for x in brute(docs, items))[i]}
    same_id = spark.createDataFrame([(None, "q r s t u v w x y z a b c"), (None, "clean"), (1, "clean"), (1, "q r s t u v w x y z a b c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in D.clean_documents(same_id, bench).collect()) == [(0, "clean"), (1, "clean")]
    assert D.decontaminate(frame, bench.limit(0)).where("n_hit > 0").count() == 0 and D.decontaminate(frame.limit(0), bench).count() == 0
    plan = D.decontaminate(frame, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_many_windows_and_the_query(spark, tmp_path):
    rng = random.Random(9)
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(1012))) for k in range(200)]
    docs = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(0, 200)))) for i in range(60)]
    docs += [(100 + k, "before " + " ".join(items[k][1].split()[k : k + 13 + k]) + " after") for k in range(30)] + [(200, "filler " * 50_000 + " ".join(items[0][1].split()[5:40]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"], r["contaminated"]) for r in D.op5_decontamination(spark, str(tmp_path)).collect())
    assert got == [(i, n, h, hashlib.sha256(",".join(x).encode()).hexdigest(), c) for i, n, h, x, c in brute(docs, items)]


def test_held_out(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
