"""Collocations against counts of all phrases one by one."""

import random
import re
from collections import Counter, defaultdict

import pytest
from quirelay.llm import collocations


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], score) for i, (score, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def same(spark, rows, least, top=2000, **more):
    docs = spark.createDataFrame([(l, t, 1, "x") for l, t in rows], "lang string, text string, n int, words string").repartition(3)
    got = collocations.collocations(docs, least, top, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, least, top)
    assert sorted(map(tuple, got.collect())) == want
    return want


@pytest.mark.parametrize("seed,least,bits", [(1, 3, 27), (2, 5, 27), (3, 4, 16)])
def test_random(spark, seed, least, bits):
    """The number of buckets changes nothing."""
    rng = random.Random(seed)
    words = ["a", "B", "the", "of", "Été", "İ", "x\x00", "　", "don't", "-"]
    text = lambda: "".join(rng.choice([" ", "  ", "\t", ". ", "\n", ",", " "]) + rng.choice(words[: rng.randint(2, 10)]) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "fr", None]), text()) for _ in range(60)] + [("en", None), ("fr", ""), (None, " . ")]
    rows += [("en", "the quick brown fox jumps over the lazy dog; the quick brown")] * 7
    assert len(same(spark, rows, least, bits=bits)) > 20
    same(spark, rows, least, top=5)


def test_long_runs_ties_and_overlaps(spark):
    """One text of 3,000 equal words; equal scores go by phrase in byte order."""
    want = same(spark, [("en", "ha " * 3000), ("en", "b c. c b. é d. d é. z a. a z\n" * 5)], 5)
    assert ("en", 3000 - 4) in {(r[0], r[3]) for r in want}


def test_empty(spark):
    assert same(spark, [], 2) == [] and same(spark, [("en", None), (None, "one"), ("de", "..")], 1) == []


def test_few_buckets_prune_less_and_change_nothing(spark, monkeypatch):
    """All pairs in a handful of frequent buckets: nothing is pruned."""
    monkeypatch.setattr(collocations, "frequent_buckets", lambda docs, least, bits, pairs=None: b"\xff" * (1 << bits >> 3))
    rng = random.Random(8)
    same(spark, [("en", " ".join(rng.choice("a b c the of.".split()) for _ in range(40))) for _ in range(40)], 6, bits=16)
