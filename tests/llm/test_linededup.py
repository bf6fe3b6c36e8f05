"""Line dedup against brute force over all places of all earlier documents, and alignment case by case."""

import random
from itertools import combinations

from quirelay.llm import linededup as L


def test_rising_and_patience():
    rng = random.Random(4)
    for _ in range(300):
        matches = sorted({(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(rng.randint(0, 9))})
        best = max(len(c) for r in range(len(matches) + 1) for c in combinations(matches, r) if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(c, c[1:])))
        assert len(L.rising(sorted(matches, key=lambda m: (m[0], -m[1])))) == best
        found = L.patience(list(matches))
        assert set(found) <= set(matches) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:])) and bool(found) == bool(matches)
    # Anchors first: the line that is unique on both sides decides where the repeated one belongs.
    assert L.patience([(0, 1), (1, 0), (1, 2), (2, 3)]) == [(0, 1), (1, 2), (2, 3)]


def test_blocks_hold_every_shared_run():
    rng = random.Random(5)
    for _ in range(300):
        runs = [(rng.randint(0, 12), rng.randint(0, 12), rng.randint(1, 4)) for _ in range(rng.randint(0, 8))]
        blocks = L.common_blocks(runs)
        assert all(any(b - a == y - x and x <= a and a + n <= x + m for x, y, m in blocks) for a, b, n in runs)
        assert {a + k for a, _, n in runs for k in range(n)} == {a + k for a, _, n in blocks for k in range(n)}
    # A passage in order is one block, the passage before it in the earlier document another one.
    assert L.common_blocks([(0, 5, 2), (1, 6, 2), (4, 0, 3)]) in ([(0, 5, 3), (4, 0, 3)], [(4, 0, 3), (0, 5, 3)])
    assert len(L.common_blocks([(k, 900 - 2 * k, 1) for k in range(0, 400, 2)])) == 200


def copied(docs, least):
    """Without Spark: lines in equal runs of ``least`` words of any earlier document, by comparing all pairs of places."""
    split = {i: [x for x in t.split("\n") if x.split()] for i, t in docs}
    out = {}
    for i, d in split.items():
        gone = set()
        for j, e in split.items():
            for a in range(len(d)) if j < i else ():
                for b in range(len(e)):
                    n = 0
                    while a + n < len(d) and b + n < len(e) and d[a + n] == e[b + n]:
                        n += 1
                    if n and sum(len(x.split()) for x in d[a : a + n]) >= least:
                        gone |= set(range(a, a + n))
        out[i] = [x for k, x in enumerate(d) if k not in gone]
    return out


def test_runs_of_any_earlier_document(spark):
    rng = random.Random(7)
    lines = ["a b c", "d e", "f g h i", "x", "", "long line with six words here", "  "]
    docs = [(i, "\n".join(rng.choice([*lines, f"own {i} {k}"]) for k in range(rng.randint(0, 9)))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for least in (1, 5, 10):
        got = {r["doc_id"]: r for r in L.without_shared_blocks(frame, min_words=least).collect()}
        kept = {i: [x for x in r["text"].split("\n") if x.split()] for i, r in got.items()}
        assert kept == copied(docs, least)
        assert all(r["removed_words"] == len(dict(docs)[i].split()) - len(r["text"].split()) for i, r in got.items())


def test_passage_of_lines_with_different_first_holders(spark):
    """Eight lines of eight words, each seen earlier in a document of its own, stand whole in document 20."""
    lines = [" ".join(f"w{k}x{n}" for n in range(8)) for k in range(8)]
    rows = [*enumerate(lines), (20, "\n".join(lines)), (21, "own\n" + "\n".join(lines))]
    got = {r["doc_id"]: (r["text"], r["removed_lines"], r["removed_words"]) for r in L.without_shared_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[21] == ("own", 8, 64) and got[20] == (rows[8][1], 0, 0)


def test_cases_of_runs(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"own one\n{passage}\nend"), (2, f"own two\n{passage}"), (3, passage), (3, passage), (None, f"{passage}\nmine"), (4, "short\nlines"), (5, "short\nlines"), (6, None)]
    got = L.without_shared_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted((r["doc_id"] or 99, r["text"]) for r in got if r["text"] is not None)
    assert len(got) == 8 and texts == [(1, rows[0][1]), (2, "own two"), (3, ""), (3, ""), (4, "short\nlines"), (5, "short\nlines"), (99, "mine")]
    assert L.without_shared_blocks(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_line_before_and_inside_a_passage(spark):
    """The later document has one line of the passage before it as well; no occurrence decides what is compared."""
    passage = ["one two three four", "menu", "five six seven eight", "menu", "nine ten eleven"]
    rows = [(1, "\n".join(passage)), (2, "\n".join(["menu", "own line", *passage, "menu"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in L.without_shared_blocks(docs).collect()} == {1: rows[0][1], 2: "menu\nown line\nmenu"}


def test_other_ids_line_ends_long_texts_and_clashing_columns(spark):
    passage = [f"line {k} of a passage with some words in it" for k in range(4)]
    rows = [("b", "\r\n".join(passage) + "\r\nown", 1), ("a", "\n".join(passage), 2), (None, "\n".join(passage), 3)]
    got = {r["doc_id"]: r for r in L.without_shared_blocks(spark.createDataFrame(rows, "doc_id string, text string, removed_lines long")).collect()}
    assert {k: (r["text"], r["removed_lines"]) for k, r in got.items()} == {"a": (rows[1][1], 0), "b": ("own", 4), None: ("", 4)}
    many = "\n".join(f"own line number {k} of the long document" for k in range(30_000))
    rows = [(1, many), (2, "\n".join(reversed(many.split("\n"))) + "\nend"), (3, "same words in every line here\n" * 20_000), (4, "same words in every line here\n" * 5)]
    got = {r["doc_id"]: r["text"] for r in L.without_shared_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == many and got[2] == rows[1][1] and got[3] == rows[2][1] and got[4] == ""


def test_alignments_name_the_pair(spark):
    passage = "\n".join(f"line {k} of a passage with some words in it" for k in range(4))
    rows = [(1, f"first\n{passage}"), (2, passage), (3, f"{passage}\n\nend")]
    got = sorted((r["id"], r["owner"], [tuple(b) for b in r["blocks"]]) for r in L.alignments(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, 1, [(0, 1, 4)]), (3, 1, [(0, 1, 4)])]


def test_query(spark, tmp_path):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j\nown"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["text"] for r in L.op10_line_dedup(spark, str(tmp_path)).collect()} == {1: rows[0][1], 2: "own", 3: None}
