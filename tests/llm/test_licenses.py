"""Template markup, the automaton, and the base columns against brute force."""

import random
import re

from quirelay.llm import licenses as L


def brute(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(L.TO_LOWER))
    places = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", "Licensed under CC BY-NC 4.0.", "cc by cc by", "ALL RIGHTS RESERVED. all rights-reserved", "the GNU General Public License, version 3", "éall rights reserved", "all rights reservedé", "acc by",
    "x all\nrights\treserved", "Released under the MIT License.", "general general public license public license", "Copyright (c) 2020 Some One. All rights reserved.", "ſcc by", "K rights", "cc by é",
]


def test_base_and_labels(tmp_path, spark):
    rows = [(i, t, "zz", None) for i, t in enumerate(TEXTS)] + [(0, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, label string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op9_licenses(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) or not r["base_labels"]
        assert 0 <= r["score"] <= 1
    labels = {TEXTS[r["doc_id"]]: r["labels"] for r in got}
    assert "mit" in labels["Released under the MIT License."] and "cc-by-nc" in labels["Licensed under CC BY-NC 4.0."] and "copyright" in labels[TEXTS[12]]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""


def test_notices_tags_and_whole_texts():
    a = L.TemplateAutomaton(L.TEMPLATES)
    found = lambda s: {x for x, *_ in a.places(L.WORD.findall(s.translate(L.TO_LOWER)))}
    assert found("Licensed under the MIT License") == found("// SPDX-License-Identifier: MIT") == found("distributed under the terms of the MIT license") == found("Released under the MIT License.") == {"mit"}
    assert found("licensed under the GNU General Public License version 2") == {"gpl-2.0"} and found("available under the Apache License, Version 2.0") == {"apache-2.0"}
    assert found("licensed under the terms of the GNU Lesser General Public License") == {"lgpl"} and found("SPDX-License-Identifier: BSD-3-Clause") == {"bsd"}
    assert not found("licensed under the law") and not found("a mit license") and not found("published under the name of")
    words = L.WORD.findall(MIT.translate(L.TO_LOWER))
    assert ("mit", 0, len(words)) in a.places(words)
    # A mandatory word missing, changed or added anywhere: the whole text isn't accepted.
    for k in range(1, len(words) - 1):
        for changed in (words[:k] + words[k + 1 :], words[:k] + ["zzz"] + words[k + 1 :]):
            if words[k] != "software":
                assert ("mit", 0, len(changed)) not in a.places(changed)


def wordings(items, words):
    """Every end of ``items`` (parsed markup) matched at the opening of ``words``, by trying all choices."""
    if not items:
        return {0}
    (kind, value), rest = items[0], items[1:]
    if kind == "word":
        return {1 + e for e in wordings(rest, words[1:])} if words and words[0] == value else set()
    if kind == "optional":
        return wordings(rest, words) | wordings(value + rest, words)
    least, most = value
    return {n + e for n in range(least, min(most, len(words)) + 1) for e in wordings(rest, words[n:])}


def test_places_by_brute_force():
    rng = random.Random(5)
    templates = {"a": ["x <<optional>>y<<end>> z", "x <<var 0 2>> w"], "b": ["y <<optional>>z <<optional>>x<<end>><<end>> <<var 1 2>> x"], "c": ["z z"]}
    automaton = L.TemplateAutomaton(templates)
    for _ in range(3000):
        words = [rng.choice("xyzwv") for _ in range(rng.randint(0, 10))]
        want = set()
        for label, markups in templates.items():
            for i in range(len(words)):
                ends = set().union(*(wordings(L.parse(m), words[i:]) for m in markups))
                if ends:
                    want.add((label, i, i + max(ends)))
        assert set(automaton.places(words)) == want


def test_markup():
    a = L.TemplateAutomaton({"t": ["one <<optional>>two <<optional>>three<<end>><<end>> four <<var 1 2>> five"]})
    spans = lambda s: [(x, y) for _, x, y in a.places(s.split())]
    assert spans("one four x five") == [(0, 4)] and spans("one two three four x y five z") == [(0, 7)] and spans("one two four x five") == [(0, 5)]
    assert not spans("one three four x five") and not spans("one four five") and not spans("one four a b c five")
    assert spans("one four five five") == [(0, 4)]


def test_empty_table_long_text_and_clashing_columns(tmp_path, spark):
    spark.createDataFrame([(1, "word " * 200_000 + "licensed under the MIT license", 3, "p")], "doc_id long, text string, score int, places string").write.parquet(f"{tmp_path}/documents.parquet")
    r = L.op9_licenses(spark, str(tmp_path)).collect()[0]
    assert (r["n_words"], r["n_base"], r["labels"]) == (200_005, 0, "mit") and r["first_word"] is None and 0 < r["score"] < 1
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert L.op9_licenses(spark, f"{tmp_path}/none").count() == 0
