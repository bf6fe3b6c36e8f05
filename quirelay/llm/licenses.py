"""License scans by template-markup matching.

A template is plain wording with marked regions: ``<<optional>>...<<end>>`` may be missing, and
``<<var min max>>`` stands for any ``min`` to ``max`` words. Templates are split into words as texts are
(A-Z lower-cased, runs outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F``) and compiled into one token automaton
over sets of positions, which accepts a place whose mandatory wording matches word for word. The automaton is
determinised while it runs; its states are kept in a table.

The three base phrases are templates without regions, so their places come from the same automaton. A text
is split into words only if it holds a word with which some template can start; otherwise its words are
just counted, on the bytes.

The score of a text is ``1 - exp(-words of accepted places / 8)``: 0 without any place, nearer to 1 the more
wording is matched.

Defined cases: null and empty texts have no words, no places, empty labels and score 0; overlapping places
of one or several templates all count; equal rows are returned each; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import arrow_map, buffers, pieces
from .util import LOWER, UPPER, read

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Names under which licenses are cited, by label, in markup.
NAMES = {
    "agpl-3.0": ["gnu affero general public license <<optional>>version<<end>> <<optional>>v<<end>> 3", "agplv3", "agpl 3 0"],
    "apache-2.0": ["apache license <<optional>>version<<end>> 2 0", "apache 2 0"],
    "bsd": ["<<optional>>new<<end>> <<optional>>revised<<end>> <<optional>>simplified<<end>> <<optional>>2 clause<<end>> <<optional>>3 clause<<end>> bsd", "bsd 2 clause", "bsd 3 clause"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc0": ["cc0", "creative commons zero"],
    "gpl-2.0": ["gnu general public license <<optional>>gpl<<end>> <<optional>>version<<end>> <<optional>>v<<end>> 2", "gplv2", "gpl 2 0"],
    "gpl-3.0": ["gnu general public license <<optional>>gpl<<end>> <<optional>>version<<end>> <<optional>>v<<end>> 3", "gplv3", "gpl 3 0"],
    "isc": ["isc"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license", "lgpl"],
    "mit": ["mit", "expat", "x11"],
    "mpl-2.0": ["mozilla public license <<optional>>version<<end>> <<optional>>v<<end>> 2 0", "mpl 2 0"],
    "unlicense": ["unlicense"],
}
#: Ways to put a work under a license; NAME stands for each name.
GRANTS = [
    f"{verb} under <<optional>>the<<end>> <<optional>>a<<end>> <<optional>>terms of the<<end>> <<optional>>terms and conditions of the<<end>> NAME" for verb in ("licensed", "released", "distributed", "available", "published")
]
#: Identifiers of the public list of short license names, as words.
IDENTIFIERS = {
    "agpl-3.0": ["agpl 3 0"], "apache-2.0": ["apache 2 0"], "bsd": ["bsd 2 clause", "bsd 3 clause"], "cc-by-nc": ["cc by nc"], "cc-by-sa": ["cc by sa"], "cc0": ["cc0 1 0"], "gpl-2.0": ["gpl 2 0"], "gpl-3.0": ["gpl 3 0"],
    "isc": ["isc"], "lgpl": ["lgpl 2 1", "lgpl 3 0"], "mit": ["mit"], "mpl-2.0": ["mpl 2 0"], "unlicense": ["unlicense"],
}
#: Whole texts and notices of licenses, in markup.
TEXTS = {
    "apache-2.0": [
        "licensed under the apache license <<optional>>version<<end>> 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<var 1 9>> "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache license <<optional>>version<<end>> 2 0 <<optional>>january 2004<<end>> http www apache org licenses",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<var 0 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<var 0 1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "<<optional>><<var 0 1>> neither the name of <<var 1 12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<<end>> "
        "this software is provided by <<var 1 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ],
    "cc0": ["to the extent possible under law <<var 1 12>> waived all copyright and related or neighboring rights to"],
    "copyright": ["copyright <<optional>>c<<end>> <<optional>>©<<end>> <<var 1 6>> all rights reserved"],
    "gpl-2.0": [
        "this <<var 1 3>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or <<optional>>at your option<<end>> any later version",
    ],
    "gpl-3.0": [
        "this <<var 1 3>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or <<optional>>at your option<<end>> any later version",
        "licensed under the <<optional>>terms of the<<end>> gnu <<optional>>lesser<<end>> <<optional>>affero<<end>> general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 3",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "<<optional>>provided that the above copyright notice and this permission notice appear in all copies<<end>>",
    ],
    "lgpl": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the <<var 1 2>> to deal in the <<var 1 1>> without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the <<var 1 1>> and to permit persons to whom the <<var 1 1>> is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the <<var 1 1>>",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the <<var 1 2>> to deal in the software without restriction",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}


def own_templates() -> dict[str, list[str]]:
    """Whole texts, grants of each cited name, and identifier tags, by label."""
    out = {label: list(markups) for label, markups in TEXTS.items()}
    for label, names in NAMES.items():
        out.setdefault(label, []).extend(g.replace("NAME", n) for g in GRANTS for n in names)
    for label, tags in IDENTIFIERS.items():
        out.setdefault(label, []).extend(f"spdx license identifier {tag}" for tag in tags)
    return out


#: Labels of our own, in markup.
TEMPLATES = own_templates()
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BREAK = np.zeros(256, bool)
BREAK[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
TO_LOWER = str.maketrans(UPPER, LOWER)


def parse(markup: str) -> list[tuple[str, object]]:
    """('word', w), ('optional', inner items) and ('var', (least, most)) in order."""
    out: list = []
    stack = [out]
    for mark, text in re.findall(r"<<([^>]*)>>|([^<]+)", markup):
        if mark == "optional":
            stack.append([])
        elif mark == "end":
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif mark:
            _, least, most = mark.split()
            stack[-1].append(("var", (int(least), int(most))))
        else:
            stack[-1] += [("word", w) for w in WORD.findall(text.translate(TO_LOWER))]
    return out


class TemplateAutomaton:
    """Positions of all templates; ``step`` moves a set of (position, start of the place) by one word."""

    def __init__(self, templates: dict[str, list[str]]):
        self.arcs: list[list[tuple[str | None, int]]] = []  # (word or any, next position)
        self.free: list[list[int]] = []
        self.accept: dict[int, str] = {}
        self.starts: list[int] = []
        for label, markups in templates.items():
            for markup in markups:
                first = self._position()
                self.accept[self._build(parse(markup), first)] = label
                self.starts.append(first)
        self.closed = [self._closure(p) for p in range(len(self.arcs))]
        self.first_words = {w for p in self.starts for q in self.closed[p] for w, _ in self.arcs[q]}
        #: state after a word that starts a place
        self.begin: dict[str, tuple[int, ...]] = {}
        for w in self.first_words:
            self.begin[w] = tuple(sorted({r for p in self.starts for q in self.closed[p] for v, n in self.arcs[q] if v == w for r in self.closed[n]}))
        self.table: dict[tuple[tuple[int, ...], str], tuple[int, ...]] = {}

    def _position(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def _build(self, items: list, at: int) -> int:
        for kind, value in items:
            nxt = self._position()
            if kind == "word":
                self.arcs[at].append((value, nxt))
            elif kind == "optional":
                end = self._build(value, at)
                self.free[end].append(nxt)
                self.free[at].append(nxt)
            else:
                least, most = value
                for k in range(most):
                    if k >= least:
                        self.free[at].append(nxt)
                    step = self._position()
                    self.arcs[at].append((None, step))
                    at = step
                self.free[at].append(nxt)
            at = nxt
        return at

    def _closure(self, p: int) -> tuple[int, ...]:
        seen, todo = {p}, [p]
        while todo:
            for q in self.free[todo.pop()]:
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        return tuple(sorted(seen))

    def step(self, state: tuple[int, ...], word: str) -> tuple[int, ...]:
        key = (state, word)
        found = self.table.get(key)
        if found is None:
            found = tuple(sorted({r for q in state for w, n in self.arcs[q] if w is None or w == word for r in self.closed[n]}))
            if len(self.table) >= 200_000:
                self.table.clear()
            self.table[key] = found
        return found

    def places(self, words: list[str]) -> list[tuple[str, int, int]]:
        """(label, first word, end) of every accepted place, the longest end for each label and start."""
        out = []
        for i, w in enumerate(words):
            state = self.begin.get(w)
            j = i + 1
            best: dict[str, int] = {}
            while state:
                for q in state:
                    if q in self.accept:
                        best[self.accept[q]] = j
                if j == len(words):
                    break
                state = self.step(state, words[j])
                j += 1
            out += [(label, i, end) for label, end in best.items()]
        return sorted(out, key=lambda p: (p[1], p[0]))


def count_words(texts: pa.Array) -> np.ndarray:
    data, ends = buffers(texts)
    if not len(data):
        return np.zeros(len(texts), np.int64)
    inside = ~BREAK[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[ends[:-1][ends[:-1] < len(data)]] = False
    run = np.concatenate(([0], np.cumsum(inside & ~before)))
    return run[ends[1:]] - run[ends[:-1]]


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, n_words, places array<struct<label, first, end>>; base phrases have their own labels."""
    every = {"=" + label: [phrase] for phrase, label in BASE.items()}
    for label, markups in (TEMPLATES if templates is None else templates).items():
        every[label] = markups
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    place = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TemplateAutomaton(every)
        # Words next to non-ASCII letters belong to longer words, so a plain search may find too much, never too little.
        need = re.compile("|".join(sorted(map(re.escape, automaton.first_words), key=len, reverse=True)))
        breaks = "[\x00-\x2f\x3a-\x60\x7b-\x7f]"
        need = re.compile(f"(?:^|(?<={breaks}))(?:{need.pattern})(?={breaks}|$)", re.IGNORECASE | re.ASCII)
        for batch, texts in pieces(batches, "text"):
            found = []
            for text in texts.to_pylist():
                found.append([{"label": a, "first": b, "end": c} for a, b, c in automaton.places(WORD.findall(text.translate(TO_LOWER)))] if need.search(text) else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count_words(texts), pa.int64()), pa.array(found, place)], names=["id", "n_words", "places"])

    return arrow_map(slim, run, f"id {slim.schema['id'].dataType.simpleString()}, n_words long, places array<struct<label:string,first:int,end:int>>")


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["label"].startswith("="))
    starts = F.transform(base, lambda p: p["first"].cast("long"))
    names = F.transform("places", lambda p: F.regexp_replace(p["label"], "^=", ""))
    words = F.aggregate("places", F.lit(0), lambda a, p: a + p["end"] - p["first"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: F.substring(p["label"], 2, 100)))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("labels"), (F.lit(1.0) - F.exp(-words / F.lit(8.0))).alias("score"), "places",
    )
