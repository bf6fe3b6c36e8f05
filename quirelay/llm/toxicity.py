"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context.

The lexicon is learnt from labelled rows: words and stems (openings of 4 to 6 letters) that stand in enough
toxic texts, in at least ``MIN_CONTEXTS`` different surroundings (so that copies of one text don't make its
words toxic), and in next to no other text. It is put into a trie. A word matches

- exactly, if the trie accepts it or it opens with a stem, whatever its length;
- as a misspelling, if the Levenshtein automaton of the word (one edit, a swap of neighbours included) and
  the trie, walked together, reach an accepted term of five letters or more. Terms are also compared with
  usual digits and signs for letters undone. Terms whose neighbours stand in
  sample texts that aren't toxic are matched exactly alone, unless the neighbours' odds are as high as a term's must be. A word that shares neither
  the first half (border letter swapped included) nor the second half of any term can't be within one edit
  and isn't walked, nor is one of more letters than the longest term and one.

A word that doesn't match as a whole is split at the signs (``* @ $ !``) that glue words together, and its parts count.

Each match has a context window: if there are quotation marks on both sides of it within ``WINDOW``
characters, or a word of reporting near before it, it counts as quotation, else as abuse. A logistic
regression over the weighted counts gives the score, 0 to 1.

Lexicon and regression are fitted on at most ``sample_toxic`` and ``sample_other`` labelled rows, those with
the least hashed ids.

Defined cases: null and empty texts have no match and get the score of such texts; without labelled rows
every score is 0; labels that are null or neither 0 nor 1 aren't learnt from; an id labelled twice counts
once if the labels agree, else not at all; equal rows are scored each; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowio import arrow_map, pieces
from .util import durable, held_out, read

SAMPLE_TOXIC, SAMPLE_OTHER, TERMS = 2000, 4000, 4000
MIN_TEXTS, MIN_CONTEXTS, MIN_ODDS = 6, 4, 40.0
STEMS = (4, 5, 6)
WINDOW, FUZZY, KEPT_WORDS = 60, 0.7, 300_000
WORD = re.compile(r"[^\W_]+(?:[*@$!]+[^\W_]+)*")
GLUE = re.compile(r"[*@$!]+")
#: Marks of quotation, words of reporting, and signs used for letters.
MARKS = "\"“”„«»‹›"
REPORTING = re.compile(r"\b(?:said|says|wrote|writes|called|calls|quote|quoted|quoting|dijo|escribió|a dit|écrit|sagte|schrieb)\b")
SIGNS = str.maketrans("013457@$!", "oieastasi")


class Trie:
    """Terms and stems by letters; a node's value is None, 'term' or 'stem'. ``alone``: terms without misspellings."""

    def __init__(self, terms: list[tuple[str, bool]], alone: frozenset[str] = frozenset()):
        self.alone = alone
        self.terms = {t for t, stem in terms if not stem}
        self.root: dict = {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        for text, stem in terms:
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node[""] = "stem" if stem or node.get("") == "stem" else "term"
            if not stem and len(text) >= 5 and text not in alone:
                half = len(text) // 2
                # An edit leaves one half whole, or swaps the letters at their border.
                self.heads |= {text[:half], text[: half - 1] + text[half]}
                self.tails.add(text[half:])
        #: letters of the longest word within one edit of a term
        self.longest = 1 + max((len(t) for t in self.terms), default=0)
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})

    def exact(self, word: str) -> bool:
        node = self.root
        for c in word:
            node = node.get(c)
            if node is None:
                return False
            if node.get("") == "stem":
                return True
        return node.get("") == "term"

    def near(self, word: str) -> set[str]:
        """Walk the trie with the states of the word's automaton: the terms of 5 letters or more within one edit."""
        if not 4 <= len(word) <= self.longest or not (any(word[:k] in self.heads for k in self.head_sizes) or any(word[-k:] in self.tails for k in self.tail_sizes)):
            return set()
        out = set()
        n = len(word)
        # A state (letters of the word used, edits) or (.., .., letter owed by a swap); the trie node says what was read.
        todo = [(self.root, "", frozenset({(0, 0, ""), (1, 1, "")}))]
        while todo:
            node, term, states = todo.pop()
            if len(term) >= 5 and term in self.terms and term not in self.alone and any(i == n and not owed for i, _, owed in states):
                out.add(term)
            for c, child in node.items():
                if not c:
                    continue
                new = set()
                for i, e, owed in states:
                    if owed:
                        if c == owed:
                            new.add((i, e, ""))
                        continue
                    if i < n and word[i] == c:
                        new.add((i + 1, e, ""))
                    if e == 0:
                        new.add((i, 1, ""))  # a letter of the term is missing in the word
                        if i < n:
                            new.add((i + 1, 1, ""))  # another letter stands for it
                        if i + 1 < n and word[i + 1] == c:
                            new.add((i + 2, 1, word[i]))  # neighbours are swapped
                        if i + 1 < n and word[i + 1] == c:
                            new.add((i + 2, 1, ""))  # the word has a letter too many
                # a letter too many at the end of the word
                new |= {(i + 1, 1, "") for i, e, owed in new if e == 0 and i < n and not owed}
                if new:
                    todo.append((child, term + c, frozenset(new)))
        return out

    def weight(self, word: str) -> float:
        """The weight of the whole word, or the sum over the words that signs glue together."""
        found = self.single(word)
        if not found and len(parts := GLUE.split(word)) > 1:
            found = sum(map(self.single, parts))
        return found

    def single(self, word: str) -> float:
        if self.exact(word):
            return 1.0
        plain = word.translate(SIGNS)
        if plain != word:
            plain = plain.replace("*", "")
            if self.exact(plain) or self.near(plain):
                return FUZZY
        return FUZZY if self.near(word) else 0.0


class Weights(dict):
    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str) -> float:
        found = self.trie.weight(word)
        if len(word) <= 40:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found


def quoted(text: str, first: int, end: int) -> bool:
    before, after = text[max(0, first - WINDOW) : first], text[end : end + WINDOW]
    return (any(m in before for m in MARKS) and any(m in after for m in MARKS)) or bool(REPORTING.search(before))


def matches(text: str, weights: Weights) -> list[tuple[int, int, float, bool]]:
    """(start, end, weight, quotation) of the matches in a lower-cased text, in code points."""
    words = WORD.findall(text)
    if not any(map(weights.__getitem__, words)):
        return []
    return [(m.start(), m.end(), w, quoted(text, m.start(), m.end())) for m in WORD.finditer(text) if (w := weights[m.group()])]


def features(text: str, weights: Weights) -> list[float]:
    found = matches(text, weights)
    abuse = sum(w for *_, w, q in found if not q)
    quote = sum(w for *_, w, q in found if q)
    return [float(np.log1p(abuse)), float(np.log1p(quote)), min(1.0, 20.0 * abuse / (1 + text.count(" ")))]


FIXED = np.array([4.0, 1.0, 1.0])


def train(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic regression with balanced classes and a weak pull to fixed weights; weights of matches stay positive."""
    w = np.concatenate([FIXED, [-2.0]])
    data = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        w -= 2.0 * (data.T @ (share * (p - y)) + 1e-3 * (w - np.concatenate([FIXED, [-2.0]])))
        w[:3] = np.maximum(w[:3], 0.05)
    return w


def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, toxic, context) once for each text."""
    for batch, texts in pieces(batches, "text", 1 << 20):
        rows: list[tuple[str, bool, int, int]] = []
        for text, toxic in zip(texts.to_pylist(), batch.column("toxic").to_pylist()):
            seen: dict[tuple[str, bool], int] = {}
            last = ""
            for w in WORD.findall(text.lower()):
                for part in {w, *GLUE.split(w)}:
                    if (part, False) not in seen:
                        context = hash_of(last)
                        seen[part, False] = context
                        for k in STEMS:
                            if len(part) >= k:
                                seen.setdefault((part[:k], True), context)
                last = w
            rows += [(t, s, toxic, c) for (t, s), c in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())], names=["term", "stem", "toxic", "context"])


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode()) & 0xFFFF


def sizes(sample: DataFrame) -> tuple[int, int]:
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    return n.get(1, 0), n.get(0, 0)


def odds(toxic: int, other: int) -> Column:
    """Smoothed odds of ``t`` of the toxic texts against ``o`` of the others."""
    return ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("o") + 0.5) / (other + 1))


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool]]:
    """At most TERMS terms and stems from ``sample`` (text, toxic)."""
    toxic, other = sizes(sample)
    counts = arrow_map(sample.select("text", "toxic"), terms_of, "term string, stem boolean, toxic int, context int").groupBy("term", "stem").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("context"))).alias("contexts")
    )
    rows = counts.where((F.col("t") >= MIN_TEXTS) & (F.col("contexts") >= MIN_CONTEXTS) & (odds(toxic, other) >= MIN_ODDS) & (F.col("o") * 200 <= F.col("t"))).orderBy(odds(toxic, other).desc(), "term", "stem").limit(TERMS).collect()
    return sorted((r["term"], r["stem"]) for r in rows)


def near_terms(lexicon: list[tuple[str, bool]]):
    """Arrow function: (term, toxic) of the terms of which each text has a misspelling, once for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(lexicon)
        known: dict[str, set[str]] = {}
        for batch, texts in pieces(batches, "text", 1 << 20):
            rows: list[tuple[str, int]] = []
            for text, toxic in zip(texts.to_pylist(), batch.column("toxic").to_pylist()):
                found: set[str] = set()
                for w in set(WORD.findall(text.lower())):
                    for part in {w, *GLUE.split(w)}:
                        if part not in known:
                            known[part] = set() if trie.exact(part) else trie.near(part)
                        found |= known[part]
                rows += [(t, toxic) for t in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["term", "toxic"])

    return run


def without_misspellings(sample: DataFrame, lexicon: list[tuple[str, bool]]) -> frozenset[str]:
    """Terms whose neighbours stand in texts that aren't toxic, and whose odds by texts with neighbours are under MIN_ODDS; bounded by the lexicon."""
    toxic, other = sizes(sample)
    near = arrow_map(sample.select("text", "toxic"), near_terms(lexicon), "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    return frozenset(r["term"] for r in near.where((F.col("o") > 0) & (odds(toxic, other) < MIN_ODDS)).collect())


def featurised(lexicon: list[tuple[str, bool]], alone: frozenset[str], w: np.ndarray | None):
    """Arrow function: features or, with weights, scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(Trie(lexicon, alone))
        for batch, texts in pieces(batches, "text"):
            x = np.array([features(t.lower(), weights) for t in texts.to_pylist()]).reshape(len(batch), 3)
            first = batch.column(0)
            if w is None:
                yield pa.RecordBatch.from_arrays([first, *[pa.array(x[:, k]) for k in range(3)]], names=["toxic", "a", "b", "c"])
            else:
                score = 1 / (1 + np.exp(-np.clip(x @ w[:3] + w[3], -30, 30)))
                yield pa.RecordBatch.from_arrays([first, pa.array(score), pa.array(np.expm1(x[:, 0])), pa.array(np.expm1(x[:, 1]))], names=["id", "score", "abuse", "quotation"])

    return run


def score_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", sample_toxic: int = SAMPLE_TOXIC, sample_other: int = SAMPLE_OTHER) -> DataFrame:
    """A row for each row of ``docs``: id, score, abuse, quotation; learnt from ``labels``, which may be a part of the ids."""
    clear = labels.where(F.col(toxic_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(toxic_col).cast("int").alias("toxic"), F.max(toxic_col).cast("int").alias("most")).where("toxic = most").select("id", "toxic")
    h = F.xxhash64(F.lit(5), F.col("id").cast("string"))
    picked = clear.where("toxic = 1").orderBy(h, "id").limit(sample_toxic).union(clear.where("toxic = 0").orderBy(h, "id").limit(sample_other))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Bounded by the two sample sizes.
    sample = durable(slim.join(F.broadcast(picked), "id").dropDuplicates(["text"]).select("id", "text", "toxic"), "toxicity-sample")
    lexicon = learn_lexicon(sample)
    alone = without_misspellings(sample, lexicon)
    rows = arrow_map(sample.select("toxic", "text"), featurised(lexicon, alone, None), "toxic int, a double, b double, c double").limit(sample_toxic + sample_other).collect()
    rows.sort()
    if not rows:
        return slim.select("id", F.lit(0.0).alias("score"), F.lit(0.0).alias("abuse"), F.lit(0.0).alias("quotation"))
    w = train(np.array([[r["a"], r["b"], r["c"]] for r in rows]), np.array([r["toxic"] for r in rows]))
    return arrow_map(slim, featurised(lexicon, alone, w), f"id {slim.schema['id'].dataType.simpleString()}, score double, abuse double, quotation double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    found = score_texts(read(spark, sf_dir, "documents"), labels)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "abuse", "quotation")
