"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are the character n-grams (2 to 4 letters, with word borders) of all its words, hashed
into ``BUCKETS`` rows of an embedding table; the text's vector is their average, and a linear softmax over
it gives the language. Table and softmax are trained together by stochastic gradient descent in numpy on a
bounded sample of labelled rows (``sample_rows``, the rows with the least hashed ids). A quarter of the
sample calibrates the result: a temperature is fitted to the likelihood, and a rejection threshold is set, both with
junk as the other side: for each calibration text one of as many n-grams drawn at random. It is the least threshold that rejects all
junk, but at most the confidence that a share of ``FALSE_REJECTIONS`` of the correctly predicted texts stays
below. The model carries both rates as ``junk_rejected`` and ``false_rejected``.

Afterwards ``embedding @ softmax`` is one small table of scores for each bucket, so a word adds the sum of
its rows, and words met before are looked up in a table of bounded size.

Defined cases: a null text or one without a letter (``str.isalpha``; numeric signs such as a half aren't letters) is ``und`` with score 0 and is rejected; without any
labelled row to learn from every text is ``und``; languages of the sample alone can be predicted; equal
rows are returned each; further columns are passed through, but for those with the names of the appended ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import arrow_map, pieces
from .util import held_out, read

BUCKETS, WIDTH, NGRAMS, KEPT_WORDS = 1 << 15, 16, (2, 3, 4), 300_000
SAMPLE_ROWS = 6000
FALSE_REJECTIONS = 0.001
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def subwords(word: str) -> list[int]:
    """Buckets of a lower-cased word; of a very long word all n-grams as well."""
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode()) & (BUCKETS - 1) for n in NGRAMS for i in range(len(w) - n + 1)]


def letters(text: str) -> list[str]:
    """Words with a letter, lower-cased."""
    found = WORD.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


class SubwordCounts(dict):
    def __missing__(self, word: str) -> np.ndarray:
        found = np.array(subwords(word), np.int64)
        if len(word) <= 40 and len(self) < KEPT_WORDS:
            self[word] = found
        return found


def featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of each text: at most BUCKETS entries, whatever its length."""
    table = SubwordCounts()
    for batch, texts in pieces(batches, "text"):
        ids, counts = [], []
        for text in texts.to_pylist():
            found = letters(text)
            sums = np.bincount(np.concatenate([table[w] for w in found]), minlength=BUCKETS) if found else np.zeros(1, np.int64)
            used = np.flatnonzero(sums)
            ids.append(used.astype(np.int16))
            counts.append(sums[used].astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(ids, pa.list_(pa.int16())), pa.array(counts, pa.list_(pa.float32()))], names=["lang", "h", "buckets", "counts"])


class Model:
    """Scores for each bucket, languages, temperature and threshold."""

    def __init__(self, langs: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float, threshold: float, junk_rejected: float = 0.0, false_rejected: float = 0.0):
        self.langs, self.scores, self.bias, self.temperature, self.threshold = langs, scores, bias, temperature, threshold
        self.junk_rejected, self.false_rejected = junk_rejected, false_rejected

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.5, seed: int = 3) -> Model | None:
    """Fit on (lang, buckets, counts); every fourth row calibrates."""
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    y = np.array([langs.index(r[0]) for r in rows])
    rng = np.random.default_rng(seed)
    table = np.zeros((BUCKETS, WIDTH), np.float32)  # buckets that training never meets stay without a say
    soft = rng.normal(0, 0.3, (WIDTH, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    fit = [i for i in range(len(rows)) if i % 4] or list(range(len(rows)))
    check = [i for i in range(len(rows)) if i % 4 == 0]
    share = lambda i: rows[i][2] / rows[i][2].sum()
    hidden = lambda i: share(i) @ table[rows[i][1]]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.01
        order = rng.permutation(fit)
        for first in range(0, len(order), 16):
            batch = order[first : first + 16]
            h = np.stack([hidden(i) for i in batch])
            z = h @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            back = p @ soft.T
            soft -= step * (h.T @ p) / len(batch) * 4
            bias -= step * p.mean(axis=0)
            for k, i in enumerate(batch):
                table[rows[i][1]] -= (step * 20) * np.outer(share(i), back[k])
    scores = (table @ soft).astype(np.float64)
    logits = np.stack([share(i) @ scores[rows[i][1]] + bias for i in check])
    truth = y[check]
    junk = np.stack([_drawn(rng, rows[i][2].sum()) @ scores + bias for i in check])
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.001, 20, 100):
        # Texts should be likely, and junk as likely in one language as in another.
        loss = -_log_softmax(logits / t)[np.arange(len(check)), truth].mean() - _log_softmax(junk / t).mean()
        if loss < best:
            best, temperature = loss, float(t)
    model = Model(langs, scores, bias.astype(np.float64), temperature, 0.0)
    p = model.probabilities(logits)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    junk = model.probabilities(junk).max(axis=1)
    if len(right):
        model.threshold = float(min(np.nextafter(junk.max(), 2), np.quantile(right, FALSE_REJECTIONS, method="lower")))
        model.junk_rejected, model.false_rejected = float((junk < model.threshold).mean()), float((right < model.threshold).mean())
    return model


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _drawn(rng: np.random.Generator, n: float) -> np.ndarray:
    """Shares of ``n`` n-grams that fall into buckets at random."""
    counts = np.bincount(rng.integers(0, BUCKETS, max(1, int(n))), minlength=BUCKETS)
    return counts / counts.sum()


class WordScores(dict):
    """Row of the growing word matrix for each word: summed scores and the number of n-grams."""

    def __init__(self, scores: np.ndarray):
        super().__init__()
        self.scores = scores
        self.rows = np.zeros((1024, scores.shape[1] + 1))

    def __missing__(self, word: str) -> int:
        found = np.array(subwords(word), np.int64)
        k = len(self)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k, :-1] = self.scores[found].sum(axis=0)
        self.rows[k, -1] = len(found)
        self[word] = k
        return k


def fit_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Train on at most ``sample_rows`` rows of ``docs``: those with a label, an id and the least hashed ids."""
    keyed = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    h = F.xxhash64(F.lit(11), F.col(id_col).cast("string"))
    least = keyed.select(h.alias("h")).distinct().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if least is None:
        return None
    sample = keyed.where(h <= least).select(F.col(lang_col).cast("string").alias("lang"), h.alias("h"), F.col(text_col).alias("text")).where("text is not null")
    table = arrow_map(sample, featurised, "lang string, h long, buckets array<short>, counts array<float>").limit(sample_rows).toArrow()
    # Views of the Arrow buffers, batch by batch: numbers are neither copied nor made Python objects.
    rows = []
    for batch in table.to_batches():
        buckets, counts = batch.column("buckets"), batch.column("counts")
        at, ids, values = buckets.offsets.to_numpy(), buckets.values.to_numpy(), counts.values.to_numpy()
        rows += [(h, lang, ids[a:b], values[a:b]) for h, lang, a, b in zip(batch.column("h").to_pylist(), batch.column("lang").to_pylist(), at, at[1:])]
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    model = train([r[1:] for r in rows])
    del table, rows
    pa.default_memory_pool().release_unused()
    return model


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """``docs`` with ``{prefix}pred``, ``{prefix}score`` and ``{prefix}rejected`` appended."""
    docs = docs.drop(*{f"{prefix}{x}" for x in ("pred", "score", "rejected")} - {text_col})
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else model.__dict__)
    names = [c for c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = None if shared.value is None else Model(**shared.value)
        table = None if fitted is None else WordScores(fitted.scores)
        for batch, texts in pieces(batches, text_col):
            pred, score, rejected = [], [], []
            for text in texts.to_pylist():
                found = letters(text) if fitted is not None else []
                if not found:
                    pred.append(UNKNOWN), score.append(0.0), rejected.append(True)
                    continue
                if len(table) > KEPT_WORDS:
                    table = WordScores(fitted.scores)
                at = list(map(table.__getitem__, found))
                sums = table.rows[at].sum(axis=0)
                p = fitted.probabilities(sums[:-1] / sums[-1] + fitted.bias)
                k = int(p.argmax())
                pred.append(fitted.langs[k]), score.append(float(p[k])), rejected.append(bool(p[k] < fitted.threshold))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, f"{prefix}pred", f"{prefix}score", f"{prefix}rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{fields}, {prefix}pred string, {prefix}score double, {prefix}rejected boolean")


def keep_recognised(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows the model rejects, columns unchanged."""
    return predict(docs, model, text_col, "__lang_").where("not __lang_rejected").select(*docs.columns)


def learning_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(~held_out(F.col(id_col)))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_model(learning_rows(docs))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
