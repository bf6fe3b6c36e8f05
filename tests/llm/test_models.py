"""Language ID and toxicity on generated texts: held-out accuracy, rejection, misspellings, quotation."""

import random

import pytest
from pyspark.sql import functions as F
from quirelay.llm import langid, toxicity
from quirelay.llm.util import held_out

SYLLABLES = {"aa": "ka mo ti lu ne sa ro".split(), "bb": "sch ber gen ung ich auf".split(), "cc": "eau oux ment que tion ré".split()}


def sentence(rng, lang, n=20):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(2, 30)), lang, "x") for i in range(600)]
    rows += [(1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "123 --- 456", "aa", "x"), (None, sentence(rng, "bb"), None, "x"), (5, rows[5][1], rows[5][2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").repartition(3)
    model = langid.fit_model(langid.learning_rows(docs))
    got = langid.predict(docs, model).withColumn("h", held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    test = [r for r in got if r["h"] and r["text"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert sum(r["lang_pred"] == r["lang"] for r in test) / len(test) > 0.97
    for r in got:
        assert 0 <= r["lang_score"] <= 1
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["lang_score"], r["lang_rejected"]) == ("und", 0.0, True)
    kept = langid.keep_recognised(docs, model)
    assert kept.columns == docs.columns and set(langid.predict(docs, model).columns) == {*docs.columns, "lang_score", "lang_rejected"} and kept.count() >= 0.98 * 600
    assert langid.predict(docs, None).where("lang_pred != 'und'").count() == 0
    assert langid.fit_model(docs.limit(0)) is None


def test_rejection_and_the_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, sentence(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(8, 30)), lang) for i in range(600)]
    foreign = [" ".join("".join(rng.choice("бгджзклмнпрст") for _ in range(5)) for _ in range(20)) for _ in range(40)]
    rows += [(2000 + i, x, None) for i, x in enumerate(foreign)] + [(3000, "½ ² Ⅷ ①", None), (3001, sentence(rng, "bb", 30_000), None), (3002, None, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    model = langid.fit_model(langid.learning_rows(docs))
    assert model.junk_rejected > 0.9 and model.false_rejected <= 2 * langid.FALSE_REJECTIONS
    got = {r["doc_id"]: r for r in langid.op2_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and {"doc_id", "held_out", "lang_pred", "score"} <= set(got[0].asDict())
    assert sum(got[2000 + i]["rejected"] for i in range(40)) >= 36 and sum(got[i]["rejected"] for i in range(600)) <= 12
    assert (got[3000]["lang_pred"], got[3000]["score"]) == ("und", 0.0) and got[3001]["lang_pred"] == "bb" and got[3002]["lang_pred"] == "und"
    assert langid.predict(docs.limit(0), model).count() == 0


def test_near_terms():
    t = toxicity.Trie([("idiot", False), ("worthless", False), ("gram", True)])
    edits = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in "xoi" for k in (0, 1)} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
    for term in ("idiot", "worthless"):
        for w in edits(term) | {term}:
            assert t.near(w) == {term}, w
    for w in ("idt", "xxiot", "worthlexx", "idiotic", "grom", "", "i"):
        assert not t.near(w), w
    assert t.exact("grammar") and not t.exact("gra") and t.weight("1d1ot") == toxicity.FUZZY and t.weight("id*iot") == toxicity.FUZZY


def test_long_and_glued_words():
    t = toxicity.Trie([("idiot", False), ("gram", True), ("w" * 80, False)])
    w = toxicity.Weights(t)
    assert w["gram" + "x" * 100] == 1.0 and w["w" * 80] == 1.0 and w["w" * 79] == toxicity.FUZZY and w["w" * 78] == 0.0
    assert w["hello!" * 20 + "idiot"] == 1.0 and w["hello!idiot$you"] == 1.0 and w["idiot!idiot"] == 2.0 and w["hello!idiat"] == toxicity.FUZZY
    assert w["hello!you"] == 0.0 and w["x" * 100] == 0.0 and w["id*iot"] == toxicity.FUZZY


def test_misspellings_by_odds(spark):
    """One clean text with a misspelling of "blorgon" doesn't outweigh many toxic ones; "dummy" has clean neighbours."""
    rows = [(f"toxic {i} blorgom ka", 1) for i in range(60)] + [(f"clean {i} mo dumm", 0) for i in range(60)] + [("quoted blorgom", 0), *[(f"ti {i}", 0) for i in range(100)]]
    sample = spark.createDataFrame(rows, "text string, toxic int")
    assert toxicity.without_misspellings(sample, [("blorgon", False), ("dummy", False)]) == {"dummy"}


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(2)
    bad = ["blorgon", "snizzle"]
    rows, labels = [], []
    for i in range(700):
        words = sentence(rng, "aa", 25).split()
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    extra = {1000: "ka mo blorgom ti snizzel ka blorgn", 1001: 'ka mo said "blorgon" ti', 1002: None, 1003: "", 1004: "blorgon snizzle blorgon", 1005: "b" * 100000}
    rows += list(extra.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame([*labels, (1, None), (2, 7)], "doc_id long, toxic int").where(~held_out(F.col("doc_id")))
    got = {r["id"]: r for r in toxicity.score_texts(docs, train).collect()}
    return got, dict(labels)


def test_toxicity(scored):
    got, labels = scored
    assert all((got[i]["score"] >= 0.5) == bool(t) for i, t in labels.items())
    assert got[1000]["score"] >= 0.5 and got[1004]["score"] >= 0.5
    assert got[1001]["score"] < 0.5 and got[1001]["quotation"] > 0 and got[1001]["abuse"] == 0
    assert all(got[i]["score"] < 0.5 for i in (1002, 1003, 1005))


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    got = toxicity.score_texts(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [r["score"] for r in got] == [0.0, 0.0]


def test_toxicity_query(spark, tmp_path):
    rng = random.Random(6)
    texts = [sentence(rng, "aa", 20) + (" blorgon snizzle " + sentence(rng, "aa", 3) if i % 3 == 0 else "") for i in range(300)]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(0, texts[0], "k"), (900, None, "k")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op1_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held)
    assert toxicity.score_texts(spark.createDataFrame([], "doc_id long, text string"), spark.read.parquet(f"{tmp_path}/labels.parquet")).count() == 0
