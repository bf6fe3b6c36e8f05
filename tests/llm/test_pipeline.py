"""The corpus pipeline on planted cases, stage by stage."""

import random

import corpus_pipeline as P


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    syllables = {"en": "the and ing er th on".split(), "de": "sch und ber ich ung en".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(2, 5))) + str(rng.randrange(99)) * (rng.random() < 0.3) for _ in range(n))
    rows = [(i, text(lang := rng.choice(["en", "de"]), 60), lang, f"s{i % 3}") for i in range(300)]
    passage = text("en", 60)
    item = text("en", 40)
    base = text("en", 200).split()
    near = list(base)
    near[50] = "changed"
    planted = {
        400: rows[3][1], 401: text("en", 30) + "\n" + passage, 402: text("en", 30) + "\n" + passage, 403: item + " " + text("en", 20), 404: " ".join(base), 405: " ".join(near), 406: "12 34", 407: None,
    }
    rows += [(i, t, "en", "s0") for i, t in planted.items()]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        new = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < len(P.STAGES) - 1:
            assert new.columns == docs.columns, name
        docs = new
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = set(range(300))
    ids = {k: set(v) for k, v in seen.items()}
    assert not {406, 407} & ids["language_id"] and len(clean - ids["language_id"]) <= 2
    assert 400 not in ids["line_dedup"] and passage in seen["line_dedup"][401]["text"] and passage not in seen["line_dedup"][402]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"].values())
    assert 404 in ids["near_dedup"] and 405 not in ids["near_dedup"]
    assert ids["near_dedup"] - ids["decontamination"] == {403}
    assert ids["bpe_encoding"] == ids["decontamination"] and all(r["n_tokens"] > 0 for r in seen["bpe_encoding"].values())
    assert clean & ids["language_id"] <= ids["bpe_encoding"]
