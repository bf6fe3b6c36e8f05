"""Round trips, shared chunks, and the defined cases."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from quirelay.llm import media as M


def test_cuts_follow_content():
    rng = random.Random(1)
    body = bytes(rng.randrange(256) for _ in range(60000))
    a, b = M.cut(body), M.cut(b"an opening" + body)
    assert b"".join(a) == body and len(set(a) & set(b)) >= len(a) - 2
    assert all(len(c) <= M.MOST for c in M.cut(b"a" * 100000)) and M.cut(b"x" * 10) == [b"x" * 10]
    assert all(len(c) >= M.LEAST for c in a[:-1])


def test_record():
    chunks = [b"one" * 100, b"two", b"one" * 100]
    stored = M.record([(M.digest_of(c), len(c), None if c == b"two" else zlib.compress(c, 6)) for c in chunks])
    assert M.read_record(stored, {M.digest_of(b"two"): zlib.compress(b"two")}) == (b"".join(chunks), [300, 3, 300])
    for wrong in (stored[:-1], b"XXXX" + stored[4:], stored + b"x"):
        with pytest.raises((ValueError, zlib.error)):
            M.read_record(wrong, {M.digest_of(b"two"): zlib.compress(b"two")})
    with pytest.raises(ValueError):
        M.read_record(stored, {M.digest_of(b"two"): zlib.compress(b"too")})


def test_rows(tmp_path, spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefé ") for _ in range(6)) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(3000))
    texts = [None, "", "a", "é" * 96, long, long, long + " end", "start " + long, "x" * 192, "x" * 193, " ".join(rng.choice(words) for _ in range(2000))]
    rows = [(i, t, "k", b"z") for i, t in enumerate(texts)] + [(2, "a", "k", b"z"), (None, long, "k", b"z")]
    spark.createDataFrame(rows, "doc_id long, text string, key string, parts binary").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = M.op8_media(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        text = long if r["doc_id"] is None else texts[r["doc_id"]]
        raw = (text or "").encode()
        want = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert seen.setdefault(text or "", (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
    store = M.store_texts(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    kept = store.collect()
    assert sum(not r["alone"] for r in kept) >= 4 and M.read_back(store.limit(0)).count() == 0
    # What is reported is what is stored: the record's own bytes, and one body for each shared chunk that differs from none.
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all((by_id[r["id"]]["media_bytes"], by_id[r["id"]]["media_sha256"]) == (len(r["record"]), hashlib.sha256(r["record"]).hexdigest()) for r in kept if r["id"] is not None)
    bodies = {b["digest"]: b["body"] for r in kept for b in r["bodies"]}
    counts = Counter(d for r in kept for d in {d for _, _, d in M.listed_chunks(r["record"])})
    assert {d for d, n in counts.items() if n > 1} <= set(bodies)
    for r in kept:
        text = long if r["id"] is None else texts[r["id"]]
        assert M.read_record(r["record"], bodies)[0] == M.padded(text or "")


def test_empty_table(tmp_path, spark):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert M.op8_media(spark, str(tmp_path)).count() == 0
