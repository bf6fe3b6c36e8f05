"""Chunks and their cache, stores that survive a failure, and sinks that write a batch once."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from quirelay.schemas import RULES
from quirelay.sources import chunks as C
from quirelay.sources import dims, sinks, stores


def files(spark):
    rng = random.Random(2)
    return {f"f{n}": bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 9, 10, 11, 95)}


def table(spark, content):
    return spark.createDataFrame(list(content.items()), "name string, content binary")


def test_chunks_and_progress(spark):
    content = files(spark)
    got = C.chunked(table(spark, content), 10).collect()
    for name, body in content.items():
        mine = sorted((r for r in got if r["name"] == name), key=lambda r: r["pos"])
        parts = [body[i : i + 10] for i in range(0, len(body), 10)] or [b""]
        assert [(bytes(r["body"]), r["n_chunks"], r["n_bytes"], r["digest"]) for r in mine] == [(p, len(parts), len(body), hashlib.md5(p).hexdigest()) for p in parts]
    seen = {(r["name"], r["pos"]): (r["loaded"], r["total"], r["pct"]) for r in C.progress(C.chunked(table(spark, content), 10)).collect()}
    assert seen["f95", 0] == (10, 95, 11) and seen["f95", 9] == (95, 95, 100) and seen["f0", 0] == (0, 0, None)


def test_assembly_mends_and_reports(spark):
    content = files(spark)
    rows = [tuple(r) for r in C.chunked(table(spark, content), 10).collect()]
    random.Random(1).shuffle(rows)
    rows += [r for r in rows if r[0] == "f11"]  # each twice
    bad = lambda r: (*r[:4], b"x" * len(r[4]), r[5])
    rows = [r for r in rows if (r[0], r[1]) != ("f95", 4)]  # one is missing
    rows = [bad(r) if r[0] == "f9" else r for r in rows] + [bad(r) for r in rows if r[0] == "f10"]  # one is corrupt, one has a good copy too
    got = {r["name"]: r for r in C.assembled(spark.createDataFrame(rows, C.KIND).repartition(4)).collect()}
    assert {n: r["status"] for n, r in got.items()} == {"f0": "ok", "f1": "ok", "f9": "corrupt", "f10": "ok", "f11": "ok", "f95": "missing"}
    assert all(bytes(got[n]["content"]) == content[n] and got[n]["digest"] == hashlib.md5(content[n]).hexdigest() for n in ("f0", "f1", "f10", "f11"))
    assert got["f9"]["content"] is None and got["f95"]["digest"] is None


def test_fetch_asks_the_cache_first(spark, tmp_path):
    content, asked, path = files(spark), [], f"{tmp_path}/cache"
    whole = C.chunked(table(spark, content), 10)

    def source(skip=("f95", 3)):
        asked.append(1)
        return whole.where(~((F.col("name") == skip[0]) & (F.col("pos") == skip[1])))

    want = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = {r["name"]: (r["origin"], r["error"]) for r in C.fetch(want("f9", "f11", "f11", "f95", "nowhere"), source, path).collect()}
    assert got == {"f9": ("source", None), "f11": ("source", None), "f95": (None, "missing"), "nowhere": (None, "unknown")}

    def never():
        raise AssertionError("the source was read")

    rows = C.fetch(want("f11", "f9"), never, path).collect()
    assert {r["name"]: (bytes(r["content"]), r["origin"]) for r in rows} == {n: (content[n], "cache") for n in ("f9", "f11")}
    again = {r["name"]: (bytes(r["content"]), r["origin"]) for r in C.fetch(want("f9", "f95", "f0"), lambda: source(("", 0)), path).collect()}
    assert again == {"f9": (content["f9"], "cache"), "f95": (content["f95"], "source"), "f0": (b"", "source")} and len(asked) == 2


def test_a_save_that_fails_leaves_the_old_list(spark, tmp_path):
    path = f"{tmp_path}/rules"
    stores.save(dims.seed_rules(spark), path)
    before = sorted(stores.rules(spark, path).collect())
    with pytest.raises(Exception, match="broken"):
        stores.save(stores.rules(spark, path).withColumn("name", F.raise_error(F.lit("broken"))), path)
    assert sorted(stores.rules(spark, path).collect()) == before
    # The new list may read the one it replaces.
    stores.save(stores.rules(spark, path).withColumn("enabled", F.lit(True)), path)
    now = stores.rules(spark, path).collect()
    assert len(now) == 4 and all(r["enabled"] for r in now) and [p for p in os.listdir(tmp_path) if ".old" in p] == []
    stores.save(spark.createDataFrame([], RULES), path)
    assert stores.rules(spark, path).count() == 0


def test_settings_are_merged_by_key(spark, tmp_path):
    path = f"{tmp_path}/settings"
    stores.update_settings(spark, path, theme="dark", size=3)
    assert stores.settings(spark, path).first()[0] is True
    stores.update_settings(spark, path, show_result_alert=False, size=4)
    assert stores.settings(spark, path).first()[0] is False
    assert [json.loads(r["value"]) for r in spark.read.text(path).collect()] == [{"theme": "dark", "size": 4, "show_result_alert": False}]
    stores.update_settings(spark, path, show_result_alert=True)
    assert stores.settings(spark, path).first()[0] is True


LINE = "job_id string, page_id long, line_pos int, text string"


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    """The write of the second batch succeeds but its stream dies before the commit; after the restart every line is there once, in order."""
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    os.makedirs(source)

    def arrive(name, rows):
        with open(f"{source}/{name}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("job_id", "page_id", "line_pos", "text"), r))) + "\n" for r in rows)

    stream = lambda: spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).json(source)
    arrive("a", [("j1", 1, 1, "b"), ("j1", 1, 0, "a"), ("j2", 7, 0, None)])
    sinks.stream_to(stream(), out, mark).awaitTermination()
    arrive("b", [("j1", 2, 0, "c"), ("j2", 7, 1, "z")])
    writes = []

    def dies(rows):
        writes.append(rows.count())
        return rows

    query = stream().writeStream.option("checkpointLocation", mark).trigger(availableNow=True)

    def crash(rows, number):
        sinks.write_batch(dies(rows), out, number)
        raise RuntimeError("the executor is gone")

    with pytest.raises(Exception, match="gone"):
        query.foreachBatch(crash).start().awaitTermination()
    sinks.stream_to(stream(), out, mark, dies).awaitTermination()
    assert writes == [2, 2]  # written twice
    kept = sinks.batches(spark, out, LINE)
    assert kept.count() == 5 and {r["batch"] for r in kept.select("batch").distinct().collect()} == {0, 1}
    assert {r["job_id"]: (r["text"], r["n_lines"]) for r in sinks.texts(kept).collect()} == {"j1": ("a\nb\nc", 3), "j2": ("\nz", 2)}
    os.makedirs(f"{out}/batch=9")
    (tmp_path / "out" / "batch=9" / "part-0.json").write_text('{"job_id": "half"}\n')
    assert sinks.batches(spark, out, LINE).count() == 5 and sinks.batches(spark, f"{tmp_path}/none", LINE).count() == 0


def test_notices_and_structured_pages(spark):
    results = spark.createDataFrame([("a", "abc"), ("b", ""), ("c", "𠮷")], "job_id string, text string")
    on, off = (spark.createDataFrame([(x,)], "show_result_alert boolean") for x in (True, False))
    assert {r["job_id"]: r["notice"] for r in stores.notified(results, on).collect()} == {"a": "3 characters copied", "b": "no text found", "c": "1 characters copied"}
    assert {r["notice"] for r in stores.notified(results, off).collect()} == {None}
    pages = spark.createDataFrame([(1, 10, 20), (2, 5, 5)], "page_id long, width int, height int")
    lines = spark.createDataFrame([(1, 1, 0, 0, 5, 5, 0.5, "b"), (1, 0, 0, 0, 5, 5, None, "a")], "page_id long, line_pos int, x int, y int, w int, h int, conf double, text string")
    found = spark.createDataFrame([(1, 3, 1, 0.5, 0, 0, 5, 5)], "page_id long, det_idx int, class_idx int, conf double, x1 int, y1 int, x2 int, y2 int")
    got = {r["page_id"]: r for r in sinks.structured(pages, lines, found).collect()}
    assert [x["text"] for x in got[1]["lines"]] == ["a", "b"] and got[1]["detections"][0]["det_idx"] == 3 and got[1]["height"] == 20
    assert got[2]["lines"] == [] and got[2]["detections"] == []
