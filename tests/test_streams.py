"""Job state that outlives a restart and leaves by timers, relayed progress, arriving pictures."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from quirelay.sources import images as I
from quirelay.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrive(folder, name, events):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.tmp", "w") as f:
        for job, seq, minute, kind, payload in events:
            f.write(json.dumps({"job_id": job, "seq": seq, "ts": f"2024-01-01T00:{minute:02d}:00Z", "type": kind, "payload": json.dumps(payload)}) + "\n")
    os.rename(f"{folder}/{name}.tmp", f"{folder}/{name}.json")


def test_jobs_over_a_restart_and_their_leaving(rocks, tmp_path):
    source, mark = f"{tmp_path}/in", f"{tmp_path}/mark"
    seen = []

    def run():
        """One query over what has arrived, from the checkpoint on."""
        states = jobs.job_states(jobs.relayed(jobs.arriving(rocks, source)), "1 minute", silent_s=600, keep_s=300)
        rows = []
        q = states.writeStream.outputMode("update").option("checkpointLocation", mark).foreachBatch(lambda df, _: rows.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        kept = [sum(o.numRowsTotal for o in p.stateOperators) for p in q.recentProgress if p.stateOperators]
        seen.append(kept[-1] if kept else None)
        # The last word on each job.
        return {r["job_id"]: r for r in rows}

    arrive(source, "a", [("j1", 0, 1, "progress", {"current": 1, "total": 4}), ("j2", 0, 1, "progress", {"current": 1}), (None, 1, 1, "progress", {}), ("j3", 0, 1, "progress", {})])
    first = run()
    assert {j: (r["status"], r["current"], r["total"]) for j, r in first.items()} == {"j1": ("running", 1, 4), "j2": ("running", 1, None), "j3": ("running", None, None)}
    # After the restart the state is there: repeated and late numbers are ignored, a result ends the job, and nothing changes it then.
    arrive(source, "b", [("j1", 0, 1, "progress", {"current": 1, "total": 4}), ("j1", 2, 2, "result", {"text": "done"}), ("j1", 3, 2, "error", {"error": "late"}), ("j2", 1, 2, "error", {"error": "bad"})])
    second = run()
    assert (second["j1"]["status"], second["j1"]["result"], second["j1"]["error"], second["j1"]["n_events"], second["j1"]["n_ignored"]) == ("done", "done", None, 2, 2)
    assert (second["j2"]["status"], second["j2"]["error"]) == ("failed", "bad")
    # Twenty minutes on: j3 was silent and expires, the marks of j1 and j2 leave, only j4 is kept.
    arrive(source, "c", [("j4", 0, 22, "progress", {})])
    third = run()
    arrive(source, "d", [("j4", 1, 23, "progress", {})])
    fourth = run()
    gone = third | fourth
    assert gone["j3"]["status"] == "expired" and gone["j4"]["status"] == "running" and gone["j4"]["n_events"] == 2 and "j1" not in gone and "j2" not in gone
    assert seen[-1] is not None and seen[-1] <= seen[0]
    # A number that comes again after the mark has left begins a new job.
    arrive(source, "e", [("j1", 0, 24, "progress", {"current": 2})])
    assert run()["j1"]["status"] == "running"


def test_relay_turns_batches_into_events(rocks, tmp_path):
    out = f"{tmp_path}/events"
    os.makedirs(out)
    rows = []

    def send(row):
        rows.append(row)
        with open(f"{out}/{len(rows)}.json", "w") as f:
            f.write(json.dumps(row))

    relay = jobs.Relay(send)
    rocks.streams.addListener(relay)
    try:
        arrive(f"{tmp_path}/in", "a", [("x", 0, 1, "progress", {})] * 3)
        stream = jobs.arriving(rocks, f"{tmp_path}/in")
        q = stream.writeStream.queryName("reads").format("noop").trigger(availableNow=True).start()
        q.awaitTermination()
        bad = stream.select(F.raise_error(F.lit("broken")).alias("x")).writeStream.queryName("fails").format("noop").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="broken"):
            bad.awaitTermination()
        for _ in range(100):
            if sum(r["type"] != "progress" for r in rows) == 2:
                break
            import time

            time.sleep(0.1)
    finally:
        rocks.streams.removeListener(relay)
    read = jobs.job_state(jobs.relayed(rocks.read.schema("job_id string, seq long, ts timestamp, type string, payload string").json(out)))
    state = {r["job_id"]: (r["ended"], r["last_type"], r["result"]) for r in read.collect()}
    assert state["reads"] == (True, "result", "ended") and state["fails"][:2] == (True, "error")
    assert any(json.loads(r["payload"]).get("rows") == 3 for r in rows)


def test_windowed_counts(rocks, tmp_path):
    arrive(f"{tmp_path}/in", "a", [("x", k, k % 3, "progress", {}) for k in range(6)])
    arrive(f"{tmp_path}/in", "b", [("x", 9, 30, "progress", {})])
    counts = jobs.windowed_counts(jobs.arriving(rocks, f"{tmp_path}/in").withColumn("ts", F.col("ts")), "1 minute", "1 minute")
    got = jobs.run_once(counts, "windows", "complete").collect()
    assert sorted(r["count"] for r in got) == [1, 2, 2, 2]


def test_pictures_from_a_mailbox_are_read_once(rocks, tmp_path):
    """Pictures that arrive are decoded with their sizes; each file goes to the archive after its batch, a restart reads new ones alone, and other files are left."""
    box, archive, mark = f"{tmp_path}/box", f"{tmp_path}/archive", f"{tmp_path}/mark"
    os.makedirs(box)
    rng = np.random.default_rng(4)
    pictures = {f"p{k}": rng.integers(0, 255, (2 + k, 3, 4), dtype=np.uint8) for k in range(3)}
    for a in pictures.values():
        a[..., 3] = 255

    def put(name):
        a = pictures[name]
        with open(f"{box}/{name}.png", "wb") as f:
            f.write(I.encode_png(a.tobytes(), a.shape[1], a.shape[0]))

    def run():
        rows = []
        stream = I.decoded_content(I.arriving(rocks, box, once=True, archive=archive))
        q = stream.writeStream.option("checkpointLocation", mark).foreachBatch(lambda df, _: rows.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        return {os.path.basename(r["path"]).split(".")[0]: r for r in rows}

    put("p0")
    with open(f"{box}/broken.png", "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\nno")
    with open(f"{box}/notes.txt", "w") as f:
        f.write("x")
    first = run()
    assert set(first) == {"p0", "broken"} and bytes(first["p0"]["content"]) == pictures["p0"].tobytes() and (first["p0"]["width"], first["p0"]["height"]) == (3, 2)
    assert first["broken"]["content"] is None and first["broken"]["error"]
    put("p1")
    put("p2")
    second = run()
    assert set(second) == {"p1", "p2"} and bytes(second["p2"]["content"]) == pictures["p2"].tobytes() and second["p1"]["error"] is None
    run()
    assert "p0.png" not in os.listdir(box) and "notes.txt" in os.listdir(box)
