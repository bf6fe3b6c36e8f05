"""Small intermediate tables don't become a file for each shuffle partition: each file makes its executor start processes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from quirelay.llm import components, linededup, setsketch


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def files(monkeypatch):
    """Files of each table that is written for later steps."""
    found = []
    for module in (components, linededup, setsketch):

        def durable(df, name="step", *most, real=module.durable):
            out = real(df, name, *most)
            found.append((name, len(out.inputFiles())))
            return out

        monkeypatch.setattr(module, "durable", durable)
    return found


def test_near_duplicates(spark, many_partitions, files):
    rng = random.Random(5)
    rows = []
    for f in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
        for k in range(3):
            text = list(base)
            text[rng.randrange(160)] = f"x{f}-{k}"
            rows.append((3 * f + k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["id"]: r["component"] for r in setsketch.near_duplicates(docs).collect()}
    assert found == {i: i - i % 3 for i, _ in rows}
    small = {f"{k} {name}": n for k, (name, n) in enumerate(files)}
    assert len(small) >= 10 and max(small.values()) <= 2 * spark.sparkContext.defaultParallelism, small


def test_line_dedup(spark, many_partitions, files):
    rng = random.Random(6)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
    shared = [line() for _ in range(150)]
    docs = spark.createDataFrame([(i, f"{line()}\n{shared[i // 2]}") for i in range(300)], "doc_id long, text string")
    found = {r["doc_id"]: r["removed_lines"] for r in linededup.without_shared_blocks(docs).collect()}
    assert found == {i: i % 2 for i in range(300)}
    assert {name for name, _ in files} == {"runs", "shared-runs", "gone-blocks"}
    assert max(n for _, n in files) <= 2 * spark.sparkContext.defaultParallelism, files


def test_sets_are_views():
    sets = [np.arange(n, dtype=np.uint64) for n in (3, 0, 5, 1)]
    column = pa.array([s.tobytes() for s in sets], pa.binary())
    assert [x.tolist() for x in setsketch._hashes(column.slice(1))] == [s.tolist() for s in sets[1:]]
    assert [x.tolist() for x in setsketch._hashes(pa.chunked_array([column, column.slice(2)]))] == [s.tolist() for s in sets + sets[2:]]
    assert setsketch._hashes(column.slice(4)) == []
