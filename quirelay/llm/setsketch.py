"""Near-duplicate documents by SetSketch registers.

A document's set are its distinct word shingles. Register ``i`` of its sketch is the truncated, exponentially
spaced minimum ``K_i = floor(1 - log_b(min h_i))`` over the set: sketches of parts merge by maximum, and two
registers agree with a probability that grows with the Jaccard similarity J. The steps:

1. every text is sketched (numpy on Arrow bytes, whole texts); documents with equal sets are one class,
   found by a 128-bit digest with map-side minima, so copies are never paired;
2. classes that agree in all registers of a band share a bucket. Each class is linked to the bucket leader
   it meets in most bands, and the link is confirmed on the full sets; components of these links are labels;
3. in buckets that still hold several labels, registers of all cross-label pairs are compared in blocks
   inside the workers (no pair is a row). A pair stays if the joint likelihood of "equal, larger, smaller"
   registers, the set sizes being known, doesn't rule out the wanted similarity; what leaves the worker is
   one row for each class that takes part in such a pair, never the pairs;
4. the sets of these classes come together by bucket block, all cross-label pairs are counted exactly, and
   at most a spanning forest of the links is returned.

A bucket of any size is handled: it is cut into blocks of about ``BLOCK`` classes and pairs of blocks are
compared in different tasks; before sets are loaded, pairs of blocks are cut again so that a group has about ``SET_BYTES``. No bucket, pair
or candidate is dropped. Only a pair that meets in no band can be missed. Bands have as many registers as ``percent``
allows (:func:`band_layout`), and all registers are dealt into them evenly; some stand in two bands, so bands aren't independent. By simulation
at 80 %, 3 of 6,000,000 pairs at J = 0.80 are missed, and none of 6,000,000 at 0.82.

Defined cases: null texts and texts without words have an empty set, no links and are kept; fewer words
than a shingle make one shingle; equal rows and rows with equal ids share id and component; of several sets under one
id, the least (size, digest) alone stands for all its rows; null ids are
scored, never linked, and are their own (null) component; ids that aren't whole numbers are ordered as text and
compared through a number each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowio import arrow_map, pieces
from .components import LINK_BYTES, components
from .shingles import mix, shingle_sets
from .util import FILE_BYTES, drop_durable, durable, read

REGISTERS, BANDS, BLOCK, SET_BYTES = 128, 48, 1024, 64 << 20
#: Bytes of a sketch with its digest, of a row in a band and of a hash in the sets that a step reads and writes, about.
SKETCH_BYTES, BAND_BYTES, HASH_BYTES = 320, 48, 16
#: Pairs of classes compared by one task, about.
TASK_PAIRS = 100_000_000
LOG_B = np.log(1.001)
TOP = 65534
_rng = np.random.default_rng(77)
FACTORS = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GRID = np.linspace(0.02, 0.995, 40)
#: A pair is ruled out if its likelihood at the wanted similarity is exp(-SLACK) of the best (5 sigma).
SLACK = 12.5


def band_layout(percent: int) -> np.ndarray:
    """(BANDS, registers of a band): as many registers as keep a pair at ``percent`` together in some band but for 1e-7 (as if bands were independent), all registers dealt evenly."""
    j = percent / 100
    size = max(r for r in range(1, 9) if r == 1 or (1 - j**r) ** BANDS <= 1e-7)
    rng, pool, out = np.random.default_rng(size), [], []
    while len(out) < BANDS:
        band: list[int] = []
        while len(band) < size:
            at = next((k for k, x in enumerate(pool) if x not in band), None)
            if at is None:
                pool += rng.permutation(REGISTERS).tolist()
            else:
                band.append(pool.pop(at))
        out.append(sorted(band))
    return np.array(out)


def least_equal(percent: int) -> int:
    """Registers that a pair at ``percent`` shares but for 8 sigma."""
    j = percent / 100
    return max(0, int(REGISTERS * j - 8 * np.sqrt(REGISTERS * j * (1 - j))))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 registers, one row for each nonempty set (0 for an empty one)."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[i] for i in full])
        at = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
        low = np.empty((len(full), REGISTERS), np.uint64)
        for j in range(REGISTERS):
            low[:, j] = np.minimum.reduceat(values * FACTORS[j], at)
        h = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64)
        out[full] = np.clip(np.floor(1 - np.log(np.maximum(h, 1e-300)) / LOG_B), 0, TOP).astype(np.uint16)
    return out


def band_keys(registers: np.ndarray, layout: np.ndarray) -> np.ndarray:
    """(rows, BANDS) 64-bit keys."""
    weights = mix(np.arange(1, layout.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    picked = registers[:, layout].astype(np.uint64)
    keys = mix((picked * weights).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def plausible(equal: np.ndarray, larger: np.ndarray, n1: np.ndarray, n2: np.ndarray, wanted: float) -> np.ndarray:
    """Whether the joint likelihood of the register comparison allows a similarity of ``wanted`` or more."""
    smaller = REGISTERS - equal - larger
    s = (n1 / (n1 + n2)).astype(np.float32)

    def likelihood(j: float) -> np.ndarray:
        p1, p2 = np.maximum(s * (1 + j) - j, 1e-3), np.maximum((1 - s) * (1 + j) - j, 1e-3)
        return equal * np.log(j) + larger * np.log(p1) + smaller * np.log(p2)

    best = likelihood(GRID[0])
    for j in GRID[1:]:
        best = np.maximum(best, likelihood(j))
    above = likelihood(wanted)
    for j in GRID[GRID > wanted]:
        above = np.maximum(above, likelihood(j))
    return above >= best - SLACK


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted stream."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in key]
        change = np.zeros(len(table), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), len(table)]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        for a, b in zip(starts[:-1], starts[1:-1] + [None]):
            part = table.slice(a) if b is None else table.slice(a, b - a)
            if b is None:
                held.append(part)
            else:
                yield pa.concat_tables([*held, part]).combine_chunks() if held else part
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _hashes(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a binary column as views of its buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return []
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return [data[a:b].view(np.uint64) for a, b in zip(at[:-1], at[1:])]


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the left and of the right block of a pair of blocks (equal for a block with itself)."""
    block, i, j = table["block"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
    return np.flatnonzero(block == i), np.flatnonzero(block == j)


def _taking_part(percent: int):
    """Rows of a block pair whose registers leave some cross-label pair plausible."""
    layout, least = band_layout(percent), least_equal(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["key", "i", "j"]):
            left, right = _sides(t)
            label, n, band = t["label"].to_numpy(), t["n"].to_numpy(), t["band"][0].as_py()
            regs = np.frombuffer(b"".join(t["regs"].to_pylist()), np.uint16).reshape(len(t), REGISTERS)
            keys = band_keys(regs, layout)
            used = np.zeros(len(t), bool)
            other, m = regs[right], n[right]
            for a in left:
                ok = (label[right] != label[a]) & (100 * np.minimum(m, n[a]) >= percent * np.maximum(m, n[a]))
                if not ok.any():
                    continue
                at = np.flatnonzero(ok)
                equal = (other[at] == regs[a]).sum(axis=1)
                at, equal = at[equal >= least], equal[equal >= least]
                if not len(at):
                    continue
                # Only in the first band that the two share is a pair looked at.
                first = (keys[right[at]] == keys[a]).argmax(axis=1) == band
                at, equal = at[first], equal[first]
                if len(at):
                    larger = (regs[a] > other[at]).sum(axis=1)
                    at = at[plausible(equal, larger, np.full(len(at), n[a]), m[at], percent / 100)]
                    used[right[at]] = True
                    used[a] |= bool(len(at))
            keep = np.flatnonzero(used)
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy()[keep]) for c in ("key", "i", "j", "block", "rep", "label")], names=["key", "i", "j", "block", "rep", "label"])

    return run


def _spanning(percent: int):
    """Exact links between labels inside a pair of blocks, at most a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["key", "i", "j", "x", "y"]):
            left, right = _sides(t)
            if not len(left) or not len(right):
                continue
            label, rep = t["label"].to_numpy(), t["rep"].to_numpy()
            sets = _hashes(t["set"])
            sizes = np.array([len(s) for s in sets])
            values, codes = np.unique(np.concatenate(sets), return_inverse=True)
            parts = np.split(codes, np.cumsum(sizes)[:-1])
            flags = np.zeros(len(values), np.int32)
            wide = np.concatenate([parts[r] for r in right])
            at = np.concatenate(([0], np.cumsum(sizes[right])[:-1]))
            parent = {x: x for x in label.tolist()}

            def root(x: int, parent: dict = parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            links = []
            for a in left:
                flags[parts[a]] = 1
                both = np.add.reduceat(flags[wide], at)
                flags[parts[a]] = 0
                hit = np.flatnonzero((100 * both >= percent * (sizes[right] + sizes[a] - both)) & (label[right] != label[a]))
                for b in right[hit].tolist():
                    x, y = root(int(label[a])), root(int(label[b]))
                    if x != y:
                        parent[x] = y
                        links.append((int(rep[a]), int(rep[b])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return run


def _block_pairs(rows: DataFrame, size: int) -> DataFrame:
    """Each row once for every pair of blocks that its block is in; ``members`` is the bucket's size."""
    n = F.ceil(F.col("members") / size).cast("int")
    block = F.pmod(F.xxhash64("rep"), n).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")


def _cut_by_bytes(rows: DataFrame, limit: int) -> DataFrame:
    """Groups (key, i, j) whose sets (``n`` hashes of 8 bytes) exceed ``limit`` become groups (key, i, j, x, y) that hold every pair of their rows."""
    totals = rows.groupBy("key", "i", "j").agg(F.ceil(F.sum("n") * 16 / limit).cast("int").alias("parts"))
    rows = rows.join(totals, ["key", "i", "j"]).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(1)), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("own", "other", "parts", "n")


def _streamed(rows: DataFrame, key: list[str], tasks: int, run, schema: str) -> DataFrame:
    return arrow_map(rows.repartition(tasks, *key).sortWithinPartitions(*key), run, schema)


def _tasks(spark, pairs: int | None) -> int:
    """Tasks by counted work; adaptive execution would merge them by bytes, of which there are few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), (pairs or 0) // TASK_PAIRS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of ``docs``: id, n_shingles, class (least id with the same set), component (least id reachable)."""
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return _by_number(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), shingle, percent)
    named = docs.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    # Numbers rise with the sorted names, which are written, so that they stay.
    numbers = durable(named.select("name").where("name is not null").distinct().sort("name").withColumn("id", F.monotonically_increasing_id()), "numbers")
    found = durable(_by_number(named.join(numbers, "name", "left").select("id", "text"), shingle, percent), "numbered")
    of = lambda what: numbers.select(F.col("id").alias(what), F.col("name").alias(f"{what}_name"))
    out = found.join(of("id"), "id", "left").join(of("class"), "class", "left").join(of("component"), "component", "left")
    return out.select(F.col("id_name").alias("id"), "n_shingles", F.col("class_name").alias("class"), F.col("component_name").alias("component"))


def _by_number(slim: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``near_duplicates`` for (id long, text)."""
    spark, layout = slim.sparkSession, band_layout(percent)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", 1 << 20):
            sets = shingle_sets(texts, shingle)
            regs = sketch(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["id", "n", "digest", "regs"],
            )

    sketches = durable(arrow_map(slim, sketched, "id long, n long, digest binary, regs binary"), "sketches")
    rows, hashes = sketches.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    of_sketches, of_bands, of_sets = rows * SKETCH_BYTES, rows * BANDS * BAND_BYTES, hashes * HASH_BYTES
    alive = sketches.where("n > 0 and id is not null")
    # Ids with several sets: the least one stands for the id.
    torn = alive.groupBy("id").agg(F.min(F.struct("n", "digest")).alias("least"), F.max(F.struct("n", "digest")).alias("most")).where("least != most")
    torn = durable(torn.select(F.col("id").alias("tid"), F.col("least.n").alias("tn"), F.col("least.digest").alias("td")), "torn", of_sketches)
    standing = sketches.join(torn, sketches["id"] == torn["tid"], "left").withColumns({"cn": F.coalesce("tn", "n"), "cd": F.coalesce("td", "digest")}).select("id", "n", "digest", "regs", "cn", "cd")
    classes = durable(standing.where("n > 0 and id is not null and n = cn and digest = cd").groupBy("cn", "cd").agg(F.min("id").alias("rep")), "classes", of_sketches)
    named = standing.join(classes, ["cn", "cd"], "left")
    reps = durable(named.where("id = rep and n = cn and digest = cd").select("rep", "n", "digest", "regs").dropDuplicates(["rep"]), "reps", of_sketches)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = band_keys(np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(len(batch), REGISTERS), layout)
                for k in range(BANDS):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, k]), pa.array(np.full(len(batch), k, np.int32)), batch.column("rep")], names=["key", "band", "rep"])

    in_bands = arrow_map(reps.select("rep", "regs"), banded, "key long, band int, rep long")
    buckets = durable(in_bands.groupBy("key", "band").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep"))["rep"].alias("leader")).where("members > 1"), "buckets", of_bands)
    met = durable(in_bands.join(buckets, ["key", "band"]), "met", of_bands)
    best = met.where("rep != leader").groupBy("rep", "leader").count().groupBy("rep").agg(F.max(F.struct("count", "leader"))["leader"].alias("leader"))
    pairs = durable(best, "pairs", of_bands)
    wanted = met.select("rep").distinct().join(reps.select("rep", "digest"), "rep")

    def as_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", 1 << 20):
            found = [s.tobytes() for s in shingle_sets(texts, shingle)]
            keep = pa.array([hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(found, batch.column("digest").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("rep").filter(keep), pa.array(found, pa.binary()).filter(keep)], names=["rep", "set"])

    # A repeated row stands once, and of the texts under one id the one whose set stands for the id.
    texts = slim.join(wanted, slim["id"] == wanted["rep"]).select("rep", "digest", "text", F.xxhash64("text").alias("th")).dropDuplicates(["rep", "th"]).drop("th")
    sets = durable(arrow_map(texts, as_set, "rep long, set binary"), "sets", of_sets)

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(_hashes(batch.column("set")), _hashes(batch.column("leader_set"))):
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("rep").filter(keep), batch.column("leader").filter(keep)], names=["a", "b"])

    both = pairs.join(sets, "rep").join(sets.select(F.col("rep").alias("leader"), F.col("set").alias("leader_set")), "leader")
    links = durable(arrow_map(both.select("rep", "leader", "set", "leader_set"), confirmed, "a long, b long"), "confirmed", of_sets)
    labels = durable(components(links), "labels", links.count() * LINK_BYTES)

    labelled = met.join(labels, met["rep"] == labels["vertex"], "left").select("key", "band", "rep", "members", F.coalesce("component", "rep").alias("label"))
    of_met = met.count() * BAND_BYTES
    labelled = durable(labelled, "labelled", of_met)
    mixed = durable(
        labelled.groupBy("key", "band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.first("members").alias("members")).where("x != y").select("key", "band", "members"), "mixed", of_met
    )
    compared = mixed.agg(F.sum(F.col("members") * F.col("members"))).first()[0]
    tasks, of_pairs = _tasks(spark, compared), (compared or 0) // TASK_PAIRS * FILE_BYTES
    rest = labelled.join(mixed.select("key", "band"), ["key", "band"]).join(reps.select("rep", "n", "regs"), "rep")
    block = ["key", "i", "j"]
    part = durable(_streamed(_block_pairs(rest, BLOCK), block, tasks, _taking_part(percent), "key long, i int, j int, block int, rep long, label long"), "taking-part", max(of_bands, of_pairs))
    loaded = _cut_by_bytes(part.join(reps.select("rep", "n"), "rep"), SET_BYTES).join(sets, "rep")
    more = durable(_streamed(loaded, [*block, "x", "y"], tasks, _spanning(percent), "a long, b long"), "more-links", max(part.count() * SET_BYTES // BLOCK, of_pairs))
    linked = links.union(more)
    final = durable(components(linked), "components", linked.count() * LINK_BYTES)
    for done in (reps, buckets, met, pairs, sets, links, labels, labelled, mixed, part, more):
        drop_durable(spark, done)
    own = F.col("id").isNotNull()
    found = named.join(final, named["rep"] == final["vertex"], "left")
    return found.select("id", F.col("n").alias("n_shingles"), F.when(own, F.coalesce("rep", "id")).alias("class"), F.when(own, F.coalesce("component", "rep", "id")).alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the first document of each group alone, all columns kept; null ids stay."""
    drop = near_duplicates(docs, id_col, text_col, shingle, percent).where("id != component").select(F.col("id").alias("__drop")).distinct()
    return docs.join(drop, docs[id_col] == drop["__drop"], "left_anti")


def op4_setsketch(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
