"""Job events: relay, state by job, and progress texts, on Structured Streaming.

Events carry a ``job_id`` and a time, so jobs that overlap keep their own state. ``job_states`` keeps the state of jobs that run and, for a
while, the mark of jobs that ended; both leave by timers, so the state doesn't grow with the number of jobs ever seen.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..functions.text import percent, progress_text
from ..schemas import JOB_EVENTS
from ..ship import ship

PAYLOAD = "struct<phase:string,current:long,total:long,lang:string,text:string,error:string>"


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream of event files (JSON lines)."""
    return spark.readStream.schema(JOB_EVENTS).json(path)


def relayed(events: DataFrame) -> DataFrame:
    """Events of running jobs with their payload parsed; warm-up events have no job and go."""
    return events.where(F.col("job_id").isNotNull()).withColumn("p", F.from_json("payload", PAYLOAD)).select("job_id", "seq", "ts", "type", "p.*")


def localised(events: DataFrame, messages: DataFrame) -> DataFrame:
    """Progress texts by language: the catalogue's phrase, else the phase's name."""
    phrase = messages.select(F.col("lang").alias("m_lang"), F.col("key").alias("m_key"), "template")
    # The catalogue is a file of the package: some dozens of rows.
    joined = events.join(F.broadcast(phrase), (F.col("lang") == F.col("m_lang")) & (F.col("phase") == F.col("m_key")), "left")
    text = F.coalesce("template", "phase")
    return joined.select("job_id", "seq", "ts", "type", F.when(F.col("total") > 0, progress_text(text, F.col("current"), F.col("total"))).otherwise(text).alias("message"), percent(F.col("current"), F.col("total")).alias("pct"))


JOB_STATES = "job_id string, status string, last_seq long, last_type string, current long, total long, result string, error string, n_events long, n_ignored long"
#: What is kept of a job: times in milliseconds.
_KEPT = "status string, last_seq long, last_type string, current long, total long, result string, error string, n_events long, n_ignored long, last_ms long, leaves_ms long"


class _Jobs(StatefulProcessor):
    """One job: events in the order of their numbers, until a result or an error."""

    def __init__(self, silent_ms: int, keep_ms: int):
        self.silent_ms, self.keep_ms = silent_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _KEPT)

    def _row(self, key: tuple, kept: dict) -> pd.DataFrame:
        frame = pd.DataFrame([{"job_id": key[0]} | {k: v for k, v in kept.items() if not k.endswith("_ms")}])
        for c in ("last_seq", "current", "total", "n_events", "n_ignored"):
            frame[c] = frame[c].astype("Int64")
        return frame

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        names = [f.split(" ")[0] for f in _KEPT.split(", ")]
        kept = dict(zip(names, now)) if now else dict.fromkeys(names) | {"status": "running", "last_seq": -1, "n_events": 0, "n_ignored": 0, "last_ms": 0}
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for e in events.itertuples():
            if kept["status"] != "running" or e.seq <= kept["last_seq"]:
                kept["n_ignored"] += 1  # after the end, out of order, or met before
                continue
            kept |= {"last_seq": int(e.seq), "last_type": e.type, "n_events": kept["n_events"] + 1, "last_ms": max(kept["last_ms"], int(pd.Timestamp(e.ts).timestamp() * 1000))}
            if e.type == "progress":
                kept |= {n: None if pd.isna(v) else int(v) for n, v in (("current", e.current), ("total", e.total))}
            elif e.type in ("result", "error"):
                kept |= {"status": "done" if e.type == "result" else "failed", "result": e.text if e.type == "result" else None, "error": e.error if e.type == "error" else None}
        # One timer for each job: the old one goes.
        if kept["leaves_ms"] is not None:
            self.handle.deleteTimer(kept["leaves_ms"])
        kept["leaves_ms"] = max(kept["last_ms"], timerValues.getCurrentWatermarkInMs()) + (self.silent_ms if kept["status"] == "running" else self.keep_ms)
        self.handle.registerTimer(kept["leaves_ms"])
        self.state.update(tuple(kept[n] for n in names))
        yield self._row(key, kept)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in _KEPT.split(", ")]
        kept = dict(zip(names, self.state.get()))
        self.state.clear()
        if kept["status"] == "running":
            yield self._row(key, kept | {"status": "expired"})

    def close(self) -> None:
        pass


def job_states(events: DataFrame, late: str = "1 minute", silent_s: int = 600, keep_s: int = 600) -> DataFrame:
    """A row (``JOB_STATES``) for each job that a batch changes; a stream in update mode.

    ``events`` is a stream as :func:`relayed` gives it. A job ends with its result or error; what comes later is counted as
    ignored and changes nothing, for ``keep_s`` seconds of event time. A job without an event for ``silent_s`` seconds is
    'expired'. Times are those of the events, behind a watermark of ``late``. Needs the RocksDB state store. A table is
    read as one batch.
    """
    ship(events.sparkSession)
    events.sparkSession.streams.active  # noqa: B018  starts the coordinator of state stores, which a table's query needs as well
    keyed = events.select("job_id", "seq", "ts", "type", "current", "total", "text", "error").withWatermark("ts", late).groupBy("job_id")
    return keyed.transformWithStateInPandas(_Jobs(1000 * silent_s, 1000 * keep_s), JOB_STATES, "Update", "EventTime")


class Relay(StreamingQueryListener):
    """Turns the progress of streaming queries into job events: ``send`` gets rows of ``JOB_EVENTS``; the job is the query's name or id."""

    def __init__(self, send: Callable[[dict], None]):
        self.send, self.seq, self.names = send, {}, {}

    def _say(self, query: str, ts: str, kind: str, payload: dict) -> None:
        job = self.names.get(query) or query
        self.seq[query] = self.seq.get(query, -1) + 1
        self.send({"job_id": job, "seq": self.seq[query], "ts": ts, "type": kind, "payload": json.dumps(payload)})

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name
        self._say(str(event.id), event.timestamp, "progress", {"phase": "start"})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._say(str(p.id), p.timestamp, "progress", {"phase": "batch", "current": p.batchId + 1, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        now = pd.Timestamp.now("UTC").strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        error = (event.exception or "").splitlines()
        self._say(str(event.id), now, "error" if error else "result", {"error": error[0]} if error else {"text": "ended"})


def job_state(events: DataFrame) -> DataFrame:
    """One row for each job of a table: its last event, whether it has ended, its result or error. For streams see :func:`job_states`."""
    ended = F.col("type").isin("result", "error")
    return events.groupBy("job_id").agg(
        F.max("seq").alias("last_seq"), F.max_by("type", "seq").alias("last_type"), F.max(ended.cast("int")).cast("boolean").alias("ended"), F.max_by("text", F.when(F.col("type") == "result", F.col("seq"))).alias("result"),
        F.max_by("error", F.when(F.col("type") == "error", F.col("seq"))).alias("error"),
    )


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 minute") -> DataFrame:
    """Events by type and time window; state is dropped behind the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "type").count()


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Handle what has arrived and return it as a table (for tests and small results)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


class NotConfigured(RuntimeError):
    pass


class Runner:
    """Configure before running; a second configuration replaces the first; loading is done once for each preset."""

    def __init__(self):
        self.preset, self.loaded, self.loads = None, None, 0

    def configure(self, preset: str) -> None:
        self.preset = preset

    def ensure(self, load):
        if self.preset is None:
            raise NotConfigured("configure() comes first")
        if self.loaded is None or self.loaded[0] != self.preset:
            self.loaded, self.loads = (self.preset, load(self.preset)), self.loads + 1
        return self.loaded[1]
