"""Extension: states of recognition jobs as a stream, with timeouts.

Events (job_id, at, seq, kind, confidence) move a job: ``queued`` makes it PENDING, ``started`` a pending one PROCESSING, ``done`` a processing one SUCCESS or LOW_CONFIDENCE, ``failed`` a
pending or processing one FAILED. What doesn't fit is REFUSED and changes nothing; a job that has ended may be queued again. A job that is left waiting or working for longer than ``timeout``
is FAILED at the moment it is due. Out come (job_id, at, status, note), a row for each move.

A job's events wait in its state, those of a batch as one entry, until the watermark has passed them and are then taken in order of (at, seq). So what comes out doesn't depend on how rows fall into batches, as long as none is
later than the watermark; those that are, Spark drops. Only jobs that wait or work have a state, beside events that wait for the watermark.

Cases: times count in milliseconds; an event at the very moment a job is due still counts; a null confidence is low; null or unknown kinds are refused; rows with a null job or time are dropped;
repeated rows are events of their own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hearthspark.operators.household_text import THRESHOLD

EVENT = "job_id bigint, at timestamp, seq bigint, kind string, confidence double"
MOVE = "job_id bigint, at timestamp, status string, note string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Most events of an entry that is written again.
ENTRY = 10_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def moved(status: str | None, kind: str | None, confidence: float | None) -> str | None:
    """The status that an event gives a job; None if it is refused."""
    if kind == "queued":
        return None if status else "PENDING"
    if kind == "started":
        return "PROCESSING" if status == "PENDING" else None
    if kind == "failed":
        return "FAILED" if status else None
    if kind == "done" and status == "PROCESSING":
        return "SUCCESS" if confidence is not None and confidence >= THRESHOLD else "LOW_CONFIDENCE"
    return None


class JobStates(StatefulProcessor):
    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Columns, not rows: each entry of a state costs some tenths of a millisecond.
        self.waiting = handle.getListState("waiting", "at array<bigint>, seq array<bigint>, kind array<string>, confidence array<double>")
        self.job = handle.getValueState("job", "status string, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for block in rows:
            at = block["ms"].tolist()
            if at:
                self.waiting.appendValue((at, block["seq"].tolist(), block["kind"].tolist(), [None if x != x else x for x in block["confidence"].tolist()]))
                first = min(at) if first is None else min(first, *at)
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Takes every event that the watermark has passed; later timers of the same batch find nothing to do."""
        now = timerValues.getCurrentWatermarkInMs()
        events = [e for entry in self.waiting.get() for e in zip(*entry)]
        events.sort(key=lambda e: (e[0], e[1], e[2] or "", e[3] is not None, e[3] or 0.0))
        had = self.job.get()
        status, due = had or (None, None)
        ready = [e for e in events if e[0] < now]
        out = []
        for at, _, kind, confidence in ready:
            if due is not None and due < at:
                out.append((due, "FAILED", "timeout"))
                status = due = None
            new = moved(status, kind, confidence)
            out.append((at, new or "REFUSED", kind))
            if new:
                status, due = (new, at + self.timeout_ms) if new in ("PENDING", "PROCESSING") else (None, None)
        if due is not None and due < now:
            out.append((due, "FAILED", "timeout"))
            status = due = None
        if ready:
            later = events[len(ready) :]
            self.waiting.put([tuple(map(list, zip(*later[i : i + ENTRY]))) for i in range(0, len(later), ENTRY)]) if later else self.waiting.clear()
            if later:
                self.handle.registerTimer(later[0][0] + 1)
        if due is not None:
            self.job.update((status, due))
            self.handle.registerTimer(due + 1)
        elif had:
            self.job.clear()
        if out:
            at, said, note = zip(*out)
            yield pd.DataFrame({"job_id": [key[0]] * len(out), "ms": at, "status": said, "note": note})

    def close(self) -> None:
        pass


def job_moves(events: DataFrame, timeout_minutes: int, watermark: str = "1 hour") -> DataFrame:
    """MOVE rows of a stream of EVENT rows."""
    rows = events.select("job_id", "at", F.coalesce("seq", F.lit(0)).alias("seq"), "kind", "confidence", F.unix_millis("at").alias("ms")).filter("job_id is not null and at is not null")
    # The process that prepares a stateful query on the driver doesn't see files that were sent to the workers, so the processor goes there as a whole and not by its module's name.
    here = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(here)
    try:
        out = rows.withWatermark("at", watermark).groupBy("job_id").transformWithStateInPandas(JobStates(timeout_minutes * 60_000), "job_id bigint, ms bigint, status string, note string", "Append", "EventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(here)
    return out.select("job_id", F.timestamp_millis("ms").alias("at"), "status", "note")


def run_job_moves(events: DataFrame, out: str, checkpoint: str, timeout_minutes: int, watermark: str = "1 hour") -> StreamingQuery:
    """Starts a query that takes what is there and ends; a batch is written under its number, so one that is repeated replaces its own rows."""
    spark = events.sparkSession
    before = spark.conf.get(_PROVIDER)
    # Such a state needs this store; a query keeps the settings it was started with.
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        return job_moves(events, timeout_minutes, watermark).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
