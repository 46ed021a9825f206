"""Job states as a stream against a plain replay, however the rows fall into batches."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from hearthspark.streaming import jobs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
MINUTE = 60_000


def replay(events, timeout, delay):
    """Every job's events in order, by the rules as the module states them."""
    times = [e[1] for e in events if e[0] is not None and e[1] is not None]
    mark = max(times) - delay if times else 0
    out = []
    for job in {e[0] for e in events if e[0] is not None}:
        status, since = "NONE", None
        own = sorted((e[1], e[2], e[3], e[4]) for e in events if e[0] == job and e[1] is not None and e[1] < mark)
        for at, _, kind, confidence in [*own, (mark, 0, "end", 0.0)]:
            if status in ("PENDING", "PROCESSING") and since + timeout < at:
                out.append((job, since + timeout, "FAILED", "timeout"))
                status = "NONE"
            if kind == "end":
                break
            allowed = {("NONE", "queued"): "PENDING", ("PENDING", "started"): "PROCESSING", ("PENDING", "failed"): "FAILED", ("PROCESSING", "failed"): "FAILED"}
            allowed["PROCESSING", "done"] = "SUCCESS" if confidence >= 70 else "LOW_CONFIDENCE"
            new = allowed.get((status, kind))
            out.append((job, at, new or "REFUSED", kind))
            if new:
                status, since = (new, at) if new in ("PENDING", "PROCESSING") else ("NONE", None)
    return sorted(out)


def stream(spark, root, batches, timeout_minutes, watermark):
    """Runs the query once for each batch of files, from the same checkpoint."""
    for i, batch in enumerate(batches):
        rows = [(j, None if t is None else START + timedelta(milliseconds=t), s, k, x) for j, t, s, k, x in batch]
        spark.createDataFrame(rows, jobs.EVENT).coalesce(1).write.mode("append").parquet(f"{root}/in")
        query = jobs.run_job_moves(spark.readStream.schema(jobs.EVENT).parquet(f"{root}/in"), f"{root}/out", f"{root}/checkpoint", timeout_minutes, watermark)
        query.awaitTermination()
        assert query.exception() is None
    moves = spark.read.schema(jobs.MOVE).parquet(f"{root}/out").select("job_id", F.unix_millis("at").alias("ms"), "status", "note")
    origin = int(START.timestamp() * 1000)
    return sorted((r["job_id"], r["ms"] - origin, r["status"], r["note"]) for r in moves.collect())


def test_batches_dont_matter(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["queued", "queued", "started", "started", "done", "failed"]
    # A third of all events belong to one job; some fall into the same millisecond.
    events = [(0 if rng.random() < 0.3 else rng.randrange(1, 9), rng.randrange(0, 600) * MINUTE, i, rng.choice(kinds), rng.choice([10.0, 70.0, 99.0])) for i in range(240)]
    want = replay(events, 25 * MINUTE, 60 * MINUTE)
    assert {"timeout"} < {m[3] for m in want} and {"SUCCESS", "LOW_CONFIDENCE", "FAILED", "REFUSED", "PENDING", "PROCESSING"} <= {m[2] for m in want}
    # Out of order by less than the watermark's delay.
    late = sorted(events, key=lambda e: e[1] + rng.randrange(0, 59) * MINUTE)
    cuts = [late[i : i + 80] for i in range(0, 240, 80)]
    assert stream(spark, f"file://{tmp_path}/many", cuts, 25, "60 minutes") == want
    assert stream(spark, f"file://{tmp_path}/one", [events], 25, "60 minutes") == want


def test_cases(spark, tmp_path):
    """Nulls, a row at the very moment a job is due, repeated rows, a job left alone, rows later than the watermark."""
    t = 10 * MINUTE
    first = [(1, 0, 0, "queued", None), (1, t, 1, "started", None), (1, 2 * t, 2, "done", None), (2, 0, 0, "queued", None), (2, 0, 0, "queued", None), (2, t + 1, 1, "started", None), (None, 5, 0, "queued", None), (3, None, 0, "queued", None), (4, 3, 0, "odd", 1.0), (9, 100 * t, 0, "queued", None)]
    late = [(1, 1, 9, "queued", None), (9, 200 * t, 1, "queued", None)]
    got = stream(spark, f"file://{tmp_path}/j", [first, late], 10, "10 minutes")
    assert got == [
        (1, 0, "PENDING", "queued"), (1, t, "PROCESSING", "started"), (1, 2 * t, "LOW_CONFIDENCE", "done"), (2, 0, "PENDING", "queued"), (2, 0, "REFUSED", "queued"),
        (2, t, "FAILED", "timeout"), (2, t + 1, "REFUSED", "started"), (4, 3, "REFUSED", "odd"), (9, 100 * t, "PENDING", "queued"), (9, 101 * t, "FAILED", "timeout"),
    ]


def test_the_setting_of_the_store_stays(spark, tmp_path):
    before = spark.conf.get(jobs._PROVIDER)
    assert stream(spark, f"file://{tmp_path}/j", [[]], 1, "1 minute") == [] and spark.conf.get(jobs._PROVIDER) == before


def test_hourly_activity(spark):
    from hearthspark.streaming.ingest import hourly_activity

    at = lambda minutes: START + timedelta(minutes=minutes)
    rows = spark.createDataFrame([(at(0), "a"), (at(59), "a"), (at(60), "a"), (at(61), "b"), (at(61), "b"), (at(300), None), (None, "a")], "ts timestamp, kind string")
    got = hourly_activity(rows, "ts", "kind").select(F.unix_seconds("hour"), "kind", "n").collect()
    base = int(START.timestamp())
    assert sorted(map(tuple, got), key=repr) == sorted([(base, "a", 2), (base + 3600, "a", 1), (base + 3600, "b", 2), (base + 18000, None, 1)], key=repr)


def test_events_of_a_batch_wait_as_one_entry(monkeypatch):
    """A job's state takes an entry for each block of rows, not for each event, and those that are still to come are written again in blocks."""
    import pandas as pd

    class State:
        def __init__(self):
            self.entries, self.written = [], 0

        def get(self):
            return iter(self.entries)

        def appendValue(self, entry):
            self.entries, self.written = [*self.entries, entry], self.written + 1

        def appendList(self, entries):
            self.entries, self.written = [*self.entries, *entries], self.written + len(entries)

        def put(self, entries):
            self.entries, self.written = entries, self.written + len(entries)

        def exists(self):
            return bool(self.entries)

        def clear(self):
            self.entries = []

    class Value:
        now = None
        exists = lambda self: self.now is not None
        get = lambda self: self.now

        def update(self, value):
            self.now = value

        def clear(self):
            self.now = None

    class Handle:
        timers = []

        def getListState(self, name, schema):
            return State()

        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, at):
            self.timers.append(at)

    mark = type("Mark", (), {"getCurrentWatermarkInMs": lambda self: 50})()
    states = jobs.JobStates(1_000)
    states.init(Handle())
    rows = [(i, i, ("queued", "started", "done")[i % 3], None if i % 2 else 80.0) for i in range(90)]
    for part in (rows[60:], rows[:60]):
        assert list(states.handleInputRows((7,), iter([pd.DataFrame(part, columns=["ms", "seq", "kind", "confidence"])]), None)) == []
    assert states.waiting.written == 2 and min(Handle.timers) == 1
    monkeypatch.setattr(jobs, "ENTRY", 30)
    (out,) = states.handleExpiredTimer((7,), mark, None)
    want = [(i, ("PENDING", "PROCESSING", "LOW_CONFIDENCE" if i % 2 else "SUCCESS")[i % 3], rows[i][2]) for i in range(50)]
    assert list(out[["ms", "status", "note"]].itertuples(index=False, name=None)) == want
    assert states.waiting.written == 4 and sorted(e for entry in states.waiting.entries for e in zip(*entry)) == rows[50:]
