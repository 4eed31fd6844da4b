"""Streams with timers, expiring state and two watermarked sides, batch by batch against brute force."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lakejobs.operators.jobs import job_status
from lakejobs.session import scratch_path, state_stores
from lakejobs.streaming.live import status_stream
from lakejobs.streaming.timers import expiry_stream, silent_jobs, state_rows

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
START = int(BASE.timestamp() * 1_000_000)


@pytest.fixture(autouse=True)
def few_stores(spark):
    """Small streams: one state store per operator instead of several."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Replay:
    """A stream of batches given one after the other; the query stops and goes on from its checkpoint in between."""

    def __init__(self, spark, schemas, build):
        self.spark, self.schemas, self.build = spark, schemas, build
        self.sources = [scratch_path(spark, "source") for _ in schemas]
        self.out, self.checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
        self.progress = []

    def give(self, *batches):
        for path, schema, rows in zip(self.sources, self.schemas, batches):
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        schemas = [self.spark.createDataFrame([], s).schema for s in self.schemas]
        stream = self.build(*[self.spark.readStream.schema(s).parquet(p) for p, s in zip(self.sources, schemas)])
        query = stream.writeStream.option("checkpointLocation", self.checkpoint).trigger(availableNow=True).format("parquet").start(self.out)
        query.awaitTermination()
        self.progress += query.recentProgress
        return [tuple(r) for r in self.spark.read.schema(stream.schema).parquet(self.out).collect()]

    def dropped(self):
        return sum(o["numRowsDroppedByWatermark"] for p in self.progress for o in p["stateOperators"])


def at(seconds):
    return BASE + timedelta(seconds=seconds)


# --- silent jobs ----------------------------------------------------------------------------------

LINES = "job_id string, ts timestamp, exit boolean"


def brute_silent(lines, quiet=60):
    out = {}
    for job in {j for j, _, _ in lines if j is not None}:
        mine = sorted((t, e) for j, t, e in lines if j == job and t is not None)
        end = min((t for t, e in mine if e), default=None)
        times = [t for t, _ in mine if end is None or t <= end]
        for a, b in zip(times, [*times[1:], None]):
            if (b is None and end is None) or (b is not None and b - a > quiet):
                out[job] = START + round(a * 1_000_000)
                break
    return out


def silent(spark, batches, delay="120 seconds", **options):
    replay = Replay(spark, [LINES], lambda lines: silent_jobs(lines, delay, **options))
    got = []
    for batch in batches:
        got = replay.give([(j, None if t is None else at(t), e) for j, t, e in batch])
    return got, replay


def test_silent_jobs_whatever_order_lines_come_in(spark):
    rng = random.Random(3)
    lines = []
    for n in range(25):
        t = rng.uniform(0, 100)
        for _ in range(rng.randrange(1, 12)):
            lines.append((f"j{n}", round(t, 6), False))
            t += rng.choice([1, 20, 59.5, 60, 60.000001, 75, 30])
        if rng.random() < 0.5:
            lines.append((f"j{n}", round(t, 6), True))
            lines += [(f"j{n}", round(t + x, 6), False) for x in (200, 500)]  # lines after the exit do not count
    lines += [(None, 5.0, False), ("j3", None, False)]
    arrival = lambda x: (x[1] or 0) + rng.uniform(0, 110)  # noqa: E731 - late, but within the watermark's delay
    ordered = sorted(lines, key=arrival)
    batches = [ordered[i : i + 60] for i in range(0, len(ordered), 60)] + [[(None, 50_000.0, False)]]
    got, replay = silent(spark, batches)
    assert dict(got) == brute_silent(lines) and len(got) == len(dict(got))  # once each
    assert replay.dropped() == 0


def test_a_pause_is_told_when_it_is_certain(spark):
    """Not before the watermark has passed it, also where a later line is there already; a late line can still fill it."""
    first = [("a", 0, False), ("a", 70, False), ("b", 0, False), ("b", 70, False)]
    replay = Replay(spark, [LINES], lambda lines: silent_jobs(lines, "120 seconds"))
    rows = lambda lines: [(j, at(t), e) for j, t, e in lines]
    assert replay.give(rows(first)) == []
    assert replay.give(rows([("a", 40, False), ("c", 80, False)])) == []  # late by 40 s: job a did not pause
    assert dict(replay.give(rows([("c", 139, False)]))) == {}
    assert dict(replay.give(rows([("c", 250, False)]))) == {"b": START}
    # The pauses at 70 s of a, at 80 s of c (told later than it ended), and the last line of c.
    assert dict(replay.give(rows([(None, 600, False)]))) == {"a": START + 70_000_000, "b": START, "c": START + 139_000_000}


def test_lines_behind_the_watermark_are_not_seen(spark):
    got, replay = silent(spark, [[("a", 0, False), ("z", 1000, True)], [("a", 30, False)], [(None, 3000, False)]])
    assert dict(got) == {"a": START} and replay.dropped() == 1


def test_reported_and_finished_jobs_are_forgotten(spark):
    replay = Replay(spark, [LINES], lambda lines: silent_jobs(lines, "10 seconds", forget_ms=1_000_000))
    replay.give([("a", at(0), False), ("b", at(0), True), ("c", at(0), False)])
    replay.give([(None, at(500), False)])
    states = {r.key.job_id: r.value for r in state_rows(spark, replay.checkpoint).collect()}
    assert set(states) == {"a", "b", "c"} and states["a"].told and states["b"].over
    replay.give([("c", at(600), False)])
    got = replay.give([(None, at(1200), False)])
    assert dict(got) == {"a": START, "c": START}
    assert {r.key.job_id for r in state_rows(spark, replay.checkpoint).collect()} == {"c"}
    assert replay.give([(None, at(5000), False)]) == got and state_rows(spark, replay.checkpoint).count() == 0


# --- expiry ---------------------------------------------------------------------------------------

WRITES = "type string, id bigint, key string, val string, ts timestamp, seq bigint"


def test_state_holds_what_is_not_expired(spark):
    day = 86_400
    made = lambda d: str(int((BASE + timedelta(days=d)).timestamp() * 1000))
    write = lambda i, key, val, d, seq=0: ("JOB", i, key, val, at(d * day), seq)
    replay = Replay(spark, [WRITES], lambda events: expiry_stream(events, "0 seconds"))
    got = replay.give([
        write(1, "created", made(0), 0), write(2, "created", made(3), 3), write(2, "exitValue", "5", 3, 2), write(2, "exitValue", "7", 3, 1),
        write(3, "owner", "x", 2), write(4, "created", None, 2), write(4, "exitValue", None, 3), write(None, "created", made(0), 3), write(5, "created", "n/a", 4),
    ])
    assert Counter(x[1] for x in got) == Counter([3, 4, 5])  # without a creation time: at once
    got = replay.give([write(1, "created", made(1), 4.5, 9), write(9, "tick", None, 7.5)])
    assert Counter(x[1] for x in got) == Counter([3, 4, 5, 9])  # a later write makes job 1 younger
    got = replay.give([write(6, "created", made(8), 8.01)])
    assert [x for x in got if x[1] == 1] == [("JOB", 1, int(made(1)), None, None)]
    assert {r.key.id for r in state_rows(spark, replay.checkpoint).collect()} == {2, 6}
    got = replay.give([write(None, "tick", None, 10.01)])
    assert [x for x in got if x[1] == 2] == [("JOB", 2, int(made(3)), 7, "done")] and len(got) == 6
    assert {r.key.id for r in state_rows(spark, replay.checkpoint).collect()} == {6}


def test_jobs_share_state_and_calls(spark, monkeypatch):
    """A batch reads and writes a value for each share of the jobs, not for each job; what it gives is as if jobs stood alone."""
    from lakejobs.streaming import timers

    monkeypatch.setattr(timers, "SHARES", 4)
    rng, day = random.Random(5), 86_400
    made = lambda d: str(int((BASE + timedelta(days=d)).timestamp() * 1000))
    rows = []
    for i in range(200):
        kind, job = rng.choice(["JOB", None]), f"j{i}"
        for seq in range(rng.randrange(1, 7)):
            key = rng.choice(["created", "created", "exitValue", "owner"])
            val = rng.choice([None, "n/a", made(rng.uniform(0, 2))]) if key == "created" else rng.choice([None, "x", "7", str(2**62 + i)])
            rows.append((kind, job, key, val, at(rng.randrange(0, 4) * day // 2), seq))
    number = lambda v: int(v) if v and v.lstrip("-").isdigit() else None
    want = Counter()
    for kind, job in {r[:2] for r in rows}:
        mine = sorted((r[4], r[5], r[2], r[3]) for r in rows if r[:2] == (kind, job))
        created = [number(v) for _, _, k, v in mine if k == "created" and number(v) is not None]
        exits = [number(v) for _, _, k, v in mine if k == "exitValue" and v is not None]
        want[kind, job, created[-1] if created else None, exits[0] if exits else None, "done" if exits else None] += 1
    replay = Replay(spark, [WRITES.replace("id bigint", "id string")], lambda events: expiry_stream(events, "3 days"))
    rng.shuffle(rows)
    for part in range(2):
        assert replay.give(rows[part::2]) == []
    assert max(o["numRowsTotal"] for p in replay.progress for o in p["stateOperators"]) <= 8
    assert state_rows(spark, replay.checkpoint).count() == len({r[:2] for r in rows})
    assert Counter(replay.give([("JOB", None, "tick", None, at(13 * day), 0)])) == want
    assert state_rows(spark, replay.checkpoint).count() == 0


def test_writes_of_one_place_and_without_a_number():
    """Of writes with the same (ts, seq) the creation that came last and the exit that came first count; no number is the first one."""
    import numpy as np

    from lakejobs.streaming import timers

    n, none = 6, -(2**63)
    given = {"created": [1, 2, 3, 0, 0, 0], "exit_value": [0, 0, 0, 7, 0, 9], "marks": [1, 1, 1, 6, 2, 6], "seq": [none, 4, 4, 5, 5, none], "at": [5, 5, 5, 8, 8, 9], "wake": [0] * n}
    facts = {c: np.array(v, dtype=np.int64) for c, v in given.items()}
    facts |= {f"{kind}_{c}": facts[c] for kind in ("created", "exit") for c in ("at", "seq")} | {"seen": facts["at"]}
    ids, one = timers._one_per_job(np.array(["a"] * n, dtype=object), facts)
    assert list(ids) == ["a"] and [int(one[c][0]) for c in ("created", "exit_value", "exit_at", "exit_seq", "seen", "marks")] == [3, 7, 8, 5, 5, 7]
    back = timers._unpacked(timers._packed(ids, one))
    assert list(back[0]) == ["a"] and all((back[1][c] == one[c]).all() for c in timers._FACTS)


# --- status ---------------------------------------------------------------------------------------


def test_status_of_live_jobs(spark):
    rng = random.Random(8)
    jobs = [(i, rng.choice([None, i + 1, i + 2, -1]), at(i * 60)) for i in range(60)]
    tracker = [(i, i * 10, at(i * 60 + rng.randrange(300))) for i in range(70) if i % 4]
    given = "id bigint, childid bigint, ts timestamp", "id bigint, runState int, ts timestamp"
    replay = Replay(spark, given, lambda j, t: status_stream(j, t, "10 MINUTES", "10 minutes"))
    for part in range(3):
        mine = lambda rows: [r for r in rows if r[0] * 3 // 70 == part]  # noqa: B023, E731
        replay.give(mine(jobs), mine(tracker))
    before = replay.give([(-5, None, at(20_000))], [(-5, None, at(20_000))])
    got = replay.give([(-6, None, at(40_000))], [(-6, None, at(40_000))])
    batch = job_status(spark.createDataFrame(jobs, given[0]), spark.createDataFrame(tracker, given[1]).drop("ts"))
    assert Counter((*r[:2], *r[3:]) for r in got if r[0] >= 0) == Counter((*r[:2], *r[3:]) for r in map(tuple, batch.collect())) and len(before) <= len(got)
    # A tracker row further off than the bound does not answer.
    far = Replay(spark, given, lambda j, t: status_stream(j, t, "1 MINUTE", "1 minute"))
    far.give([(1, None, at(0))], [(1, 7, at(61))])
    for end in (5_000, 9_000):
        got = far.give([(-end, None, at(end))], [(-end, None, at(end))])
    assert [r[4] for r in got if r[0] == 1] == [None]


@pytest.mark.parametrize("name", ["j11_silent_jobs", "j10_expiry_stream"])
def test_state_after_the_registered_streams_is_bounded(spark, sf_dir, name, monkeypatch):
    """What is left in state is at most one row per job that is young enough."""
    from lakejobs.plans import check_jobs, derived

    kept = []
    plain = check_jobs._replayed
    monkeypatch.setattr(check_jobs, "_replayed", lambda *a, **k: kept.append(plain(*a, **k)) or kept[-1])
    getattr(check_jobs, name)(spark, sf_dir)
    left = state_rows(spark, kept[0][1]).count()
    if name == "j10_expiry_stream":
        jobs = derived.jobs(spark, sf_dir)
        assert left == jobs.where(F.col("created") >= check_jobs.NOW_MS - 7 * 86_400_000).count()
    else:
        assert left <= derived.job_beats(spark, sf_dir).select("job_id").distinct().count()


# --- sessions of others ---------------------------------------------------------------------------


def test_processors_open_where_the_package_is_not_installed():
    """Spark opens them in a Python process of the driver that knows only pyspark."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from lakejobs.streaming import timers

    given = cloudpickle.dumps([timers._Silence(60_000, 30_000, 1), timers._Retention(1)])
    look = "import pickle, sys; print(len(pickle.loads(sys.stdin.buffer.read())), 'lakejobs' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", look], input=given, capture_output=True, cwd="/", env=env)
    assert said.stdout.split() == [b"2", b"False"], said.stderr


def test_registered_streams_in_a_session_with_state_on_the_heap(spark, sf_dir, monkeypatch):
    """Timers need RocksDB, whatever the session names, and few rows few stores."""
    import os

    from lakejobs.plans import check_jobs

    name, kept, plain = "spark.sql.streaming.stateStore.providerClass", [], check_jobs._replayed
    monkeypatch.setattr(check_jobs, "_replayed", lambda *a, **k: kept.append(plain(*a, **k)) or kept[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        assert check_jobs.j11_silent_jobs(spark, sf_dir).count()
        assert "HDFSBacked" in spark.conf.get(name) and spark.conf.get("spark.sql.shuffle.partitions") == "40"
        assert len([d for d in os.listdir(f"{kept[0][1].removeprefix('file:')}/state/0") if d.isdigit()]) == 8
    finally:
        spark.conf.set(name, before)


def test_state_stores_grow_with_the_rows(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    assert [state_stores(spark, n) for n in (0, 10_000, 1_000_000, 10**9)] == [8, 8, 20, 200]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert state_stores(spark, 10**9) == 3


def test_a_replayed_join_keeps_one_store_a_partition(spark):
    """Each store is loaded and saved in every batch, so four for each side's keys and values take four times as long; the rows are the same."""
    import os

    from lakejobs.plans import check_jobs

    jobs = spark.createDataFrame([(i, i + 1 if i % 2 else None, at(i * 60)) for i in range(20)], "id bigint, childid bigint, ts timestamp")
    tracker = spark.createDataFrame([(i, i * 10, at(i * 60)) for i in range(20) if i % 4], "id bigint, runState int, ts timestamp")
    ends = [spark.createDataFrame([(-n, None, None, at(n * 86_400))], "id bigint, childid bigint, runState int, ts timestamp") for n in (1, 2)]
    sides = [(side, F.unix_seconds("ts")) for side in (jobs, tracker)]
    got, checkpoint = check_jobs._replayed(spark, sides, ends, lambda j, t: status_stream(j, t, "10 minutes", "15 minutes"), "one_store", parts=1)
    stores = f"{checkpoint.removeprefix('file:')}/state"
    assert [sorted(d for d in os.listdir(f"{stores}/{op}/0") if d.startswith(("left", "right"))) for op in (0, 1)] == [[], []]
    want = job_status(jobs, tracker.drop("ts")).select("id", "runState").collect()
    assert Counter(map(tuple, got.where("id >= 0").select("id", "runState").collect())) == Counter(map(tuple, want))
