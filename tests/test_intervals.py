"""Values at a point in time, overlapping intervals and peaks against brute-force versions, with groups cut into pieces."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakejobs.operators.asof import as_of, fields_as_of, fill_forward
from lakejobs.operators.intervals import overlaps, peak
from lakejobs.plans import derived

BASE = datetime(2024, 1, 1)


def brute_as_of(left, right, tolerance=None):
    out = []
    for i, k, t in left:
        best = None
        for rk, rt, tie, v in right:
            if k is not None and t is not None and rk == k and rt is not None and rt <= t and (best is None or (rt, tie) > best[:2]):
                best = (rt, tie, v)
        held = best is not None and (tolerance is None or t <= best[0] + tolerance)
        out.append((i, k, t, best[2] if held else None))
    return Counter(out)


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(4)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    left = [(i, key(), rng.choice([None] + list(range(0, 90)))) for i in range(400)]
    right = [(key(), rng.choice([None] + list(range(5, 80, 3))), i, rng.choice([None, f"v{i}"])) for i in range(200)]
    return left, right


@pytest.mark.parametrize("heavy", [10_000, 50, 7])
def test_as_of(spark, sides, heavy):
    left, right = sides
    points = spark.createDataFrame(left, "i int, k string, t int").repartition(3)
    writes = spark.createDataFrame(right, "k string, t int, tie int, v string").repartition(3)
    got = as_of(points, writes, ["k"], "t", ["v"], tie="tie", heavy_rows=heavy)
    assert got.columns == ["i", "k", "t", "v"] and Counter(tuple(r) for r in got.collect()) == brute_as_of(left, right)
    near = as_of(points, writes, ["k"], "t", ["v"], tie="tie", tolerance=F.lit(2), heavy_rows=heavy)
    assert Counter(tuple(r) for r in near.collect()) == brute_as_of(left, right, 2)
    assert as_of(points.limit(0), writes, ["k"], "t", ["v"]).count() == 0
    assert as_of(points, writes.limit(0), ["k"], "t", ["v"]).where("v is not null").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        as_of(points, writes, ["k"], "t", ["t"])


@pytest.mark.parametrize("heavy", [10_000, 20])
def test_fields_as_of(spark, heavy):
    rng = random.Random(6)
    writes = [("JOB", "j1", rng.choice(["a", "b", "x"]), rng.choice([None, "1", "2", "3"]), rng.randrange(50), n) for n in range(150)]
    points = [("JOB", rng.choice(["j1", "j2"]), rng.randrange(60)) for _ in range(60)]
    got = fields_as_of(
        spark.createDataFrame(points, "type string, id string, ts int"), spark.createDataFrame(writes, "type string, id string, key string, val string, ts int, seq int"), ["a", "b"], heavy_rows=heavy
    )
    expected = Counter()
    for kind, job, at in points:
        last = {}
        for _, j, key, val, ts, seq in sorted(writes, key=lambda w: w[4:]):
            if j == job and val is not None and ts <= at:
                last[key] = val
        expected[(kind, job, at, last.get("a"), last.get("b"))] += 1
    assert Counter(tuple(r) for r in got.collect()) == expected


@pytest.mark.parametrize("heavy", [10_000, 5])
def test_fill_forward_keeps_null_groups(spark, heavy):
    rows = [(k, i, f"{k}{i}" if i % 7 == 3 else None, "x") for k in ("a", None) for i in range(40)]
    got = fill_forward(spark.createDataFrame(rows, "k string, i int, v string, other string").repartition(4), ["k"], ["i"], ["v"], heavy).collect()
    for r in got:
        at = r.i - (r.i - 3) % 7
        assert r.v == (f"{r.k}{at}" if at >= 3 else None) and r.other == "x"
    assert len(got) == 80


def test_a_hot_job_is_no_single_window(spark):
    """Rows of the hot job are in windows of a piece only; the other window sees what an anti join leaves of light jobs."""
    rows = spark.range(2000).select(F.lit("j").alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 50 == 0, F.col("id")).alias("v"))
    df = fill_forward(rows, ["k"], ["i"], ["v"], heavy_rows=100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert [("[_piece" in line) for line in windows].count(False) == 1 and len(windows) == 2 and "LeftAnti" in plan
    assert df.where("v = i - i % 50").count() == 2000


def runs_of(rng, n):
    out = []
    for i in range(n):
        start = rng.choice([None] + list(range(300)))
        size = rng.choice([0, -3, 1, 1, 2, 5, 17, 64, 200, 5000, None])
        out.append((i, rng.choice(["q", "q", "q", "r", None]), start, None if size is None or start is None else start + size))
    return out


def running(r):
    return r[2] is not None and (r[3] is None or r[3] > r[2])


def meet(a, b):
    return running(a) and running(b) and (b[3] is None or a[2] < b[3]) and (a[3] is None or b[2] < a[3])


RUNS = "id int, queue string, started int, ended int"


def test_overlaps(spark):
    rng = random.Random(9)
    left, right = runs_of(rng, 150), runs_of(rng, 120)
    a, b = spark.createDataFrame(left, RUNS), spark.createDataFrame([(*r, "x", 1) for r in right], RUNS + ", _level string, _s int")
    got = Counter(tuple(r) for r in overlaps(a, b, ("started", "ended"), ("started", "ended")).select("left.id", "right.id").collect())
    assert got == Counter((x[0], y[0]) for x in left for y in right if meet(x, y))
    keyed = overlaps(a, b, ("started", "ended"), ("started", "ended"), ["queue"])
    assert Counter(tuple(r) for r in keyed.select("left.id", "right.id").collect()) == Counter((x[0], y[0]) for x in left for y in right if meet(x, y) and x[1] == y[1] is not None)
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert overlaps(a.limit(0), b, ("started", "ended"), ("started", "ended")).count() == 0


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_overlaps_of_times(spark, kind):
    unit = timedelta(days=1) if kind == "date" else timedelta(microseconds=700_001)
    rng = random.Random(3)
    rows = [r for r in runs_of(rng, 60) if r[2] is not None and (r[3] is None or r[3] < 900)]
    at = lambda n: None if n is None else BASE - timedelta(days=20_000) + n * unit
    df = spark.createDataFrame([(i, q, str(at(s)), None if e is None else str(at(e))) for i, q, s, e in rows], "id int, queue string, s string, e string")
    df = df.select("id", F.col("s").cast(kind).alias("started"), F.col("e").cast(kind).alias("ended"))
    got = Counter(tuple(r) for r in overlaps(df, df, ("started", "ended"), ("started", "ended")).select("left.id", "right.id").collect())
    assert got == Counter((x[0], y[0]) for x in rows for y in rows if meet(x, y))


def test_long_intervals_are_copied_little(spark):
    """One interval over everything among a thousand short ones takes part in two buckets per width."""
    rows = [(i, "q", i * 10, i * 10 + 3) for i in range(1000)] + [(5000, "q", 0, 1 << 40)]
    df = spark.createDataFrame(rows, RUNS.replace("int", "bigint"))
    pairs = overlaps(df, df, ("started", "ended"), ("started", "ended"))
    assert pairs.where("left.id = 5000").count() == 1001 and pairs.where("left.id < 5000 and right.id < 5000").count() == 1000
    from lakejobs.operators import intervals

    placed = intervals._placed(df, ("started", "ended"), [])
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())
    dealt = intervals._dealt(placed, levels).groupBy("_row.id").count()
    assert dealt.agg(F.max("count")).first()[0] <= 2 * len(levels)


def brute_peak(rows, keys):
    points = defaultdict(Counter)
    for r in rows:
        if running(r):
            points[r[1] if keys else 0][r[2]] += 1
            if r[3] is not None:
                points[r[1] if keys else 0][r[3]] -= 1
    out = {}
    for k, deltas in points.items():
        n = best = 0
        for t in sorted(deltas):
            n += deltas[t]
            if n > best:
                best, at = n, t
        out[k] = (best, at)
    return out


@pytest.mark.parametrize("heavy", [10_000, 30, 3])
def test_peak(spark, heavy):
    rows = runs_of(random.Random(2), 300)
    df = spark.createDataFrame(rows, RUNS).repartition(3)
    assert {r.queue: (r.peak, r.at) for r in peak(df, ("started", "ended"), ["queue"], heavy).collect()} == brute_peak(rows, True)
    assert [(r.peak, r.at) for r in peak(df, ("started", "ended"), heavy_rows=heavy).collect()] == [brute_peak(rows, False)[0]]
    assert peak(df.limit(0), ("started", "ended"), ["queue"], heavy).count() == 0
    assert peak(df.limit(0), ("started", "ended")).count() == 0
    assert peak(df.where("started is null"), ("started", "ended"), ["queue"]).count() == 0


def test_runs_of_jobs_overlap_as_counted(spark, sf_dir):
    """The most runs at once is also the most runs that hold the instant at which one starts."""
    runs = derived.job_runs(spark, sf_dir)
    best = peak(runs, ("started", "ended")).first()
    starts = runs.where("started < ended").groupBy("started").agg(F.max("id").alias("id"), F.max("started").alias("at")).select("id", "at", F.date_add("at", 1).cast("timestamp_ntz").alias("until"))
    held = overlaps(starts, runs, ("at", "until"), ("started", "ended")).where("right.started <= left.at").groupBy("left.at").count()
    assert held.agg(F.max("count")).first()[0] == best.peak
