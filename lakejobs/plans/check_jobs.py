"""Checks of job-record analytics, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakejobs.operators import jobs as J
from lakejobs.operators.asof import fields_as_of
from lakejobs.operators.intervals import overlaps, peak
from lakejobs.operators.trees import job_roots
from lakejobs.plans import derived
from lakejobs.plans.registry import ORACLES, check, table
from lakejobs.session import ensure_checkpoints, on_disk_state, scratch_path, state_stores
from lakejobs.streaming.live import status_stream
from lakejobs.streaming.progress import outcome_stream, progress_stream, read_outcomes, read_progress, write_progress
from lakejobs.streaming.timers import expiry_stream, silent_jobs


@check("j1_progress", f"SELECT job_id, seq, percent FROM ({derived.LINE_FACTS_SQL})")
def j1_progress(spark, sf_dir):
    return J.with_progress(derived.job_lines(spark, sf_dir)).select("job_id", "seq", "percent")


@check("j2_child_id", f"SELECT job_id, seq, child_id FROM ({derived.LINE_FACTS_SQL})")
def j2_child_id(spark, sf_dir):
    return J.with_progress(derived.job_lines(spark, sf_dir)).select("job_id", "seq", "child_id")


LATEST_SQL = f"""SELECT type, id, key, arg_max(val, seq) AS val FROM ({derived.JOB_EVENTS_SQL})
  WHERE val IS NOT NULL GROUP BY type, id, key"""


@check("j3_latest", LATEST_SQL)
def j3_latest(spark, sf_dir):
    return J.latest_fields(derived.job_events(spark, sf_dir))


def _as_of(field: str) -> str:
    return f"""ASOF LEFT JOIN (SELECT * FROM w WHERE key = '{field}') AS "{field}" ON p.id = "{field}".id AND p.ts >= "{field}".ts"""


@check(
    "j3_as_of",
    f"""WITH w AS (SELECT id, key, ts, arg_max(val, seq) AS val FROM ({derived.FIELD_EVENTS_SQL}) WHERE val IS NOT NULL GROUP BY id, key, ts),
        p AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, ts FROM events)
        SELECT p.id, p.seq, "percentComplete".val AS "percentComplete", "exitValue".val AS "exitValue"
        FROM p {_as_of("percentComplete")} {_as_of("exitValue")}""",
)
def j3_as_of(spark, sf_dir):
    lines = derived.job_lines(spark, sf_dir).select(F.lit("JOB").alias("type"), F.col("job_id").cast("string").alias("id"), "seq", "ts")
    return fields_as_of(lines, derived.field_events(spark, sf_dir), ["percentComplete", "exitValue"]).select("id", "seq", "percentComplete", "exitValue")


def _last(key: str) -> str:
    return f"arg_max(val, seq) FILTER (WHERE key = '{key}')"


@check(
    "j4_job_table",
    f"""SELECT type, id, {_last('percentComplete')} AS "percentComplete", {_last('childid')} AS childid,
          TRY_CAST({_last('exitValue')} AS BIGINT) AS "exitValue",
          TRY_CAST({_last('created')} AS BIGINT) AS created,
          TRY_CAST({_last('notified')} AS BIGINT) AS notified
        FROM ({derived.FIELD_EVENTS_SQL}) WHERE val IS NOT NULL GROUP BY type, id""",
)
def j4_job_table(spark, sf_dir):
    rows = J.job_table(derived.field_events(spark, sf_dir))
    return rows.drop("children", "user", "callback", "completed")


@check(
    "j5_ids_where",
    """SELECT CASE WHEN user_id % 5 = 0 THEN 'TRACKING' ELSE 'JOB' END AS type,
              CAST(user_id AS VARCHAR) AS id
       FROM events WHERE event_id % 7 <> 0 GROUP BY user_id
       HAVING arg_max(event_type, event_id) = 'signup'""",
)
def j5_ids_where(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 5 == 0, "TRACKING").otherwise("JOB").alias("type"),
        F.col("user_id").cast("string").alias("id"),
        F.lit("owner").alias("key"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("val"),
        F.col("event_id").alias("seq"),
    )
    return J.ids_where(events, "owner", "signup")


@check("j5_ids", f"SELECT DISTINCT type, id FROM ({derived.JOB_EVENTS_SQL}) WHERE type = 'JOB'")
def j5_ids(spark, sf_dir):
    return J.ids(derived.job_events(spark, sf_dir), "JOB")


@check(
    "j6_jobs_by_user",
    f"""SELECT id, created FROM ({derived.JOBS_SQL}) WHERE "user" = 42
        AND id IN (SELECT id FROM ({derived.TRACKER_SQL}))""",
)
def j6_jobs_by_user(spark, sf_dir):
    jobs, tracked = derived.jobs(spark, sf_dir), derived.tracker(spark, sf_dir)
    return J.jobs_by_user(jobs, tracked, 42).select("id", "created")


CHILDREN_SQL = """SELECT l_orderkey AS id, 0 AS part,
  string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS children
  FROM lineitem GROUP BY l_orderkey"""


def _edges(spark, sf_dir):
    """Line items as (job, position, child); the position is unique within a job."""
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), place.alias("pos"), F.col("l_partkey").alias("child")
    )


@check("j7_with_children", CHILDREN_SQL)
def j7_with_children(spark, sf_dir):
    return J.with_children(_edges(spark, sf_dir)).select("id", "part", "children")


@check(
    "j7_children",
    """SELECT l_orderkey AS id, CAST(l_partkey AS VARCHAR) AS child,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS pos
       FROM lineitem""",
)
def j7_children(spark, sf_dir):
    return J.children(J.with_children(_edges(spark, sf_dir)))


@check(
    "j7_roots",
    f"""WITH RECURSIVE p AS ({derived.JOB_PARENTS_SQL}),
        t AS (SELECT id, id AS root, 0 AS depth FROM p WHERE parent IS NULL OR parent NOT IN (SELECT id FROM p)
              UNION ALL SELECT p.id, t.root, t.depth + 1 FROM p JOIN t ON p.parent = t.id),
        a AS (SELECT id, id AS top FROM t UNION ALL SELECT a.id, p.parent FROM a JOIN p ON a.top = p.id JOIN t ON t.id = p.parent),
        s AS (SELECT top, count(*) AS size FROM a GROUP BY top)
        SELECT p.id, t.root, CAST(t.depth AS BIGINT) AS depth, s.size FROM p LEFT JOIN t ON t.id = p.id LEFT JOIN s ON s.top = p.id""",
)
def j7_roots(spark, sf_dir):
    return job_roots(derived.job_parents(spark, sf_dir))


@check(
    "j8_job_status",
    f"""SELECT j.id, CASE WHEN b.id IS NOT NULL THEN b.id WHEN o.id IS NOT NULL THEN j.id END AS "statusId",
          CASE WHEN b.id IS NOT NULL AND b.id <> j.id THEN j.id END AS "parentId",
          coalesce(b."runState", o."runState") AS "runState",
          CASE WHEN b.id IS NULL AND o.id IS NULL THEN 'Could not find job ' || j.id END AS problem
        FROM ({derived.JOBS_SQL}) j
        LEFT JOIN ({derived.TRACKER_SQL}) b ON b.id = coalesce(j.childid, j.id)
        LEFT JOIN ({derived.TRACKER_SQL}) o ON o.id = j.id""",
)
def j8_job_status(spark, sf_dir):
    status = J.job_status(derived.jobs(spark, sf_dir), derived.tracker(spark, sf_dir))
    return status.select("id", "statusId", "parentId", "runState", "problem")


@check(
    "j8_overlaps",
    f"""WITH r AS ({derived.JOB_RUNS_SQL})
        SELECT a."user", a.id, b.id AS other, greatest(a.started, b.started) AS since
        FROM r a JOIN r b ON a."user" = b."user" AND a.id < b.id AND a.started < coalesce(b.ended, 'infinity') AND b.started < coalesce(a.ended, 'infinity')
          AND a.started < coalesce(a.ended, 'infinity') AND b.started < coalesce(b.ended, 'infinity')""",
)
def j8_overlaps(spark, sf_dir):
    runs = derived.job_runs(spark, sf_dir)
    pairs = overlaps(runs, runs, ("started", "ended"), ("started", "ended"), ["user"]).where("left.id < right.id")
    return pairs.select("left.user", "left.id", F.col("right.id").alias("other"), F.greatest("left.started", "right.started").alias("since"))


_PEAK_SQL = """WITH r AS ({runs}), p AS (SELECT {key} AS queue, started AS t, 1 AS d FROM r WHERE started < coalesce(ended, 'infinity')
          UNION ALL SELECT {key}, ended, -1 FROM r WHERE started < ended),
        s AS (SELECT queue, t, sum(sum(d)) OVER (PARTITION BY queue ORDER BY t) AS n FROM p GROUP BY queue, t)
        SELECT {columns}CAST(max(n) AS BIGINT) AS peak, arg_min(t, (-n, t)) AS at FROM s GROUP BY queue"""


@check("j8_peak", _PEAK_SQL.format(runs=derived.JOB_RUNS_SQL, key="queue", columns="queue, "))
def j8_peak(spark, sf_dir):
    return peak(derived.job_runs(spark, sf_dir), ("started", "ended"), ["queue"])


@check("j8_peak_of_all", _PEAK_SQL.format(runs=derived.JOB_RUNS_SQL, key="1", columns=""))
def j8_peak_of_all(spark, sf_dir):
    return peak(derived.job_runs(spark, sf_dir), ("started", "ended"))


@check(
    "j9_callbacks",
    f"""SELECT id, state, CASE WHEN state = 'ready' THEN replace(callback, '$jobId', CAST(id AS VARCHAR)) END AS url
        FROM (SELECT *, CASE WHEN completed IS NULL THEN 'Job not yet complete'
                             WHEN notified IS NOT NULL THEN 'Callback already run'
                             WHEN callback IS NULL THEN 'No callback registered' ELSE 'ready' END AS state
              FROM ({derived.JOBS_SQL}))""",
)
def j9_callbacks(spark, sf_dir):
    return J.callback_state(derived.jobs(spark, sf_dir))


NOW_MS = 915148800000


@check(
    "j10_expired",
    f"SELECT id, created FROM ({derived.JOBS_SQL}) WHERE {NOW_MS} - coalesce(created, 0) > 604800000",
)
def j10_expired(spark, sf_dir):
    return J.expired(derived.jobs(spark, sf_dir), NOW_MS).select("id", "created")


@check(
    "j10_purge",
    f"""SELECT id, "runState" FROM ({derived.TRACKER_SQL}) WHERE id NOT IN (
          SELECT id FROM ({derived.JOBS_SQL}) WHERE {NOW_MS} - coalesce(created, 0) > 604800000)""",
)
def j10_purge(spark, sf_dir):
    jobs, tracked = derived.jobs(spark, sf_dir), derived.tracker(spark, sf_dir)
    return J.purge(jobs, NOW_MS, J.MAX_AGE_MS, tracked)[1]


PROGRESS_SQL = f"""SELECT job_id, arg_max(percent, seq) FILTER (WHERE percent IS NOT NULL) AS percent,
    arg_max(child_id, seq) FILTER (WHERE child_id IS NOT NULL) AS child_id
  FROM ({derived.LINE_FACTS_SQL}) WHERE percent IS NOT NULL OR child_id IS NOT NULL GROUP BY job_id"""


@check("j11_progress_batch", PROGRESS_SQL)
def j11_progress_batch(spark, sf_dir):
    return progress_stream(derived.job_lines(spark, sf_dir))


def _as_stream(spark, df, label, files=4):
    """The rows as a stream of several files, taken one file per batch."""
    source = scratch_path(spark, label)
    df.repartition(files).write.parquet(source)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)


@check("j11_progress_stream", PROGRESS_SQL)
def j11_progress_stream(spark, sf_dir):
    lines = _as_stream(spark, derived.job_lines(spark, sf_dir), "j11_source")
    out, checkpoint = scratch_path(spark, "j11"), scratch_path(spark, "j11_checkpoint")
    writer = write_progress(progress_stream(lines), out, checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return read_progress(spark, out)


@check(
    "j12_outcomes",
    """SELECT 'JOB' AS type, CAST(user_id AS VARCHAR) AS id, arg_min(event_id, (ts, event_id)) AS "exitValue", 'done' AS completed
       FROM events WHERE event_type = 'purchase' AND event_id % 7 <> 0 GROUP BY user_id""",
)
def j12_outcomes(spark, sf_dir):
    source = _as_stream(spark, derived.field_events(spark, sf_dir), "j12_source")  # files in no order of time
    out, checkpoint = scratch_path(spark, "j12"), scratch_path(spark, "j12_checkpoint")
    write_progress(outcome_stream(source), out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_outcomes(spark, out).select("type", "id", "exitValue", "completed")


# A join has one store a partition instead of four, and no row is looked up just to count it for the metrics. Each part is a query of its
# own that loads every store first: as it was saved, since a log of changes would be played again from its start.
_FEW_COMMITS = {
    "spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled": "false",
    "spark__sql__streaming__stateStore__rocksdb__trackTotalNumberOfRows": "false",
    "spark__sql__streaming__join__stateFormatVersion": "3",
}


def _replayed(spark, arrivals, ends, build, label, parts=4):
    """What the append-mode stream ``build`` makes of its sources has given when all has arrived: (rows, checkpoint).

    ``arrivals`` are (rows, when they arrive as a long). A part of each arrives at a time; the query then takes in what is new and
    stops, so it goes on from its checkpoint each time. Last come, one after the other, the rows of ``ends``.
    """
    ensure_checkpoints(spark)
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}_checkpoint")
    sources, placed = [], []
    for df, arrival in arrivals:
        sources.append(scratch_path(spark, f"{label}_source"))
        placed.append((df.withColumn("_arrival", arrival).checkpoint(), df.columns, df.schema))
    bounds = [p.agg(F.min("_arrival"), F.max("_arrival"), F.count("*")).first() for p, _, _ in placed]
    stores = state_stores(spark, sum(b[2] for b in bounds))
    low, high = (f(b[i] or 0 for b in bounds) for i, f in enumerate((min, max)))
    for i in range(parts + len(ends)):
        for path, (df, columns, _) in zip(sources, placed):
            new = ends[i - parts] if i >= parts else df.where(F.floor((F.col("_arrival") - low) * parts / (high - low + 1)) == i)
            new.select(*columns).write.mode("append").parquet(path)
        stream = build(*[spark.readStream.schema(schema).parquet(path) for path, (_, _, schema) in zip(sources, placed)])
        with on_disk_state(spark, spark__sql__shuffle__partitions=stores, **_FEW_COMMITS):
            stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), checkpoint


LATE_SECONDS = 90


@check(
    "j11_silent_jobs",
    f"""WITH b AS ({derived.JOB_BEATS_SQL}), e AS (SELECT job_id, min(t) AS exit_t FROM b WHERE exit GROUP BY job_id),
        l AS (SELECT b.job_id, t, lead(t) OVER (PARTITION BY b.job_id ORDER BY t) AS next, exit_t
              FROM b LEFT JOIN e ON e.job_id = b.job_id WHERE exit_t IS NULL OR t <= exit_t)
        SELECT job_id, min(t) AS silent_since FROM l WHERE next - t > 60000000 OR (next IS NULL AND exit_t IS NULL) GROUP BY job_id""",
)
def j11_silent_jobs(spark, sf_dir):
    beats = derived.job_beats(spark, sf_dir)
    late = F.pmod(F.xxhash64("job_id", "ts"), F.lit(LATE_SECONDS * 1_000_000))  # each line comes in up to so much later
    end = beats.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("bigint").alias("job_id"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit(False).alias("exit"))
    return _replayed(spark, [(beats, F.unix_micros("ts") + late)], [end], lambda lines: silent_jobs(lines, f"{LATE_SECONDS} seconds"), "j11_silent")[0]


@check(
    "j10_expiry_stream",
    f"""SELECT id, created, CASE WHEN completed = 'done' THEN CAST(id % 3 AS BIGINT) END AS "exitValue", completed
        FROM ({derived.JOBS_SQL}) WHERE {NOW_MS} - coalesce(created, 0) > 604800000""",
)
def j10_expiry_stream(spark, sf_dir):
    writes = derived.job_writes(spark, sf_dir, NOW_MS)
    late = F.pmod(F.xxhash64("id", "seq"), F.lit(24 * 60 * 60 * 1000))
    now = spark.range(1).select(F.lit("JOB").alias("type"), F.lit(None).cast("bigint").alias("id"), F.lit("tick").alias("key"), F.lit(None).cast("string").alias("val"),
                                F.timestamp_millis(F.lit(NOW_MS + 86400000)).alias("ts"), F.lit(0).cast("bigint").alias("seq"))
    expired = _replayed(spark, [(writes, F.unix_millis("ts") + late)], [now], lambda events: expiry_stream(events, "1 day"), "j10_expiry")[0]
    return expired.drop("type")


@check("j8_status_stream", ORACLES["j8_job_status"])
def j8_status_stream(spark, sf_dir):
    """Jobs a minute apart; the tracker sees each up to six minutes later, and the child of a job is the next one."""
    clock = F.timestamp_seconds(F.col("id") * 60 + 86400)
    jobs = derived.jobs(spark, sf_dir).select("id", "childid", clock.alias("ts"))
    tracker = derived.tracker(spark, sf_dir).withColumn("ts", clock + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 7).cast("int")))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("childid", "bigint"), ("runState", "int"))]
    # One join's last rows reach the next one with the first of these, and are given with the second.
    ends = [jobs.agg(F.max("ts").alias("ts")).select(F.lit(-n).cast("bigint").alias("id"), *none, (F.col("ts") + F.expr(f"INTERVAL {n} DAYS")).alias("ts")) for n in (1, 2)]
    late = F.pmod(F.xxhash64("id"), F.lit(15 * 60))
    sides = [(side, F.unix_seconds("ts") + late) for side in (jobs, tracker)]
    status = _replayed(spark, sides, ends, lambda j, t: status_stream(j, t, "10 minutes", "15 minutes"), "j8_status")[0]
    return status.where("id >= 0").select("id", "statusId", "parentId", "runState", "problem")
