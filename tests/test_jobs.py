"""Job records, job logs and map/reduce jobs."""

from __future__ import annotations

import stat

import pytest
from pyspark.sql import functions as F

from lakejobs.errors import BadParam
from lakejobs.operators import jobs as J
from lakejobs.operators.mapreduce import stream_map_reduce, text_wc, word_count, write_pairs
from lakejobs.streaming.progress import outcome_stream, progress_stream, read_outcomes, read_progress, snapshot_progress, write_progress

EVENTS = [
    ("JOB", "job_1_1", "user", "ann", 1), ("JOB", "job_1_1", "user", "bob", 3), ("JOB", "job_1_1", "user", None, 4),
    ("JOB", "job_1_1", "exitValue", "0", 5), ("JOB", "job_1_1", "created", "soon", 6),
    ("JOB", "job_1_2", "completed", "done", 1), ("TRACKING", "job_1_1", "user", "ann", 9), ("JOB", "job_1_3", "other", "x", 1),
]


@pytest.fixture
def events(spark):
    return spark.createDataFrame(EVENTS, "type string, id string, key string, val string, seq bigint")


def test_latest_and_typed(events):
    latest = {(r.type, r.id, r.key): r.val for r in J.latest_fields(events).collect()}
    assert latest[("JOB", "job_1_1", "user")] == "bob" and len(latest) == 6
    rows = {(r.type, r.id): r for r in J.job_table(events).collect()}
    one = rows[("JOB", "job_1_1")]
    assert (one.user, one.exitValue, one.created, one.completed) == ("bob", 0, None, None)
    assert rows[("JOB", "job_1_2")].completed == "done" and ("JOB", "job_1_3") not in rows


def test_ids(events):
    assert {tuple(r) for r in J.ids_where(events, "user", "ann").collect()} == {("TRACKING", "job_1_1")}
    assert J.ids_where(events, "user", "ann", "JOB").count() == 0
    assert J.ids(events).count() == 4 and J.ids(events, "JOB").count() == 3


def test_children(spark):
    jobs = spark.createDataFrame([(1, "b,a"), (2, ""), (3, None)], "id int, children string")
    edges = J.children(jobs)
    assert {tuple(r) for r in edges.collect()} == {(1, 0, "b"), (1, 1, "a")}
    assert [tuple(r) for r in J.with_children(edges).select("id", "part", "children").collect()] == [(1, 0, "b,a")]
    odd = spark.createDataFrame([(1, 0, "a,b"), (1, 1, ""), (1, 2, "c\\")], "id int, pos int, child string")
    assert {tuple(r) for r in J.children(J.with_children(odd)).collect()} == {tuple(r) for r in odd.collect()}


def test_status(spark):
    jobs = spark.createDataFrame(
        [("job_1_3", "job_1_4"), ("job_1_5", None), ("job_1_6", "job_gone"), ("job_1_7", "job_gone")], "id string, childid string"
    )
    tracker = spark.createDataFrame([("job_1_4", 2), ("job_1_5", 3), ("job_1_6", 5)], "id string, runState int")
    rows = {r.id: (r.statusId, r.parentId, r.runState, r.problem) for r in J.job_status(jobs, tracker).collect()}
    assert rows == {
        "job_1_3": ("job_1_4", "job_1_3", 2, None),
        "job_1_5": ("job_1_5", None, 3, None),
        "job_1_6": ("job_1_6", None, 5, None),
        "job_1_7": (None, None, None, "Could not find job job_1_7"),
    }
    marked = J.with_id_problem(spark.createDataFrame([("job_201112212038_0004",), ("nonsense",)], "id string"))
    assert [r.id_problem for r in marked.collect()] == [None, "Invalid jobid: nonsense"]


def test_callbacks_and_retention(spark):
    jobs = spark.createDataFrame(
        [("a", None, None, "u", 5), ("b", "done", 1, "u", 10), ("c", "done", None, None, None), ("d", "done", None, "h/$jobId/$jobId", 4)],
        "id string, completed string, notified int, callback string, created bigint",
    )
    rows = {r.id: (r.state, r.url) for r in J.callback_state(jobs).collect()}
    assert rows == {
        "a": ("Job not yet complete", None), "b": ("Callback already run", None),
        "c": ("No callback registered", None), "d": ("ready", "h/d/d"),
    }
    assert {r.id for r in J.expired(jobs, 15, 10).collect()} == {"c", "d"}
    assert {r.id for r in J.expired(jobs, 10, 10).collect()} == set()
    assert {r.id for r in J.unexpired(jobs, 10, 10).collect()} == {"a", "b", "c", "d"}
    stay, tracking = J.purge(jobs, 15, 10, jobs.select("id"))
    assert {r.id for r in stay.collect()} == {r.id for r in tracking.collect()} == {"a", "b"}


def as_stream(spark, df, path):
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_progress_stream_resumes(spark, tmp_path):
    lines = [
        (1, 1, " 10% complete"), (1, 2, " Running job: job_1_1"), (1, 3, "fred"), (2, 1, "fred"), (1, 4, " 50% complete"),
    ]
    schema = "job_id int, seq int, line string"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    stream = as_stream(spark, spark.createDataFrame(lines, schema), source)

    def catch_up():
        writer = write_progress(progress_stream(stream), out, checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
        return {tuple(r) for r in read_progress(spark, out).collect()}

    assert catch_up() == {(1, "50% complete", "job_1_1")}
    assert catch_up() == {(1, "50% complete", "job_1_1")}
    more = [(1, 5, " map 1% reduce 0%"), (2, 2, " HadoopJobId: job_1_2")]
    spark.createDataFrame(more, schema).write.mode("append").parquet(source)
    snapshots = [str(tmp_path / n) for n in ("s1", "s2")]
    snapshot_progress(spark, out, snapshots[0])
    now = {(1, "map 1% reduce 0%", "job_1_1"), (2, None, "job_1_2")}
    assert catch_up() == now
    assert {tuple(r) for r in read_progress(spark, out, snapshots[0]).collect()} == now
    snapshot_progress(spark, out, snapshots[1], before=snapshots[0])
    assert {tuple(r) for r in read_progress(spark, out, snapshots[1]).collect()} == now


def test_outcomes_come_once(spark, tmp_path):
    rows = spark.range(300).select(
        F.lit("JOB").alias("type"), (F.col("id") % 20).cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "user").otherwise("exitValue").alias("key"), F.lit("1").alias("val"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT))").cast("timestamp_ntz").alias("ts"),
    )
    rows = rows.withColumn("seq", F.col("ts").cast("string")).withColumn("val", F.substring("seq", 15, 2).cast("int").cast("string"))
    late = rows.where("id = '3'").withColumns({"ts": F.expr("ts - interval 30 days"), "val": F.lit("9")}).limit(1)
    stream = outcome_stream(as_stream(spark, rows.where("id != '3'").unionByName(late.withColumn("key", F.lit("exitValue"))), str(tmp_path / "in")))
    writer = write_progress(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    writer.trigger(availableNow=True).start().awaitTermination()
    done = {int(r.id): r for r in read_outcomes(spark, str(tmp_path / "out")).collect()}
    assert sorted(done) == list(range(20)) and {r.completed for r in done.values()} == {"done"}
    # The first exit of job k is minute k, or k + 20 where k is a multiple of three; job 3's came 30 days late.
    assert {k: r.exitValue for k, r in done.items()} == {k: 9 if k == 3 else k + 20 if k % 3 == 0 else k for k in range(20)}


def test_documented_streaming_job(spark, tmp_path):
    (tmp_path / "mydata").mkdir()
    (tmp_path / "mydata" / "one").write_text("Hello World Bye World\n")
    (tmp_path / "mydata" / "two").write_text("Hello Hadoop Goodbye Hadoop\n")
    out = stream_map_reduce(spark, str(tmp_path / "mydata"), "cat", "wc -w", n_reducers=1)
    assert [r.key.strip() for r in out.collect()] == ["8"]
    write_pairs(out, str(tmp_path / "out"))
    assert [r.value.strip() for r in spark.read.text(str(tmp_path / "out")).collect()] == ["8"]
    words = word_count(spark.read.text(str(tmp_path / "mydata")), "value")
    assert {tuple(r) for r in words.collect()} == {("Hello", 2), ("World", 2), ("Hadoop", 2), ("Bye", 1), ("Goodbye", 1)}


def test_nums_through_wc(spark, tmp_path):
    (tmp_path / "nums.txt").write_text("1\t3\n2\t4\n")
    out = stream_map_reduce(spark, str(tmp_path / "nums.txt"), "cat", "wc", n_reducers=1)
    assert out.first().key.split() == ["2", "4", "8"]


def test_programs(spark, tmp_path):
    lines = spark.range(1000).select((F.col("id") % 10).cast("string").alias("v"))
    script = tmp_path / "keyed.sh"
    script.write_text('#!/bin/sh\nwhile read -r x; do printf "$PREFIX$x\\t%s\\n" "$x"; done\n')
    script.chmod(script.stat().st_mode | stat.S_IEXEC)
    out = stream_map_reduce(spark, lines, "./keyed.sh", "cat", 4, {"PREFIX": "k"}, [str(script)])
    assert {(r.key, r.value) for r in out.collect()} == {(f"k{i}", str(i)) for i in range(10)} and out.count() == 1000
    # Each reduce partition is sorted by key, and a key is in one of them only.
    first = stream_map_reduce(spark, lines, "cat", "uniq", 4)
    assert sorted(r.key for r in first.collect()) == [str(i) for i in range(10)]
    assert stream_map_reduce(spark, lines, "cat", "head -1", 1).count() == 1


def test_raw_bytes_pass_through(spark):
    df = spark.sql("SELECT CAST(X'FF41' AS STRING) AS v UNION ALL SELECT 'né' UNION ALL SELECT ''")
    out = stream_map_reduce(spark, df, "cat", "cat", 1).select(F.hex(F.col("key").cast("binary")).alias("h"))
    assert {r.h for r in out.collect()} == {"FF41", "6EC3A9", ""}


def test_failing_programs(spark):
    lines = spark.range(10).select(F.col("id").cast("string"))
    for mapper, reducer in (("false", "cat"), ("cat", "sh -c 'cat; exit 3'")):
        with pytest.raises(Exception, match="program failed with exit code"):
            stream_map_reduce(spark, lines, mapper, reducer).collect()
    for bad in ((None, "cat", "cat"), (lines, "", "cat"), (lines, "cat", None)):
        with pytest.raises(BadParam, match="Missing"):
            stream_map_reduce(spark, *bad)


def test_wc(spark):
    df = spark.createDataFrame([("a", "x y\nz\n"), ("a", None), ("b", "é")], "k string, t string")
    assert {tuple(r) for r in text_wc(df, "t", "k").collect()} == {("a", 2, 3, 6), ("b", 0, 1, 2)}
    assert tuple(text_wc(df, "t").first()) == (2, 4, 8)
