"""Job records and logs derived from the given tables, in Spark and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.plans.registry import table

# Field writes: every event writes the field its type stands for.
JOB_EVENTS_SQL = """
  SELECT CASE WHEN user_id % 5 = 0 THEN 'TRACKING' ELSE 'JOB' END AS type,
         CAST(user_id AS VARCHAR) AS id,
         event_type AS key,
         CASE WHEN event_id % 7 <> 0
              THEN CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS val,
         event_id AS seq
  FROM events"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    return table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 5 == 0, "TRACKING").otherwise("JOB").alias("type"),
        F.col("user_id").cast("string").alias("id"),
        F.col("event_type").alias("key"),
        F.when(F.col("event_id") % 7 != 0, cents).alias("val"),
        F.col("event_id").alias("seq"),
    )


# The same with the names of job record fields; one error in three is a number that does not parse.
FIELD_EVENTS_SQL = """
  SELECT 'JOB' AS type, CAST(user_id AS VARCHAR) AS id,
         CASE event_type WHEN 'view' THEN 'percentComplete' WHEN 'click' THEN 'childid'
              WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'exitValue' ELSE 'notified' END AS key,
         CASE WHEN event_id % 7 = 0 THEN NULL
              WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'n/a'
              ELSE CAST(event_id AS VARCHAR) END AS val,
         event_id AS seq, ts
  FROM events"""


def field_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    bad = (kind == "error") & (F.col("event_id") % 3 == 0)
    return table(spark, sf_dir, "events").select(
        F.lit("JOB").alias("type"),
        F.col("user_id").cast("string").alias("id"),
        F.when(kind == "view", "percentComplete")
        .when(kind == "click", "childid")
        .when(kind == "signup", "created")
        .when(kind == "purchase", "exitValue")
        .otherwise("notified")
        .alias("key"),
        F.when(F.col("event_id") % 7 != 0, F.when(bad, "n/a").otherwise(F.col("event_id").cast("string"))).alias("val"),
        F.col("event_id").alias("seq"),
        "ts",
    )


JOB_LINES_SQL = """
  SELECT user_id AS job_id, event_id AS seq,
         CASE event_type
           WHEN 'view' THEN 'INFO MapReduceLauncher - ' || (event_id % 101) || '% complete'
           WHEN 'click' THEN 'INFO mapred.JobClient:  map ' || (event_id % 101) || '% reduce ' || (event_id % 51) || '%'
           WHEN 'signup' THEN 'INFO mapred.JobClient: Running job: job_202401_' || event_id
           WHEN 'purchase' THEN 'INFO ScriptState HadoopJobId: job_202401_' || event_id
           ELSE 'fred' END AS line
  FROM events"""


def job_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    percent = (n % 101).cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"),
        n.alias("seq"),
        "ts",
        F.when(kind == "view", F.concat(F.lit("INFO MapReduceLauncher - "), percent, F.lit("% complete")))
        .when(
            kind == "click",
            F.concat(F.lit("INFO mapred.JobClient:  map "), percent, F.lit("% reduce "), (n % 51).cast("string"), F.lit("%")),
        )
        .when(kind == "signup", F.concat(F.lit("INFO mapred.JobClient: Running job: job_202401_"), n.cast("string")))
        .when(kind == "purchase", F.concat(F.lit("INFO ScriptState HadoopJobId: job_202401_"), n.cast("string")))
        .otherwise("fred")
        .alias("line"),
    )


# What the two line patterns find, for use over JOB_LINES_SQL.
LINE_FACTS_SQL = r"""
  SELECT *, coalesce(nullif(trim(regexp_extract(line, ' map \d+%\s+reduce \d+%$')), ''),
                     nullif(trim(regexp_extract(line, ' \d+% complete$')), '')) AS percent,
         coalesce(nullif(regexp_extract(line, ' Running job: (\S+)$', 1), ''),
                  nullif(regexp_extract(line, ' HadoopJobId: (\S+)$', 1), '')) AS child_id
  FROM (""" + JOB_LINES_SQL + ")"

JOBS_SQL = """
  SELECT o_orderkey AS id, o_custkey AS "user",
         CASE WHEN o_orderkey % 11 <> 0 THEN epoch_ms(o_orderdate) END AS created,
         CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 WHEN o_orderkey % 10 = 5 THEN -1 END AS childid,
         CASE WHEN o_orderstatus = 'F' THEN 'done' END AS completed,
         CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS notified,
         CASE WHEN o_orderkey % 4 > 0 THEN 'http://x/$jobId' END AS callback
  FROM orders"""


def epoch_ms(col: str):
    """Epoch milliseconds of a time without zone, whatever the session's zone is."""
    c = F.col(col)
    seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400000 + seconds.cast("bigint") * 1000


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        n.alias("id"),
        F.col("o_custkey").alias("user"),
        F.when(n % 11 != 0, epoch_ms("o_orderdate")).alias("created"),
        F.when(n % 2 == 0, n + 1).when(n % 10 == 5, F.lit(-1)).alias("childid"),
        F.when(F.col("o_orderstatus") == "F", "done").alias("completed"),
        F.when(n % 3 == 0, 1).alias("notified"),
        F.when(n % 4 > 0, "http://x/$jobId").alias("callback"),
    )


TRACKER_SQL = """
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 5 END AS "runState"
  FROM orders WHERE o_orderkey % 13 <> 0"""


def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderkey") % 13 != 0)
        .select(
            F.col("o_orderkey").alias("id"),
            F.when(status == "F", 2).when(status == "O", 3).otherwise(5).alias("runState"),
        )
    )


RESPONSES_SQL = """
  SELECT event_id,
         CASE event_type
           WHEN 'error' THEN '{"error":"x"}'
           WHEN 'purchase' THEN '{"error":"x","errorCode":"404"}'
           WHEN 'signup' THEN '{"errorCode":409}'
           ELSE CASE WHEN event_id % 2 = 0 THEN '{"tables":[{"id":' || event_id || '}]}'
                     ELSE '{"tables":[]}' END END AS doc
  FROM events"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "error", '{"error":"x"}')
        .when(kind == "purchase", '{"error":"x","errorCode":"404"}')
        .when(kind == "signup", '{"errorCode":409}')
        .when(n % 2 == 0, F.concat(F.lit('{"tables":[{"id":'), n.cast("string"), F.lit("}]}")))
        .otherwise('{"tables":[]}')
        .alias("doc"),
    )


# A job runs from its order's date to the last date of its line items, or has not ended if it has none.
JOB_RUNS_SQL = """
  SELECT o_orderkey AS id, o_custkey AS "user", o_orderpriority AS queue, o_orderdate AS started, max(l_shipdate) AS ended
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"""


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ended"))
    return table(spark, sf_dir, "orders").join(ends, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("queue"), F.col("o_orderdate").alias("started"), "ended"
    )


# Jobs and their parents: chains of up to 63 steps between jobs that stand in a binary tree; some lead into circles of two.
JOB_PARENTS_SQL = """
  SELECT o_orderkey AS id, CASE WHEN o_orderkey = 0 THEN NULL WHEN o_orderkey % 1009 = 7 THEN o_orderkey + 1
    WHEN o_orderkey % 64 = 0 THEN o_orderkey // 2 ELSE o_orderkey - 1 END AS parent FROM orders"""


def job_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    parent = F.when(n == 0, None).when(n % 1009 == 7, n + 1).when(n % 64 == 0, F.floor(n / 2)).otherwise(n - 1)
    return table(spark, sf_dir, "orders").select(n.alias("id"), parent.alias("parent"))


_BASE_US = 1704067200000000  # 2024-01-01

# Lines of jobs on a clock that runs 600 times as fast, so that pauses are about a minute; a job exits with its purchase.
JOB_BEATS_SQL = f"""
  SELECT user_id AS job_id, {_BASE_US} + (epoch_us(ts) - {_BASE_US}) // 600 AS t,
         event_type = 'purchase' AND event_id % 7 = 0 AS exit
  FROM events"""


def job_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.timestamp_micros(F.lit(_BASE_US) + F.floor(since / 600)).alias("ts"),
        ((F.col("event_type") == "purchase") & (F.col("event_id") % 7 == 0)).alias("exit"),
    )


def job_writes(spark: SparkSession, sf_dir: str, now_ms: int) -> DataFrame:
    """Field writes of :func:`jobs` up to a time: the owner, the creation if it is known, and the exit of those done a day later."""
    at = F.least(epoch_ms("o_orderdate"), F.lit(now_ms))
    known = jobs(spark, sf_dir).select("id", "user", "created", "completed")
    times = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), at.alias("at"))
    later = F.least(F.col("at") + F.when(F.col("created").isNull(), 0).otherwise(86400000), F.lit(now_ms))
    writes = F.array(
        F.struct(F.lit("user").alias("key"), F.col("user").cast("string").alias("val"), F.col("at").alias("at")),
        F.struct(F.lit("created").alias("key"), F.col("created").cast("string").alias("val"), F.col("at").alias("at")),
        F.struct(F.lit("exitValue").alias("key"), F.when(F.col("completed").isNotNull(), (F.col("id") % 3).cast("string")).alias("val"), later.alias("at")),
    )
    rows = known.join(times, "id").select("id", F.posexplode(writes).alias("seq", "w"))
    return rows.select(F.lit("JOB").alias("type"), "id", "w.key", "w.val", F.timestamp_millis("w.at").alias("ts"), F.col("seq").cast("bigint").alias("seq"))
