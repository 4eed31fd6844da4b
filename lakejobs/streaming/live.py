"""Status of jobs while they run: the join of a stream of jobs with a stream of tracker rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.operators.jobs import status_of


def status_stream(jobs: DataFrame, tracker: DataFrame, within: str, delay: str) -> DataFrame:
    """:func:`lakejobs.operators.jobs.job_status` over two streams, for append mode.

    ``jobs`` are (id, childid, ts, ..), ``tracker`` rows (id, ts, ..), at most one per id. A job is answered by tracker rows seen at most
    ``within`` before or after it, so both sides' state is bounded by that time and ``delay``, by which
    rows may come late. A job that finds none is given with nulls once both watermarks have passed what could
    still answer it. Rows without a time are never given, and
    those without an id may not be seen at all: their times do not move the watermarks.
    """
    state = [c for c in tracker.columns if c not in ("id", "ts")]
    looked = jobs.withColumn("_wanted", F.coalesce("childid", "id")).withWatermark("ts", delay)
    for name, key in (("best", "_wanted"), ("own", "id")):
        side = tracker.select(
            F.col("id").alias(f"_{name}"), F.col("ts").alias(f"_{name}_ts"), F.lit(True).alias(f"_{name}_known"), F.struct(*state).alias(f"_{name}_state")
        ).withWatermark(f"_{name}_ts", delay)
        near = F.expr(f"_{name}_ts >= ts - INTERVAL {within} AND _{name}_ts <= ts + INTERVAL {within}")
        looked = looked.join(side, (F.col(key) == F.col(f"_{name}")) & near, "leftOuter")
    return status_of(looked, jobs.columns, state)
