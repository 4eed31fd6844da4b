"""Job logs and job events as streams.

Both functions work on streaming and on batch DataFrames; state is one small row per job and is kept
by Spark in the query's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lakejobs.operators.jobs import COMPLETED, with_progress

PROGRESS_FIELDS = ("percent", "child_id")


def progress_stream(lines: DataFrame) -> DataFrame:
    """Per job the last progress text and the last child id its lines (job_id, seq, line) carried.

    The two move independently: a line with only one of them leaves the other as it was. Lines are
    reduced to one row per job and task before they meet the state, so a chatty job is no hot spot.
    """
    said = with_progress(lines).where(F.col("percent").isNotNull() | F.col("child_id").isNotNull())
    last = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in PROGRESS_FIELDS
    ]
    return said.groupBy("job_id").agg(*last)


def write_progress(progress: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """An update-mode writer that keeps the changed jobs of each batch below ``path``.

    A batch replaces its own directory, so a batch that is run again after a failure changes
    nothing. :func:`read_progress` gives the current state.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        progress.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(keep)
    )


def read_progress(spark: SparkSession, path: str, snapshot: str | None = None) -> DataFrame:
    """The newest row of each job written by :func:`write_progress`.

    With a ``snapshot`` of :func:`snapshot_progress`, only batches after it are read beside it.
    """
    batches = spark.read.parquet(path)
    if snapshot:
        kept = spark.read.parquet(snapshot)
        upto = kept.agg(F.max("upto")).first()[0]
        if upto is not None:
            since = batches.where(F.col("batch") > upto)
            batches = since.unionByName(kept.drop("upto"))
    return _newest(batches).drop("batch")


def snapshot_progress(spark: SparkSession, path: str, snapshot: str, before: str | None = None) -> None:
    """Write the current state to ``snapshot``, starting from an earlier snapshot if there is one.

    Long-running streams take one now and then: batches up to it need not be read again.
    """
    batches = spark.read.parquet(path)
    upto = batches.agg(F.max("batch")).first()[0]
    batches = batches.where(F.col("batch") <= upto)
    if before:
        kept = spark.read.parquet(before)
        since = kept.agg(F.max("upto")).first()[0]
        if since is not None:  # an earlier snapshot without rows covers nothing
            batches = batches.where(F.col("batch") > since).unionByName(kept.drop("upto"))
    _newest(batches).withColumn("upto", F.lit(upto)).write.parquet(snapshot)


def _newest(batches: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct(*PROGRESS_FIELDS, "batch"), "batch").alias("_row")
    return batches.groupBy("job_id").agg(newest).select("job_id", "_row.*")


def outcome_stream(events: DataFrame) -> DataFrame:
    """The first exit of each job as (type, id, exitValue, completed, ts, seq), for update mode.

    ``events`` are field writes (type, id, key, val, ts, seq); the exit is the write of ``exitValue``
    with the smallest (ts, seq), and the job counts as done whatever the code. State is one small row
    per job and does not expire: a job never re-opens, a first exit counts however late it arrives,
    and an earlier one that arrives later corrects the row. Write with :func:`write_progress` and read
    with :func:`read_outcomes`.
    """
    exits = events.where((F.col("key") == "exitValue") & F.col("val").isNotNull())
    first = F.min(F.struct(F.col("ts").cast("timestamp").alias("ts"), "seq", F.col("val").try_cast("bigint").alias("exitValue")))
    return exits.groupBy("type", "id").agg(first.alias("_first")).select(
        "type", "id", "_first.exitValue", F.lit(COMPLETED).alias("completed"), "_first.ts", "_first.seq"
    )


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The outcome of each job written by :func:`write_progress`: the row of its newest batch."""
    batches = spark.read.parquet(path)
    fields = [c for c in batches.columns if c not in ("type", "id", "batch")]
    newest = F.max_by(F.struct(*fields), "batch").alias("_row")
    return batches.groupBy("type", "id").agg(newest).select("type", "id", "_row.*")
