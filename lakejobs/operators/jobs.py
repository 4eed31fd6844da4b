"""Job records: latest state, typed jobs, owners, children, status, callbacks and retention.

Records are an event table (type, id, key, val, seq) of field writes; jobs are one typed row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakejobs.errors import (
    CALLBACK_RUN,
    INVALID_JOB_ID,
    MISSING_JOB,
    NO_CALLBACK,
    NOT_COMPLETE,
)
from lakejobs.functions.joblog import parse_child_id, parse_progress
from lakejobs.operators.lists import pack_lists, unpack_lists

# The fields of a job record.
TEXT_FIELDS = ("percentComplete", "childid", "children", "user", "callback", "completed")
LONG_FIELDS = ("exitValue", "created", "notified")
COMPLETED = "done"
# Run states of a tracked job.
RUN_STATES = {1: "running", 2: "succeeded", 3: "failed", 4: "prep", 5: "killed"}
DAY_MS = 24 * 60 * 60 * 1000
MAX_AGE_MS = 7 * DAY_MS
JOB_ID = r"\Ajob_[^_]+_\d+\z"


def with_progress(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add what each output line says: ``percent`` and ``child_id``, null where it says nothing."""
    return lines.withColumns({"percent": parse_progress(line), "child_id": parse_child_id(line)})


def latest_fields(events: DataFrame) -> DataFrame:
    """The last value written per (type, id, key); null writes do not count.

    Ranking with a limit of one keeps a single row per key and task before the shuffle, and moves
    the text values less often than an aggregate over them would.
    """
    written = events.where(F.col("val").isNotNull()).select("type", "id", "key", "val", "seq")
    newest = F.row_number().over(W.partitionBy("type", "id", "key").orderBy(F.desc("seq")))
    ranked = written.withColumn("_rank", newest)
    return ranked.where(F.col("_rank") == 1).drop("_rank", "seq")


def job_table(events: DataFrame) -> DataFrame:
    """One typed row per (type, id). A number that does not parse is null.

    Every field is its own filtered aggregate, so one shuffle on the id does the last-write rule
    and the pivot together, with partial results per task.
    """
    known = events.where(F.col("key").isin(*TEXT_FIELDS, *LONG_FIELDS) & F.col("val").isNotNull())
    last = [
        F.max_by(F.when(F.col("key") == k, F.col("val")), F.when(F.col("key") == k, F.col("seq"))).alias(k)
        for k in (*TEXT_FIELDS, *LONG_FIELDS)
    ]
    rows = known.groupBy("type", "id").agg(*last)
    return rows.withColumns({k: F.col(k).try_cast("bigint") for k in LONG_FIELDS})


def ids(events: DataFrame, type: str | None = None) -> DataFrame:
    """All (type, id) with a record."""
    kept = events if type is None else events.where(F.col("type") == type)
    return kept.select("type", "id").distinct()


def ids_where(events: DataFrame, key: str, value: str, type: str | None = None) -> DataFrame:
    """(type, id) whose current value of a field equals ``value``; by default of every type."""
    kept = events.where(F.col("key") == key)
    if type is not None:
        kept = kept.where(F.col("type") == type)
    return latest_fields(kept).where(F.col("val") == value).select("type", "id")


def jobs_by_user(jobs: DataFrame, tracked: DataFrame, user: str | int) -> DataFrame:
    """Jobs the tracker knows that exactly this user owns. The user filter reaches the scan."""
    return jobs.where(F.col("user") == user).join(tracked.select("id"), "id", "left_semi")


def children(jobs: DataFrame, col: str = "children") -> DataFrame:
    """(id, pos, child) per entry of a job's child list; null and empty lists give no rows.

    Inverse of :func:`with_children`, whose parts and escapes it knows.
    """
    extra = [c for c in ("part", "first_pos", "n_items") if c in jobs.columns]
    return unpack_lists(jobs.select("id", *extra, col), col, "child", "pos")


def with_children(edges: DataFrame, out: str = "children", **options) -> DataFrame:
    """The child list of each job from (id, pos, child), in list order; see ``pack_lists`` for its parts."""
    return pack_lists(edges, "id", "child", "pos", out, **options)


def job_status(jobs: DataFrame, tracker: DataFrame) -> DataFrame:
    """Status of every job from the tracker's row of its child, else from its own.

    ``parentId`` is the job's own id where the child answered. ``problem`` says so if neither is
    known. Jobs without a child look up their own id at once, which keeps null keys out of the
    shuffle; child ids that many jobs share are split by AQE.
    """
    state = tracker.drop("id")
    best = tracker.select(
        F.col("id").alias("_best"), F.lit(True).alias("_best_known"), F.struct(*state.columns).alias("_best_state")
    )
    own = tracker.select(
        F.col("id").alias("_own"), F.lit(True).alias("_own_known"), F.struct(*state.columns).alias("_own_state")
    )
    looked = (
        jobs.withColumn("_wanted", F.coalesce("childid", "id"))
        .join(best, F.col("_wanted") == F.col("_best"), "left")
        .join(own, F.col("id") == F.col("_own"), "left")
    )
    return status_of(looked, jobs.columns, state.columns)


def status_of(looked: DataFrame, columns: list[str], state: list[str]) -> DataFrame:
    """The answer for jobs that were looked up by their child (``_best_known``, ``_best_state``) and themselves (``_own_..``)."""
    from_best = F.col("_best_known").isNotNull()
    known = from_best | F.col("_own_known").isNotNull()
    answer = F.when(from_best, F.col("_wanted")).when(known, F.col("id"))
    status = F.coalesce("_best_state", "_own_state")
    return looked.select(
        *columns,
        answer.alias("statusId"),
        F.when(answer != F.col("id"), F.col("id")).alias("parentId"),
        *[status[c].alias(c) for c in state],
        F.when(~known, _message(MISSING_JOB, "id")).alias("problem"),
    )


def with_id_problem(jobs: DataFrame, col: str = "id") -> DataFrame:
    """Add ``id_problem`` for ids that are not of the form ``job_<cluster>_<number>``."""
    bad = ~F.col(col).rlike(JOB_ID)
    return jobs.withColumn("id_problem", F.when(bad, _message(INVALID_JOB_ID, col)))


def _message(text: str, col: str) -> Column:
    return F.replace(F.lit(text), F.lit("{}"), F.col(col).cast("string"))


def callback_state(jobs: DataFrame) -> DataFrame:
    """(id, state, url): whether a job's callback is due, and the URL to call with the id filled in."""
    state = (
        F.when(F.col("completed").isNull(), NOT_COMPLETE)
        .when(F.col("notified").isNotNull(), CALLBACK_RUN)
        .when(F.col("callback").isNull(), NO_CALLBACK)
        .otherwise("ready")
    )
    url = F.replace(F.col("callback"), F.lit("$jobId"), F.col("id").cast("string"))
    return jobs.select("id", state.alias("state"), F.when(state == "ready", url).alias("url"))


def expired(jobs: DataFrame, now_ms: int, max_age_ms: int = MAX_AGE_MS) -> DataFrame:
    """Jobs created more than ``max_age_ms`` before ``now_ms``; an unknown creation time counts as 0.

    The test is a plain comparison on ``created``, so it reaches the scan.
    """
    oldest = now_ms - max_age_ms
    old = F.col("created") < oldest
    return jobs.where(old | F.col("created").isNull() if oldest > 0 else old)


def unexpired(jobs: DataFrame, now_ms: int, max_age_ms: int = MAX_AGE_MS) -> DataFrame:
    """The jobs :func:`expired` leaves out."""
    oldest = now_ms - max_age_ms
    young = F.col("created") >= oldest
    return jobs.where(young if oldest > 0 else young | F.col("created").isNull())


def purge(
    jobs: DataFrame, now_ms: int, max_age_ms: int = MAX_AGE_MS, *others: DataFrame
) -> tuple[DataFrame, ...]:
    """The jobs that stay, and of every further table keyed by ``id`` the rows of jobs not expired."""
    gone = expired(jobs, now_ms, max_age_ms).select("id")
    stay = unexpired(jobs, now_ms, max_age_ms)
    return (stay, *[other.join(gone, "id", "left_anti") for other in others])
