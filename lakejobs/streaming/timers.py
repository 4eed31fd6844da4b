"""Jobs that fall silent, and jobs that are kept for a time only, as streams with event-time timers.

Both keep one small row per job, and a timer per job or per share of the jobs. A timer is not moved whenever a job speaks: it fires,
looks at the state and is set anew if the job has spoken since. Time is event time only, so a run over old files
gives what a live run gave.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakejobs.operators.jobs import COMPLETED, MAX_AGE_MS

KEEP_ALIVE_MS = 60_000  # fixed value: a running job says something at least this often
FORGET_MS = MAX_AGE_MS

# Spark also opens the processors in a Python process of the driver, which knows neither the driver's module path nor files added.
register_pickle_by_value(sys.modules[__name__])


def _timer(handle: StatefulProcessorHandle, due: int, now: int) -> None:
    """A timer that fires once the watermark is ``due``, or moves if it is that already; it may fire a little early."""
    handle.registerTimer(max(due - 1, now + 1))


def _ceil_ms(micros: int) -> int:
    return -(-micros // 1000)


def _known(marked: DataFrame, key: str) -> DataFrame:
    """Without rows whose key or time is null, whose times still move the watermark.

    A test of the key alone would be pushed to the scan, before the watermark; one that needs the time too is not.
    """
    return marked.where(F.greatest(F.col(key).isNull(), F.col("ts").isNull()) == F.lit(False))


class _Silence(StatefulProcessor):
    """State: last line (microseconds), whether the job was reported, whether it has exited."""

    def __init__(self, quiet_ms: int, window_ms: int, forget_ms: int):
        self.quiet, self.window, self.forget = quiet_ms * 1000, window_ms * 1000, forget_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "last bigint, told boolean, over boolean")

    def _due(self, last: int, told: bool, over: bool) -> int:
        """When the job is to be looked at: a line up to ``quiet`` later is in a window that has closed by then."""
        return _ceil_ms(last + (self.forget if told or over else self.quiet + self.window))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.job.get() if self.job.exists() else None
        last, told, over = known if known else (None, False, False)
        for first, end, exit_at in sorted((r["first"], r["last"], r["exit"]) for r in rows):
            if not over and not told and last is not None and first - last > self.quiet:
                told = True
                yield Row(job_id=key[0], silent_since=last)
            over = over or exit_at is not None
            last = end
        now = timerValues.getCurrentWatermarkInMs()
        if not over and not told and self._due(last, told, over) <= now:  # its windows up to now are all here
            told = True
            yield Row(job_id=key[0], silent_since=last)
        self.job.update((last, told, over))
        if known is None:
            _timer(self.handle, self._due(last, told, over), now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, told, over = self.job.get()
        due, now = self._due(last, told, over), timerValues.getCurrentWatermarkInMs()
        if due <= now:
            if told or over:  # long ago
                self.job.clear()
                return
            told = True
            self.job.update((last, told, over))
            yield Row(job_id=key[0], silent_since=last)
            due = self._due(last, told, over)
        _timer(self.handle, due, now)


def silent_jobs(lines: DataFrame, delay: str, quiet_ms: int = KEEP_ALIVE_MS, forget_ms: int = FORGET_MS) -> DataFrame:
    """(job_id, silent_since): each job once whose lines stop for longer than ``quiet_ms`` before its exit, for append mode.

    ``lines`` is a stream of (job_id, ts, exit); ``ts`` is a timestamp, ``exit`` marks the line of the exit. Lines
    after it do not count. ``silent_since`` is the last line before the first long pause, in microseconds since
    1970; a job is reported when the pause is certain, that is when the watermark, ``delay`` behind the newest line,
    has passed it. Lines that come later than that are not seen.

    Lines are first reduced to one row per job and half a pause, per task before the shuffle, so a chatty job is no hot spot;
    those rows reach the timers in order of time, whatever order the lines came in. Null jobs and times are left out (but
    their times move the watermark). A job that was reported or has exited is forgotten ``forget_ms`` after its last line.
    """
    window_ms = max(1, quiet_ms // 2)
    marked = _known(lines.withWatermark("ts", delay), "job_id")
    at = F.unix_micros("ts")
    parts = marked.groupBy("job_id", F.window("ts", f"{window_ms} milliseconds")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.min(F.when(F.col("exit"), at)).alias("exit")
    )
    # Within one window lines after the exit do not matter; ``last`` is only used while there is none.
    kind = lines.schema["job_id"].dataType.simpleString()
    return parts.groupBy("job_id").transformWithState(
        _Silence(quiet_ms, window_ms, forget_ms), f"job_id {kind}, silent_since bigint", "append", "EventTime"
    )


# What is kept of a job beside its id: numbers that are 0 where they are not known, and which of them are.
_FACTS = ("created", "created_at", "created_seq", "exit_value", "exit_at", "exit_seq", "seen", "wake", "marks")
_CREATED, _EXITED, _VALUED = 1, 2, 4
_LAST = 2**63 - 1
SHARES = 4096  # groups of jobs that are kept together; part of the state, so it must not change while a stream goes on
ROWS_AT_ONCE = 100_000  # reduced to a row per job before more are held


def _one_per_job(ids: np.ndarray, facts: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Rows in the order they came as one per id, in the order of first rows: last creation, first exit, first time."""
    code, names = pd.factorize(ids, use_na_sentinel=False)
    out = {c: np.zeros(len(names), np.int64) for c in _FACTS}
    for mark, kind, fields, last in ((_CREATED, "created", ("created",), True), (_EXITED, "exit", ("exit_value",), False)):
        have = np.flatnonzero(facts["marks"] & mark)
        order = have[np.lexsort((facts[f"{kind}_seq"][have], facts[f"{kind}_at"][have], code[have]))]  # stable: of equal places in order of arrival
        mine = code[order]
        change = mine[1:] != mine[:-1]
        edge = np.append(change, True) if last else np.insert(change, 0, True)
        pick = order[edge[: len(order)]]
        for c in (*fields, f"{kind}_at", f"{kind}_seq"):
            out[c][code[pick]] = facts[c][pick]
        out["marks"][code[pick]] |= facts["marks"][pick] & (mark if last else mark | _VALUED)
    out["seen"][:] = _LAST
    np.minimum.at(out["seen"], code, facts["seen"])
    return names, out


def _joined(parts: list[tuple[np.ndarray, dict[str, np.ndarray]]]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    if len(parts) == 1:
        return parts[0]
    return np.concatenate([ids for ids, _ in parts]), {c: np.concatenate([facts[c] for _, facts in parts]) for c in _FACTS}


def _packed(ids: np.ndarray, facts: dict[str, np.ndarray]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(facts[c]) for c in _FACTS)], ["id", *_FACTS])
    with pa.BufferOutputStream() as sink:
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    jobs = pa.ipc.open_stream(rows).read_all()
    return jobs["id"].to_pandas().to_numpy(), {c: jobs[c].to_numpy() for c in _FACTS}


class _Retention(StatefulProcessor):
    """State: of the jobs of a share creation time with the place of its write, first exit with its place, time of the first
    write, and when the job is to be looked at. The share's timer is the first of those.

    A value of the state is an Arrow stream of all these rows; beside it is a null that has the type of ids.
    """

    def __init__(self, max_age_ms: int, kind: str = "bigint"):
        self.max_age, self.kind = max_age_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", f"rows binary, id {self.kind}")

    def _due(self, facts: dict[str, np.ndarray]) -> np.ndarray:
        # An unknown creation time is long ago: the job goes as soon as its writes up to the first one are in.
        expires = np.minimum(facts["created"], _LAST - self.max_age - 1) + self.max_age + 1
        return np.where(facts["marks"] & _CREATED, expires, facts["seen"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, new = timerValues.getCurrentWatermarkInMs(), []
        for frame in rows:
            at, seq = frame["at"].to_numpy(), frame["seq"].to_numpy()
            facts = {"created_at": at, "created_seq": seq, "exit_at": at, "exit_seq": seq, "seen": at, "wake": at}
            new.append(_one_per_job(frame["id"].to_numpy(), facts | {c: frame[c].to_numpy() for c in ("created", "exit_value", "marks")}))
            if len(new) > 1 and sum(len(ids) for ids, _ in new) > ROWS_AT_ONCE:
                new = [_one_per_job(*_joined(new))]
        known = [_unpacked(self.job.get()[0])] if self.job.exists() else []
        ids, facts = _one_per_job(*_joined(known + new))
        n, due = 0, self._due(facts)
        wake, sooner = np.full(len(ids), _LAST), np.ones(len(ids), bool)
        if known:  # these come first, in their order
            n = len(known[0][0])
            wake[:n], sooner[:n] = known[0][1]["wake"], due[:n] < self._due(known[0][1])
        facts["wake"] = np.where(sooner, np.minimum(wake, np.maximum(due - 1, now + 1)), wake)
        self.job.update((_packed(ids, facts), None))
        first, before = int(facts["wake"].min()), int(wake[:n].min()) if n else None
        if before is None or first < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        ids, facts = _unpacked(self.job.get()[0])
        due, now = self._due(facts), timerValues.getCurrentWatermarkInMs()
        fired = (facts["wake"] < now) | (facts["wake"] <= expiredTimerInfo.getExpiryTimeInMs())
        gone = fired & (due <= now)
        facts["wake"] = np.where(fired, np.maximum(due - 1, now + 1), facts["wake"])
        if gone.all():
            self.job.clear()
        else:
            left = {c: facts[c][~gone] for c in _FACTS}
            self.job.update((_packed(ids[~gone], left), None))
            self.handle.registerTimer(int(left["wake"].min()))
        if gone.any():
            marks = facts["marks"][gone]
            some = lambda c, mark: pd.arrays.IntegerArray(facts[c][gone], marks & mark == 0)
            completed = np.where(marks & _EXITED, COMPLETED, None)
            yield pd.DataFrame({"type": [key[0]] * len(marks), "id": ids[gone], "created": some("created", _CREATED), "exitValue": some("exit_value", _VALUED), "completed": completed})


def expiry_stream(events: DataFrame, delay: str, max_age_ms: int = MAX_AGE_MS) -> DataFrame:
    """(type, id, created, exitValue, completed) of each job once it is older than ``max_age_ms``, for append mode.

    ``events`` is a stream of field writes (type, id, key, val, ts, seq). The clock is the watermark, ``delay`` behind the
    newest write: after a batch exactly those jobs have been given that were created more than ``max_age_ms`` before it,
    and state is left of the others only. The last ``created`` by (ts, seq) and the first ``exitValue`` count, null values
    do not, and a null ``seq`` comes first; a job without a creation time expires once the clock has passed its first write. A write
    that comes after its job has expired starts a new record. Null ids are left out.

    Only the fields that count go through the state. Jobs are dealt over :data:`SHARES` shares, and those of a share are read, reduced and
    written together as arrays: a call to the state for each job would cost far more than its row.
    """
    marked = _known(events.withWatermark("ts", delay), "id")
    number = F.col("val").try_cast("bigint")
    created, exited = (F.col("key") == "created") & number.isNotNull(), (F.col("key") == "exitValue") & F.col("val").isNotNull()
    mark = lambda test, n: F.when(test, n).otherwise(0)
    slim = marked.select(
        "type", F.pmod(F.xxhash64("type", "id"), F.lit(SHARES)).alias("share"), "id", "ts", F.unix_millis("ts").alias("at"),
        F.coalesce(F.col("seq").cast("bigint"), F.lit(-_LAST - 1)).alias("seq"),
        F.when(created, number).otherwise(0).alias("created"), F.coalesce(F.when(exited, number), F.lit(0).cast("bigint")).alias("exit_value"),
        (mark(created, _CREATED) + mark(exited, _EXITED) + mark(exited & number.isNotNull(), _VALUED)).cast("bigint").alias("marks"),
    )
    kind = events.schema["id"].dataType.simpleString()
    return slim.groupBy("type", "share").transformWithStateInPandas(
        _Retention(max_age_ms, kind), f"type string, id {kind}, created bigint, exitValue bigint, completed string", "append", "EventTime"
    )


def _rows_of_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for kind, rows, place in zip(batch["type"], batch["rows"], batch["partition_id"]):
            jobs = pa.ipc.open_stream(rows.as_py()).read_all()
            jobs = jobs.append_column("type", pa.array([kind.as_py()] * len(jobs), pa.string())).append_column("partition_id", pa.array([place.as_py()] * len(jobs), pa.int32()))
            yield from jobs.set_column(0, "id", jobs["id"].cast(batch.schema.field("id").type)).to_batches()


def state_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state one of these streams holds after its last batch, one row per job."""
    stored = spark.read.format("statestore").option("stateVarName", "job").load(checkpoint)
    if "rows" not in stored.schema["value"].dataType.names:
        return stored
    kind = stored.schema["value"].dataType["id"].dataType.simpleString()
    shares = stored.select("key.type", "value.rows", "value.id", "partition_id")
    jobs = shares.mapInArrow(_rows_of_shares, f"id {kind}, {', '.join(f'{c} bigint' for c in _FACTS)}, type string, partition_id int")
    known = lambda mark, *names: [F.when(F.col("marks").bitwiseAND(mark) != 0, F.col(c)).alias(c) for c in names]
    value = F.struct(*known(_CREATED, "created", "created_at", "created_seq"), *known(_VALUED, "exit_value"), *known(_EXITED, "exit_at", "exit_seq"), "seen")
    return jobs.select(F.struct("type", "id").alias("key"), value.alias("value"), "partition_id")
