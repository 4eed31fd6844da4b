"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from lakejobs.errors import JobError

# Settings the operators are written for. All are ordinary Spark settings a cluster may override.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split hot reducers of joins at run time, also where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Split hot partitions and merge small ones before a table write (REBALANCE hint).
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Streaming state beside the heap, so that many jobs do not mean long collections.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str = "lakejobs", master: str | None = None, **conf: object) -> SparkSession:
    """A session with :data:`DEFAULTS`; keyword settings use ``__`` for ``.`` and win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may do without that setting: there a temporary folder is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise JobError("spark.checkpoint.dir must name a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lakejobs-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_folder`; nothing is created there yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, keeping a folder that is set already."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


# State beside the heap; many small stores must not reserve disk ahead of what they hold.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": DEFAULTS["spark.sql.streaming.stateStore.providerClass"],
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # All stores of an executor share this much beside the heap, however many partitions there are.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
}


# Rows that pass through one state store; below that, opening and saving a store costs more than its rows.
ROWS_PER_STORE = 50_000


def state_stores(spark: SparkSession, rows: int) -> int:
    """How many partitions the state of a stream of about ``rows`` rows needs: one a core, more for many rows, at most the session's.

    Every store is opened and saved in every batch, so many small ones take their time whatever they hold.
    """
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_STORE)))


@contextmanager
def on_disk_state(spark: SparkSession, **conf: object) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whatever the session says; ``conf`` as in :func:`build_session`."""
    wanted = _STATE | {name.replace("__", "."): str(value) for name, value in conf.items()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
