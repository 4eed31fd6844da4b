"""Small helpers the operators share: row numbers, size-checked broadcasts, written intermediate tables."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakejobs.session import ensure_checkpoints, scratch_path

BROADCAST_ROWS = 200_000
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let Arrow batches hold ``size`` of rows at most (or one longer row), unless the session asks for less.

    Tasks hold a batch or two on either side of the interpreter, so this bounds what whole documents take there.
    """
    in_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if in_bytes(spark.conf.get(ARROW_BYTES)) > in_bytes(size):
        spark.conf.set(ARROW_BYTES, size)


def hand_back() -> None:
    """Give the memory this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


def executors_hand_back(spark: SparkSession) -> None:
    """Let the executors give the heap that they no longer use back to the system.

    A heap stays as large as any step made it until all of it is collected, which Spark asks of the driver only;
    what stands beside it, Python workers too, has that much less room. Idle executors get a task for each core.
    """
    slots = spark.sparkContext.defaultParallelism
    collected = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(slots, numPartitions=slots).select(collected.alias("collected")).write.format("noop").mode("overwrite").save()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, which hands the memory it has freed back to the system when its task ends.

    Workers are kept for later tasks; what a task's arrays took would stay with them, idle or not.
    """

    @wraps(run)
    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return done


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a number per row, so that rows with equal or null ids stay apart.

    The number is the row's place in one scan, which another scan may deal otherwise: rows of two scans are
    matched by :func:`numbered` instead.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: later steps read it and lost executors lose nothing."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, where that is smaller than a checkpoint."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_FILE_BITS = 33  # of a row's number, below the number of its file
PART_BITS = 16  # of a row's number, below the number of its part: so many rows of one file side by side
PATH_BYTES = 64 << 20  # of file names that are broadcast


def from_files(df: DataFrame) -> DataFrame:
    """``df`` if it only selects from and filters one table of files, else a copy of it that is one.

    Only there does a row have a place that no later scan changes. The copy is written to the shared folder.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() == "LogicalRelation" and _place(df) is not None and sum(map(len, df.inputFiles())) <= PATH_BYTES:
        return df
    return stored(df, "rows")


def _place(df: DataFrame) -> Column | None:
    """The file and the row in it, where the source tells them."""
    try:
        meta = df.metadataColumn("_metadata")
        fields = df.select(meta).schema[0].dataType.names
    except AnalysisException:
        return None
    return meta if {"file_path", "row_index"} <= set(fields) else None


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` (of :func:`from_files`) with a number per row that every scan of it gives again.

    It is made of the file's number, in order of path, and the row's place in the file, so it does not depend on how
    many executors there are or how files are split. A row's number is larger than that of rows before it in its file.
    """
    # A local file's name is listed with three slashes and told with one.
    place, files = _place(df), sorted(re.sub(r"^(\w+):///", r"\1:/", f) for f in df.inputFiles())
    if len(files) < 2:
        return df.withColumn(name, place["row_index"] if files else F.lit(0).cast("bigint"))
    path, number = free_name(df, "_path"), free_name(df, "_file")
    # From Arrow: rows of a Python list would come to the executors through Python workers of a second kind, which stay.
    known = df.sparkSession.createDataFrame(pa.table({path: pa.array(files), number: pa.array(range(len(files)), pa.int64())}))
    row = F.shiftleft(F.coalesce(number, F.raise_error(F.lit("a file that was not listed"))), _FILE_BITS).bitwiseOR(F.col(name))
    placed = df.withColumns({path + "_of": F.regexp_replace(place["file_path"], r"^(\w+):///", "$1:/"), name: place["row_index"]})
    return placed.join(F.broadcast(known), F.col(path + "_of") == F.col(path), "left").select(*df.columns, row.alias(name))


def beside_scan(side: DataFrame, label: str = "beside") -> str:
    """Write ``side`` (with ``_row``, see :func:`numbered`) so that a task that scans documents finds their rows.

    The texts then stay where they are scanned: only the narrow ``side`` is shuffled. :class:`Beside` reads it.
    """
    path = scratch_path(side.sparkSession, label)
    dealt = side.withColumn("part", F.shiftright("_row", PART_BITS)).repartition("part").sortWithinPartitions("part", "_row")
    dealt.write.partitionBy("part").parquet(path)
    return path


def by_part(batches: Iterator[pa.RecordBatch], last: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the part of their rows changes; a piece's rows are in ascending order.

    The number is in column ``_row``, or the ``last`` one.
    """
    for batch in batches:
        parts = batch.column(batch.num_columns - 1 if last else "_row").to_numpy() >> PART_BITS
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)] if len(parts) else []
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def read_part(path: str, name: str, value: int) -> pa.Table | None:
    """The rows that were written below ``path`` with this value of the partition column ``name``; None if there are none."""
    system, root = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/{name}={value}", allow_not_found=True))
    tables = [pq.read_table(f.path, filesystem=system, partitioning=None) for f in found if f.base_name.endswith(".parquet")]
    return pa.concat_tables(tables) if tables else None


class Beside:
    """The rows that :func:`beside_scan` wrote for the documents a task works on; one part is held at a time."""

    def __init__(self, path: str):
        self.path, self.part, self.table, self.rows = path, None, None, np.zeros(0, np.int64)

    def of(self, rows: np.ndarray) -> pa.Table | None:
        """The side rows of ``rows`` (ascending, of one part, see :func:`by_part`), by row; None if there are none."""
        if not len(rows):
            return None
        part = int(rows[0]) >> PART_BITS
        if part != self.part:
            self.part, self.table, self.rows = part, None, np.zeros(0, np.int64)
            table = read_part(self.path, "part", part)
            if table is not None:
                order = np.argsort(table.column("_row").to_numpy(), kind="stable")
                self.table = table.take(pa.array(order)).combine_chunks()
                self.rows = self.table.column("_row").to_numpy()
        a, b = np.searchsorted(self.rows, [rows[0], rows[-1] + 1])
        return self.table.slice(a, b - a) if b > a else None


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` (of :func:`from_files`) without the rows numbered in ``rows`` (_row, as by :func:`numbered`).

    Texts are not shuffled.
    """
    path, name = beside_scan(rows.select("_row")), free_name(docs, "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Beside(path)
        for batch in by_part(batches, last=True):
            numbers = batch.column(batch.num_columns - 1).to_numpy()
            gone = beside.of(numbers)
            if gone is not None:
                batch = batch.filter(pa.array(~np.isin(numbers, gone.column("_row").to_numpy())))
            yield batch.select(list(range(batch.num_columns - 1)))

    return numbered(docs, name).mapInArrow(lean(run), docs.schema)


def with_field(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of ``df`` and one more column, for functions over Arrow batches."""
    return StructType(list(df.schema.fields)).add(name, kind)


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most :data:`BROADCAST_ROWS` rows, else as it is.

    Only for narrow rows (a few numbers). Beyond the bound the planner shuffles and AQE splits hot keys.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
