"""Order-dependent work on groups of any size, without putting a group into one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import TimestampNTZType

from lakejobs.session import ensure_checkpoints, scratch_path
from lakejobs.sources.spec import quote_name

PIECE_BYTES = 256 << 20
# A rough size of a (group, order, size) row.
ROW_BYTES = 32
# Up to this many bytes of keys are broadcast; beyond it the planner joins by shuffle.
BROADCAST_BYTES = 64 << 20


def beside(right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the condition that they equal the keys of a left side.

    Null equals null. The new names keep apart two sides that come from the same rows.
    """
    names = {k: f"_right_{k}" for k in keys}
    tests = [F.col(quote_name(k)).eqNullSafe(F.col(quote_name(r))) for k, r in names.items()]
    return right.withColumnsRenamed(names), reduce(lambda a, b: a & b, tests)


def range_pieces(df: DataFrame, order: list[str], weight: int, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Range-partition by ``order`` and number the partitions in column ``_piece``.

    Pieces are contiguous in the order; with ``weight`` bytes in all, they hold about ``piece_bytes``
    each. A group that holds much of the data spreads over many of them.
    """
    count = max(df.sparkSession.sparkContext.defaultParallelism, -(-weight // piece_bytes))
    ranged = df.repartitionByRange(count, *[quote_name(c) for c in order])
    return ranged.withColumn("_piece", F.spark_partition_id())


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """A checkpointed ``df``, marked for broadcast if its measured size allows it.

    Beyond :data:`BROADCAST_BYTES` the planner joins by shuffle, where AQE splits hot keys.
    """
    row_bytes = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    return F.broadcast(df) if (df.agg(row_bytes).first()[0] or 0) <= BROADCAST_BYTES else df


def split_heavy(
    df: DataFrame, keys: list[str], weight: Column, limit: int
) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of groups up to ``limit`` in summed weight, rows of the heavier groups (or None), their weight.

    The sums are aggregated per task before their shuffle. Heavy keys are few: at most the total
    weight over ``limit``.
    """
    ensure_checkpoints(df.sparkSession)
    names = [quote_name(k) for k in keys]
    sums = df.groupBy(*names).agg(F.sum(weight).alias("_weight"))
    heavy = sums.where(F.col("_weight") > limit).checkpoint()
    total = heavy.agg(F.sum("_weight")).first()[0]
    if total is None:
        return df, None, 0
    side, match = beside(heavy.drop("_weight"), keys)
    side = bounded_broadcast(side)
    return df.join(side, match, "left_anti"), df.join(side, match, "left_semi"), total


def limit_bytes(
    df: DataFrame,
    text_col: str,
    max_bytes: int,
    order: str | list[str],
    per: str | list[str] | None = None,
) -> DataFrame:
    """The rows whose text, each with its newline, is within the first ``max_bytes`` bytes.

    Rows count in the order of ``order``, which must be unique (within a group of ``per``; nulls come
    first), and are kept or left out whole. The outcome is found as one cut-off per group - the last order value to
    keep - from (group, order, size) alone; text is then filtered where it is read, unless there are
    too many groups to broadcast. Groups that fit need one sum. Only the others are put in order,
    by range partitions: sizes are summed per piece first, then inside the one piece of each group
    where the limit falls.
    """
    order = [order] if isinstance(order, str) else list(order)
    keys = [] if per is None else [per] if isinstance(per, str) else list(per)
    spark, names = df.sparkSession, [quote_name(k) for k in keys]
    ensure_checkpoints(spark)
    at = _place(order)
    size = F.coalesce(F.octet_length(quote_name(text_col)), F.lit(0)).cast("long") + 1
    narrow = df.select(*map(quote_name, dict.fromkeys(keys + order)), size.alias("_bytes"))
    groups = narrow.groupBy(*names).agg(
        F.sum("_bytes").alias("_sum"), F.count("*").alias("_rows"), F.max(at).alias("_last")
    )
    groups = groups.checkpoint()
    fits = F.col("_sum") <= max_bytes
    # One look at the groups tells how many rows need an order and whether their keys may be broadcast.
    row_bytes = F.sum(F.octet_length(F.to_json(F.struct(*names, "_last"))))
    count, group_bytes = groups.agg(F.sum(F.when(~fits, F.col("_rows"))), row_bytes).first()
    side_of = F.broadcast if (group_bytes or 0) <= BROADCAST_BYTES else (lambda side: side)

    last = groups.where(fits).select(*names, "_last")
    if count is not None:
        if keys:
            side, match = beside(groups.where(~fits).select(*names), keys)
            narrow = narrow.join(side_of(side), match, "left_semi")
        last = last.unionByName(_cut_offs(narrow, keys, order, max_bytes, count, side_of))
    if not keys:
        row = last.first()  # there is one group
        return df.where(F.lit(False)) if row is None else df.where(_up_to(df, order, row["_last"]))
    side, same_group = beside(last, keys)
    kept = df.join(side_of(side), same_group & (at <= F.col("_last")))
    return kept.select(*map(quote_name, df.columns))


def _cut_offs(
    narrow: DataFrame,
    keys: list[str],
    order: list[str],
    max_bytes: int,
    count: int,
    side_of: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The last order value within ``max_bytes`` per group, for groups that exceed it.

    ``side_of`` marks a side with one row per group for broadcast if that is allowed.
    """
    spark, names, at = narrow.sparkSession, [quote_name(k) for k in keys], _place(order)
    # All later steps must see the same pieces, so they are written, one directory each.
    path = scratch_path(spark, "pieces")
    range_pieces(narrow, keys + order, count * ROW_BYTES).write.partitionBy("_piece").parquet(path)
    rows = spark.read.schema(f"{_ddl(narrow)}, _piece int").parquet(path)

    earlier = W.partitionBy(*names).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = (
        rows.groupBy(*names, "_piece")
        .agg(F.sum("_bytes").alias("_sum"), F.max(at).alias("_last"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .where(F.col("_before") < max_bytes)
        .checkpoint()
    )
    fits = F.col("_before") + F.col("_sum") <= max_bytes
    cut, same_piece = beside(pieces.where(~fits).select(*names, "_piece", "_before"), [*keys, "_piece"])
    inside = rows.join(side_of(cut), same_piece)
    running = W.partitionBy(*names, "_piece").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("_bytes").over(running)
    fitting = inside.withColumn("_upto", upto).where(F.col("_upto") <= max_bytes)
    return (
        pieces.where(fits)
        .select(*names, "_last")
        .unionByName(fitting.select(*names, at.alias("_last")))
        .groupBy(*names)
        .agg(F.max("_last").alias("_last"))
        .where(F.col("_last").isNotNull())
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{quote_name(f.name)} {f.dataType.simpleString()}" for f in df.schema)


def _up_to(df: DataFrame, order: list[str], last: Row) -> Column:
    """Rows at or before ``last``, as a filter that reaches the scan if there is one order column."""
    kinds = [df.schema[c].dataType for c in order]
    # A time without zone is given as text: a Python value would be read in the driver's own zone.
    values = [
        F.lit(str(v)).cast(k) if v is not None and isinstance(k, TimestampNTZType) else F.lit(v).cast(k)
        for v, k in zip(last, kinds)
    ]
    if len(order) > 1:
        return _place(order) <= F.struct(*[v.alias(c) for v, c in zip(values, order)])
    column = F.col(quote_name(order[0]))
    return column.isNull() if last[0] is None else column.isNull() | (column <= values[0])


def _place(order: list[str]) -> Column:
    """The order as one comparable value; nulls come first."""
    return F.struct(*[F.col(quote_name(c)) for c in order])
