"""Values as they stood at a point in time, without a window over a whole hot group.

Groups of ordinary size are one window partition each. A heavier group is range-partitioned on its order into
pieces; values are carried forward inside each piece, the last value of every piece is carried over the (few) pieces of a
group, and what enters a piece is given to its rows that have seen nothing yet.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakejobs.operators.ordered import PIECE_BYTES, ROW_BYTES, beside, bounded_broadcast, range_pieces, split_heavy
from lakejobs.session import scratch_path
from lakejobs.sources.spec import quote_name

HEAVY_ROWS = PIECE_BYTES // ROW_BYTES


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``df`` with a null in one of ``columns`` replaced by the last value before it, per group of ``keys``.

    ``order`` must be unique within a group; nulls come first in it, and null keys are one group. A group of more than
    ``heavy_rows`` rows is worked through in range pieces.
    """
    keys, order = list(keys), list(order)
    light, heavy, total = split_heavy(df, keys, F.lit(1), heavy_rows)
    filled = _filled(light, keys, order, columns)
    if heavy is None:
        return filled
    return filled.unionByName(_in_pieces(heavy, keys, order, columns, -(-total // max(1, heavy_rows))))


def _filled(df: DataFrame, keys: list[str], order: list[str], columns: Sequence[str]) -> DataFrame:
    upto = W.partitionBy(*map(quote_name, keys)).orderBy(*map(quote_name, order)).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(quote_name(c), ignorenulls=True).over(upto) for c in columns})


def _in_pieces(heavy: DataFrame, keys: list[str], order: list[str], columns: Sequence[str], pieces: int) -> DataFrame:
    spark = heavy.sparkSession
    path = scratch_path(spark, "fill")  # every later step must see the same pieces
    range_pieces(heavy, keys + order, pieces, 1).write.parquet(path)
    rows = spark.read.parquet(path)
    place = F.struct(*map(quote_name, order))
    held = {c: F.max_by(quote_name(c), F.when(F.col(quote_name(c)).isNotNull(), place)).alias(f"_in_{c}") for c in columns}
    ends = rows.groupBy(*map(quote_name, keys), "_piece").agg(*held.values())
    before = W.partitionBy(*map(quote_name, keys)).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    entering = ends.withColumns({f"_in_{c}": F.last(quote_name(f"_in_{c}"), ignorenulls=True).over(before) for c in columns}).checkpoint()
    side, match = beside(entering, [*keys, "_piece"])
    inside = _filled(rows, ["_piece", *keys], order, columns).join(bounded_broadcast(side), match, "left")
    return inside.select(
        *[F.coalesce(quote_name(c), quote_name(f"_in_{c}")).alias(c) if c in columns else quote_name(c) for c in heavy.columns]
    )


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], right_time: str | None = None,
    tie: str | None = None, tolerance: Column | None = None, each: bool = False, heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Every row of ``left`` with the ``values`` of the last row of ``right`` at or before its time, per key.

    Of right rows with equal times the one with the largest ``tie`` counts. ``each`` looks for every value's own last
    row in which it is not null, as field writes need. A value older than ``tolerance`` (an interval or a number) is null. Left
    rows whose key or time is null, and those before every right row, keep nulls. No name may be in both
    ``left`` and ``values``.
    """
    keys, right_time = list(keys), right_time or time
    clash = set(left.columns) & set(values)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    whole = lambda t: reduce(and_, [F.col(quote_name(c)).isNotNull() for c in [*keys, t]])
    at = F.col(quote_name(right_time))
    struct_of = lambda c: F.struct(F.col(quote_name(c)).alias("value"), at.alias("at"))
    if each:
        carried = {f"_v{i}": F.when(F.col(quote_name(v)).isNotNull(), struct_of(v)) for i, v in enumerate(values)}
    else:
        carried = {"_v0": F.struct(*[F.col(quote_name(v)).alias(f"v{i}") for i, v in enumerate(values)], at.alias("at"))}
    tied = F.col(quote_name(tie)) if tie else F.lit(0)
    names = [f"_k{i}" for i in range(len(keys))]
    key_of = [F.col(quote_name(k)).alias(n) for k, n in zip(keys, names)]
    row = F.struct(*map(quote_name, left.columns))
    writes = right.where(whole(right_time)).select(*key_of, at.alias("_t"), F.lit(0).alias("_side"), tied.alias("_tie"), *[c.alias(n) for n, c in carried.items()])
    asked = left.where(whole(time)).select(*key_of, F.col(quote_name(time)).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"))
    both = asked.unionByName(writes, allowMissingColumns=True)
    found = fill_forward(both, names, ["_t", "_side", "_tie"], list(carried), heavy_rows).where("_side = 1")

    def value(i: int) -> Column:
        held = F.col(f"_v{i}") if each else F.col("_v0")
        got = held["value"] if each else held[f"v{i}"]
        return got if tolerance is None else F.when(F.col("_t") <= held["at"] + tolerance, got)

    out = found.select(*[F.col("_row")[c].alias(c) for c in left.columns], *[value(i).alias(v) for i, v in enumerate(values)])
    lost = left.where(~whole(time))
    kinds = {f.name: f.dataType for f in right.schema}
    return out.unionByName(lost.select(*map(quote_name, left.columns), *[F.lit(None).cast(kinds[v]).alias(v) for v in values]))


def fields_as_of(points: DataFrame, writes: DataFrame, fields: Sequence[str], time: str = "ts", seq: str = "seq", **options) -> DataFrame:
    """``points`` (with type, id and a time) with the value each field of their job had then.

    ``writes`` are field writes (type, id, key, val, time, seq); null writes do not count, of writes at one time the last
    by ``seq`` does.
    """
    wide = writes.where(F.col("key").isin(*fields) & F.col("val").isNotNull())
    wide = wide.select("type", "id", time, seq, *[F.when(F.col("key") == f, F.col("val")).alias(f) for f in fields])
    return as_of(points, wide, ["type", "id"], time, fields, tie=seq, each=True, **options)
