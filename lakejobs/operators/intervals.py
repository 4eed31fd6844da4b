"""Joins of intervals that overlap, and how many run at once.

An interval is [start, end). Its start and end are whole numbers or times; one without an end is still running, one without a
start, or that ends where it starts or before, never runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from lakejobs.operators.ordered import PIECE_BYTES, ROW_BYTES, range_pieces, split_heavy
from lakejobs.session import ensure_checkpoints, scratch_path
from lakejobs.sources.spec import quote_name

HEAVY_ROWS = PIECE_BYTES // ROW_BYTES
_STEP = 2  # bits between two widths of buckets
_LAST = (1 << 62) - 1  # the end of an interval that is still running


def ticks(df: DataFrame, col: str) -> Column:
    """A time or whole number as a long, so that the order stays."""
    kind, c = df.schema[col].dataType, F.col(quote_name(col))
    if isinstance(kind, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    if isinstance(kind, TimestampType):
        return F.unix_micros(c)
    return F.unix_date(c).cast("bigint") if isinstance(kind, DateType) else c.cast("bigint")


def _placed(df: DataFrame, span: tuple[str, str], keys: Sequence[str]) -> DataFrame:
    """The intervals that run as (_k0.., _s, _e, _level, _row); a bucket of ``_level`` is at least as wide as the interval."""
    out = df.select(
        *[F.col(quote_name(k)).alias(f"_k{i}") for i, k in enumerate(keys)],
        ticks(df, span[0]).alias("_s"), F.coalesce(ticks(df, span[1]), F.lit(_LAST)).alias("_e"), F.struct(*map(quote_name, df.columns)).alias("_row"),
    ).where("_s < _e")
    for i in range(len(keys)):
        out = out.where(F.col(f"_k{i}").isNotNull())
    size = F.col("_e") - F.col("_s") - 1
    bits = F.when(size <= 0, 0).otherwise(F.length(F.bin(size)))
    return out.withColumn("_level", F.least(F.ceil(bits / _STEP) * _STEP, F.lit(62)).cast("int"))


def _dealt(rows: DataFrame, levels: list[int]) -> DataFrame:
    """A row per bucket an interval lies in, of its own level and of each wider one the other side has."""
    level = F.explode(F.array_distinct(F.concat(F.array("_level"), F.filter(F.lit(levels).cast("array<int>"), lambda x: x > F.col("_level")))))
    each = rows.withColumn("_at", level)
    first, last = F.expr("shiftright(_s, _at)"), F.expr("shiftright(_e - 1, _at)")
    return each.withColumn("_bucket", F.explode(F.sequence(first, last)))  # two at most


def overlaps(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: Sequence[str] = (), right_keys: Sequence[str] | None = None,
) -> DataFrame:
    """(left, right): the rows, as structs, of every pair of intervals that overlap and agree in ``keys``.

    Intervals are dealt into buckets of a few widths: each lies in two buckets at most of every width that is not
    less than its own length, so a very long one among short ones is not copied many times. A pair meets in buckets of the
    longer one's width and belongs to the bucket where the later one starts; it is found there and nowhere
    else, so nothing needs to be made distinct. The join is by equality of keys, width and bucket: AQE splits a bucket
    that is hot. Null keys and intervals that never run are in no pair.
    """
    a, b = _placed(left, left_span, keys), _placed(right, right_span, keys if right_keys is None else right_keys)
    levels = [sorted(r[0] for r in x.select("_level").distinct().collect()) for x in (a, b)]  # at most 32 widths
    renamed = {c: f"_r{c}" for c in b.columns}
    a, b = _dealt(a, levels[1]), _dealt(b, levels[0]).withColumnsRenamed({**renamed, "_at": "_r_at", "_bucket": "_r_bucket"})
    same = (F.col("_at") == F.col("_r_at")) & (F.col("_bucket") == F.col("_r_bucket"))
    for i in range(len(keys)):
        same = same & (F.col(f"_k{i}") == F.col(f"_r_k{i}"))
    meets = (F.col("_s") < F.col("_r_e")) & (F.col("_r_s") < F.col("_e"))
    own = F.expr("_at = greatest(_level, _r_level) AND _bucket = shiftright(greatest(_s, _r_s), _at)")
    return a.join(b, same & meets & own).select(F.col("_row").alias("left"), F.col("_r_row").alias("right"))


def peak(df: DataFrame, span: tuple[str, str], keys: Sequence[str] = (), heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(keys, peak, at): the most intervals that run at once per group, and the first start at which they do.

    Starts and ends are added up per group and time first. Sums run over range pieces of (group, time): a piece gives its
    sum and its highest running sum, and only those are put in order per group, so one group may hold all rows. Null keys are
    a group; a group in which nothing runs gives no row.
    """
    keys = list(keys)
    spark, names = df.sparkSession, [quote_name(k) for k in keys]
    ensure_checkpoints(spark)
    start, end = F.col(quote_name(span[0])), F.col(quote_name(span[1]))
    runs = df.where(start.isNotNull() & (end.isNull() | (start < end)))
    points = F.array(F.struct(start.alias("_t"), F.lit(1).alias("_d")), F.struct(end.alias("_t"), F.lit(-1).alias("_d")))
    deltas = runs.select(*names, F.explode(points).alias("_p")).select(*names, "_p._t", "_p._d").where("_t is not null")
    deltas = deltas.groupBy(*names, "_t").agg(F.sum("_d").alias("_d")).where("_d <> 0")
    if keys:
        light, heavy, total = split_heavy(deltas, keys, F.lit(1), heavy_rows)
    else:
        light, heavy, total = None, deltas, deltas.count()
    parts = []
    if light is not None:
        parts.append(_highest(light.withColumn("_piece", F.lit(0)), keys).select(*names, F.col("_high").alias("peak"), "_at"))
    if heavy is not None:
        path = scratch_path(spark, "sweep")
        range_pieces(heavy, keys + ["_t"], -(-total // max(1, heavy_rows)), 1).write.parquet(path)
        pieces = _highest(spark.read.parquet(path), keys)
        earlier = W.partitionBy(*names).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
        high = F.col("_high") + F.coalesce(F.sum("_sum").over(earlier), F.lit(0))
        parts.append(pieces.select(*names, high.alias("peak"), "_at"))
    out = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    best = F.max(F.struct("peak", F.struct((-_ticks_of("_at", deltas)).alias("t"), F.col("_at").alias("at")).alias("first"))).alias("_best")
    return out.groupBy(*names).agg(best).where("_best.peak > 0").select(*names, F.col("_best.peak").alias("peak"), F.col("_best.first.at").alias("at"))


def _ticks_of(col: str, deltas: DataFrame) -> Column:
    return ticks(deltas.withColumnRenamed("_t", col), col)


def _highest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and piece: the sum, and the highest running sum with the first time it is reached."""
    names = [quote_name(k) for k in keys]
    running = W.partitionBy("_piece", *names).orderBy("_t").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumn("_run", F.sum("_d").over(running))
    return summed.groupBy(*names, "_piece").agg(F.sum("_d").alias("_sum"), F.max("_run").alias("_high"), F.min_by("_t", F.struct(-F.col("_run"), "_t")).alias("_at"))
