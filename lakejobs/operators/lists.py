"""Groups of rows as comma lists, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakejobs.functions.lists import decode_list, escape_item
from lakejobs.operators.ordered import range_pieces, split_heavy
from lakejobs.sources.spec import quote_name


PART_BYTES = 16 << 20


def pack_lists(
    df: DataFrame,
    key: str,
    col: str,
    order: str,
    out: str = "list",
    max_list_bytes: int = PART_BYTES,
) -> DataFrame:
    """Comma lists per key, items in the order of ``order``: rows (key, part, first_pos, n_items, list).

    A key's list comes in parts of about ``max_list_bytes`` at most; joined by commas in the order of
    ``part`` they are the whole list. ``first_pos`` is the position of a part's first item in the whole
    list and ``n_items`` how many it holds (so a part that is one empty item is not taken for none).
    Longer lists are built from range partitions, so no task holds all of one.
    """
    rows = df.select(
        F.col(quote_name(key)).alias("_key"),
        F.col(quote_name(order)).alias("_order"),
        escape_item(F.col(quote_name(col)).cast("string")).alias("_item"),
    )
    weight = F.octet_length("_item").cast("long") + 16
    small, big, size = split_heavy(rows, ["_key"], weight, max_list_bytes)
    # Lists do not shrink when they are half built, so rows are shuffled as they are.
    packed = _collect(small.repartition("_key").withColumn("_piece", F.lit(0))).withColumn("first_pos", F.lit(0).cast("long"))
    if big is not None:
        # Pieces are of a task's size, however small the parts are that they are cut into.
        pieces = range_pieces(big, ["_key", "_order"], size, max(max_list_bytes, PART_BYTES))
        upto = F.sum(weight).over(W.partitionBy("_key", "_piece").orderBy("_order", "_item").rowsBetween(W.unboundedPreceding, W.currentRow))
        cut = pieces.withColumn("_piece", F.struct("_piece", F.floor((upto - weight) / max_list_bytes).alias("_cut")))
        # Written once: positions must count the very parts that come out.
        parts = _collect(cut).checkpoint()
        by_place = W.partitionBy("_key").orderBy("part")
        places = parts.select("_key", "part", "n_items").select(
            F.col("_key").alias("_k"), F.col("part").alias("_p"), (F.row_number().over(by_place) - 1).alias("_part"),
            F.coalesce(F.sum("n_items").over(by_place.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first_pos"),
        )
        same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("part") == F.col("_p"))
        packed = packed.unionByName(parts.join(places, same).drop("_k", "_p").withColumn("part", F.col("_part")).drop("_part"))
    return packed.select(F.col("_key").alias(key), "part", "first_pos", "n_items", F.col("list").alias(out))


def _collect(rows: DataFrame) -> DataFrame:
    collected = F.sort_array(F.collect_list(F.struct("_order", "_item")))
    return (
        rows.groupBy("_key", F.col("_piece").alias("part"))
        .agg(collected.alias("_rows"))
        .select("_key", "part", F.size("_rows").alias("n_items"), F.array_join(F.col("_rows")["_item"], ",").alias("list"))
    )


def unpack_lists(df: DataFrame, col: str, item: str = "item", pos: str = "pos") -> DataFrame:
    """One row per list item with its position; null and empty lists give none.

    The columns ``first_pos`` and ``n_items`` of :func:`pack_lists`, where present, are used and left
    out: positions then count over all parts of a list, and a part of one empty item gives that item.
    """
    taken = {col, "first_pos", "n_items", "part"} if {"first_pos", "n_items"} <= set(df.columns) else {col}
    kept = [quote_name(c) for c in df.columns if c not in taken]
    items = decode_list(quote_name(col))
    if len(taken) == 1:
        return df.select(*kept, F.posexplode(items).alias(pos, item))
    lone = (F.col(quote_name(col)) == "") & (F.col("n_items") == 1)
    items = F.when(lone, F.array(F.lit(""))).otherwise(items)
    each = df.select(*kept, F.col("first_pos").alias("_first"), F.posexplode(items).alias("_pos", item))
    return each.select(*kept, (F.col("_first") + F.col("_pos")).cast("int").alias(pos), quote_name(item))
