"""Filter interaction audit: what each filter removes at each step of every order.

A document's outcome depends on its mask alone, the set of filters it fails. Each mask is mapped to one
big integer with a 64-bit field per step of every order (600 for five filters) and one for the document
itself; a field is 1 where a document of that mask is removed. Adding these integers over the documents of a
part adds all steps at once. A field never exceeds the number of documents, which Spark counts in a
long, so no field runs into the next. One sum is taken over all documents of a part, one over good ones
and one over toxic ones; every other count follows from them:

* kept: the documents less what was removed up to the step;
* a filter's failures are what it removes as the first step, its unique failures what it removes as the last;
* redundant: its failures less what it removes here.

Documents are counted per (part, mask, label) in the JVM first; adding n equal integers is one product.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.tables import stored

BLANK = r"[\x20\x09-\x0D]+"
FIELD_BYTES = 8

_REPORT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter: few words (A), few distinct ones (B), many capitals (C), odd signs (D)."""
    words = F.array_remove(F.split(text, BLANK), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": capitals * 100 > F.length(text) * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def masked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part and label fail which filters.

    Bits 0 to 3 of the mask are the text filters, bit 4 stands for a text that a smaller id has too. Of rows
    with equal ids and texts none fails by the others; a null id is smaller than none and fails by none.
    A document is good (toxic) if any label of its id says so.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum(F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(text_filters(F.col("_text")).values()))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    rows = rows.select("id", "part", bits.alias("mask"), F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest"))
    marks = labels.groupBy(F.col(id_col).alias("_of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = rows.join(marks, F.col("id") == F.col("_of"), "left").select(
        "digest", "id", "part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    )
    key = ["part", "mask", "good", "toxic"]
    each = stored(known.groupBy("digest", "id", *key).agg(F.count("*").alias("n")), "masks")

    # All rows count as copies first; then those with the smallest id of a text are moved to its first mask.
    all_ = each.select("part", F.when(F.col("id").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(16))).alias("mask"), "good", "toxic", "n")
    same_id = each.where("id is not null").groupBy("digest", "id").agg(F.collect_list(F.struct(*key, "n")).alias("rows"))  # <= parts x labels
    first = same_id.groupBy("digest").agg(F.min_by("rows", "id").alias("rows")).select(F.inline("rows"))
    moved = first.select("part", F.explode(F.array(F.struct("mask", "n"), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (-F.col("n")).alias("n")))).alias("m"), "good", "toxic")
    both = all_.unionByName(moved.select("part", "m.mask", "good", "toxic", "m.n"))
    return both.groupBy(*key).agg(F.sum("n").alias("n")).where("n > 0")


def packed_outcomes(letters: str) -> tuple[list[tuple[str, int]], list[int]]:
    """The steps (order, index) in field order, and each mask's integer; the field after the last step is the document."""
    orders = ["".join(p) for p in permutations(letters)]
    steps = [(order, i) for order in orders for i in range(len(letters))]
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    packed = []
    for mask in range(1 << len(letters)):
        fields = np.zeros(len(steps) + 1, "<u8")
        fields[-1] = 1
        for at, order in enumerate(orders):
            removing = next((i for i, letter in enumerate(order) if mask & bit[letter]), None)
            if removing is not None:
                fields[at * len(letters) + removing] = 1
        packed.append(int.from_bytes(fields.tobytes(), "little"))
    return steps, packed


def unpacked(total: int, fields: int) -> np.ndarray:
    """The fields of a sum of packed integers."""
    return np.frombuffer(total.to_bytes(fields * FIELD_BYTES, "little"), "<u8").astype(np.int64)


def _report(letters: str):
    steps, packed = packed_outcomes(letters)
    width = len(letters)
    orders = [order for order, _ in steps]
    place = np.array([i for _, i in steps])
    which = np.array([letters.index(order[i]) for order, i in steps])

    def rows_of(part: str, sums: list[int]) -> pa.RecordBatch:
        (*removed, documents), good, toxic = (unpacked(s, len(steps) + 1) for s in sums)
        removed = np.array(removed)
        kept = documents - np.cumsum(removed.reshape(-1, width), axis=1).ravel()
        alone, failing, shapley = (np.zeros(width, np.int64) for _ in range(3))
        for f in range(width):  # a filter fares the same in every order that has it first, and in every that has it last
            mine = which == f
            failing[f], alone[f], shapley[f] = removed[mine & (place == 0)][0], removed[mine & (place == width - 1)][0], removed[mine].sum()
        columns = [kept, removed, failing[which] - removed, alone[which], good[:-1], toxic[:-1], shapley[which]]
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(steps), pa.string()), pa.array(orders), pa.array(place + 1, pa.int32()), *[pa.array(c, pa.int64()) for c in columns]],
            [f.split()[0] for f in _REPORT.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = None, [0, 0, 0]
        for batch in batches:  # sorted by part
            for row in batch.to_pylist():
                if row["part"] != part:
                    if part is not None:
                        yield rows_of(part, sums)
                    part, sums = row["part"], [0, 0, 0]
                adds = row["n"] * packed[row["mask"]]
                sums = [sums[0] + adds, sums[1] + adds * row["good"], sums[2] + adds * row["toxic"]]
        if part is not None:
            yield rows_of(part, sums)

    return run


def audit(masks: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, good, toxic, n); bit i is filter ``letters[i]``."""
    by_part = masks.select("part", "mask", "good", "toxic", "n").repartition("part").sortWithinPartitions("part")
    return by_part.mapInArrow(_report(letters), _REPORT)


def filter_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The audit of filters A to E over whole documents per source.

    A null text is empty, a null source is the part of the empty string, rows with equal ids are all
    counted, and an empty table gives no rows. Other columns are not read.
    """
    return audit(masked(docs, labels, **columns))
