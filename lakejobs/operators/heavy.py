"""The most frequent values, with memory that does not grow with the number of distinct ones.

A first pass keeps a frequent-item sketch per task: at most ``counters`` values with a count that is too low by no more than the
sketch's error. Sketches add up. What could be among the ``k`` most frequent follows from the counts and the summed
errors; a second pass counts exactly those. If the errors leave room for a value that no sketch holds, the first pass is repeated
with more counters, and beyond a bound all values are counted: the result is exact in every case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.operators.mapreduce import WHITESPACE
from lakejobs.operators.ordered import bounded_broadcast
from lakejobs.session import ensure_checkpoints

COUNTERS = 20_000  # values a task holds, twice that while it takes in a batch's own
MOST_COUNTERS = 1_000_000


class FrequentItems:
    """A Misra-Gries summary: ``held`` value -> count, each between ``error`` below the true count and the true count."""

    def __init__(self, counters: int):
        self.counters, self.held, self.error = counters, {}, 0

    def add(self, values: list, counts: list[int]) -> None:
        """Take in distinct values with their counts, a few counters' worth at a time."""
        for a in range(0, len(values), self.counters):
            held = self.held
            for value, n in zip(values[a : a + self.counters], counts[a : a + self.counters]):
                held[value] = held.get(value, 0) + n
            if len(held) > self.counters:
                numbers = np.fromiter(held.values(), np.int64, len(held))
                # What the first value left out has is taken off all: at most the weight of counters + 1 values is lost.
                less = int(np.partition(numbers, len(numbers) - self.counters - 1)[len(numbers) - self.counters - 1])
                self.held = {v: n - less for v, n in held.items() if n > less}
                self.error += less


def _sketches(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = FrequentItems(counters)
        for batch in batches:
            column = batch.column(0)
            values = column.flatten() if pa.types.is_list(column.type) else column
            found = pc.value_counts(values.drop_null())
            items.add(found.field("values").to_pylist(), found.field("counts").to_pylist())
        values, counts = list(items.held), list(items.held.values())
        # The error of the sketch is a row of its own, without a value.
        yield pa.RecordBatch.from_arrays([pa.array([*values, None], pa.string()), pa.array([*counts, items.error], pa.int64())], ["value", "n"])

    return run


def top_values(df: DataFrame, col: str, k: int, counters: int = COUNTERS) -> DataFrame:
    """(value, count) of the ``k`` most frequent texts in a column of texts or lists of texts; ties go to the smaller text.

    Nulls do not count. A task holds a sketch and one batch; a task's sketch is all it sends in the first pass, and
    counts of candidates in the second.
    """
    ensure_checkpoints(df.sparkSession)
    texts = df.select(F.col(col).alias("value"))
    single = F.explode("value").alias("value") if texts.schema[0].dataType.typeName() == "array" else F.col("value")
    wanted = None
    while counters <= MOST_COUNTERS:
        sums = texts.mapInArrow(_sketches(counters), "value string, n bigint").groupBy("value").agg(F.sum("n").alias("n")).checkpoint()
        error = sums.where("value is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        best = sums.where("value is not null").orderBy(F.desc("n")).limit(k).agg(F.count("*"), F.min("n")).first()
        # The k-th count is at least this; what has less than it even with all errors added is out.
        least = best[1] if best[0] == k else 0
        if error == 0 or least > error:
            wanted = sums.where((F.col("n") >= least - error) & F.col("value").isNotNull()).select(F.col("value").alias("_wanted"))
            break
        counters *= 4
    values = texts.select(single).where("value is not null")
    if wanted is not None:
        values = values.join(bounded_broadcast(wanted.checkpoint()), F.col("value") == F.col("_wanted"), "left_semi")
    counted = values.groupBy("value").agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "value").limit(k)


def top_words(df: DataFrame, col: str, k: int, counters: int = COUNTERS) -> DataFrame:
    """(word, count) of the ``k`` most frequent words, as :func:`lakejobs.operators.mapreduce.word_count` counts them."""
    words = df.select(F.array_remove(F.split(col, WHITESPACE), "").alias("words"))
    return top_values(words, "words", k, counters).withColumnRenamed("value", "word")
