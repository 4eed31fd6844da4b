"""Benchmark decontamination by winnowing.

Each text is cut to its words. A fingerprint is the hash of ``gram`` consecutive words; of every
``window - gram + 1`` consecutive fingerprints the smallest (all of them, if equal) are kept. Two
texts that share ``window`` consecutive words therefore share a kept fingerprint inside that span.
Fingerprints of documents and items are joined, and each hit is extended word by word as far as a
window can reach; a run of ``window`` equal words is an occurrence. An item of fewer words is one
window: it is looked up by the hash of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.tables import from_files, kept, lean, numbered, small_side, with_row, without_rows
from lakejobs.llm.textbytes import grams, slices, text_bytes, window_minima, words

WINDOW = 10
GRAM = 5
# Bits of the filter that documents' fingerprints pass before they leave their task. Its size is fixed:
# with very many items it only filters less.
FILTER_BITS = 1 << 22
FILTER_FROM_ROWS = 2_000_000

_SEED = "array<struct<kind:int,hash:bigint,at:int,left:int,ctx:string>>"


def _fingerprints(w, window: int, gram: int, short: list[int]):
    """(kind, hash, index of first word) of all kept fingerprints; kind is 0, or the length of a short item."""
    hashes, at = grams(w.hashes, w.row, gram)
    span = window - gram + 1
    least = window_minima(hashes, span)
    keep = np.zeros(len(hashes), bool)
    if len(least):
        same = w.row[at[: len(least)]] == w.row[at[span - 1 :]]
        for i in range(span):
            keep[i : i + len(least)] |= same & (hashes[i : i + len(least)] == least)
    found = [(np.zeros(int(keep.sum()), np.int32), hashes[keep], at[keep])]
    for size in short:
        hashes, at = grams(w.hashes, w.row, size)
        found.append((np.full(len(hashes), size, np.int32), hashes, at))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _seeds(batch: pa.RecordBatch, window: int, gram: int, short: list[int], only_short: bool, bits) -> Iterator[list]:
    """Per row (number of words, seeds); a seed carries the words a window around it can reach."""
    data, offsets = text_bytes(batch.column("_text"))
    for a, b in slices(offsets):
        w = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        kind, hashes, at = _fingerprints(w, window, gram, short)
        if bits is not None:
            low = (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            wanted = (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 != 0
            kind, hashes, at = kind[wanted], hashes[wanted], at[wanted]
        counts = np.diff(w.first)
        if only_short:  # items: a text of fewer words than a window is looked up whole, any other by fingerprints
            wanted = np.where(counts[w.row[at]] < window, kind == counts[w.row[at]], kind == 0)
            kind, hashes, at = kind[wanted], hashes[wanted], at[wanted]
        seeds: list[list] = [[] for _ in range(b - a)]
        for k, h, i in zip(kind.tolist(), hashes.view(np.int64).tolist(), at.tolist(), strict=True):
            r = int(w.row[i])
            start, stop, size = int(w.first[r]), int(w.first[r + 1]), k or gram
            reach = 0 if k else window - gram
            lo, hi = max(start, i - reach), min(stop, i + size + reach)
            seeds[r].append({"kind": k, "hash": h, "at": i - start, "left": i - lo, "ctx": w.text(lo, hi)})
        for r in range(b - a):
            yield [int(counts[r]), seeds[r]]


def _with_seeds(df: DataFrame, text_col: str, window, gram, short, only_short=False, bits=None) -> DataFrame:
    """(_row, _id, n_words, seeds) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_bits = None if bits is None else np.frombuffer(bits.value, np.uint8)
        seed_type = pa.list_(pa.struct([("kind", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("left", pa.int32()), ("ctx", pa.string())]))
        for batch in batches:
            got = list(_seeds(batch, window, gram, short, only_short, filter_bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], seed_type)],
                ["_row", "_id", "n_words", "seeds"],
            )

    kind = df.schema["_id"].dataType.simpleString()
    return df.select("_row", "_id", F.col(text_col).alias("_text")).mapInArrow(
        lean(run), f"_row bigint, _id {kind}, n_words bigint, seeds {_SEED}"
    )


def _extended(window: int, gram: int):
    """Joined seeds to matched word ranges; rows without a match keep their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("at", "left", "ctx", "kind", "i_left", "i_ctx")]
            starts, ends = [], []
            for at, left, ctx, kind, i_left, i_ctx in zip(*columns, strict=True):
                start = end = None
                if i_ctx is not None:
                    ours, theirs = ctx.split(" "), i_ctx.split(" ")
                    size, need = (kind, kind) if kind else (gram, window)
                    if ours[left : left + size] == theirs[i_left : i_left + size]:
                        back, on = 0, size
                        while back < min(left, i_left) and ours[left - back - 1] == theirs[i_left - back - 1]:
                            back += 1
                        while left + on < len(ours) and i_left + on < len(theirs) and ours[left + on] == theirs[i_left + on]:
                            on += 1
                        if back + on >= need:
                            start, end = at - back, at + on
                starts.append(start)
                ends.append(end)
            rest = [batch.column(c) for c in ("_row", "_id", "n_words", "item_id")]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                ["_row", "_id", "n_words", "item_id", "start", "end"],
            )

    return run


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """One row per document row: (_row, id, n_words, spans, item_ids).

    ``spans`` are the word ranges [start, end) found, ``item_ids`` the distinct ids (as text) of items
    with an occurring window, sorted. A null text has no words; a null item id reads as empty text;
    items with equal ids count once; rows with equal document ids stay apart. Other columns are not read.

    The documents are read once and their texts are not shuffled: a task hands on only fingerprints
    that pass a bit filter of fixed size over the items' fingerprints, each with the few words around it.
    """
    spark = docs.sparkSession
    source = numbered(from_files(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    tests = with_row(items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).alias("_text")))
    every = list(range(1, window))
    prints = kept(
        _with_seeds(tests, "_text", window, gram, every, only_short=True)
        .select(F.col("_id").alias("item_id"), F.explode("seeds").alias("s"))
        .select("item_id", F.col("s.kind").alias("i_kind"), F.col("s.hash").alias("i_hash"), F.col("s.left").alias("i_left"), F.col("s.ctx").alias("i_ctx"))
        .distinct()
    )
    count = prints.count()
    short = [r[0] for r in prints.where("i_kind > 0").select("i_kind").distinct().collect()]  # below ``window``
    bits = None
    if count <= FILTER_FROM_ROWS:
        low = prints.select((F.col("i_hash").bitwiseAND(F.lit(FILTER_BITS - 1))).cast("int").alias("b")).distinct()
        flags = np.zeros(FILTER_BITS, np.uint8)
        got = low.toArrow().column("b").to_numpy()
        flags[got] = 1
        bits = spark.sparkContext.broadcast(np.packbits(flags, bitorder="little").tobytes())
    found = (
        _with_seeds(source, "_text", window, gram, sorted(short), bits=bits)
        .select("_row", "_id", "n_words", F.explode_outer("seeds").alias("s"))
        .select("_row", "_id", "n_words", F.coalesce("s.kind", F.lit(-1)).alias("kind"), F.coalesce("s.hash", "_row").alias("hash"), "s.at", "s.left", "s.ctx")
    )
    on = (F.col("kind") == F.col("i_kind")) & (F.col("hash") == F.col("i_hash"))
    joined = found.join(small_side(prints, count), on, "left").select(
        "_row", "_id", "n_words", "item_id", "at", "left", "ctx", "kind", "i_left", "i_ctx"
    )
    kind = docs.schema[id_col].dataType.simpleString()
    # Dealt anew (seeds only, no texts), so that a task has one Python worker: two would stay for all later tasks.
    ranges = joined.repartition("_row").mapInArrow(
        lean(_extended(window, gram)), f"_row bigint, _id {kind}, n_words bigint, item_id string, start bigint, end bigint"
    )
    hit = F.col("start").isNotNull()
    # What is gathered per document is bounded by its own words and by the items.
    return ranges.groupBy("_row", "_id", "n_words").agg(
        F.collect_set(F.when(hit, F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.collect_set(F.when(hit, F.col("item_id")))).alias("item_ids"),
    ).withColumnRenamed("_id", id_col)


def hit_words(spans) -> F.Column:
    """How many words the ranges cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1)))))


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns.

    Only the numbers of rows that have hits are shuffled, to where those rows are scanned.
    """
    docs = from_files(docs)
    return without_rows(docs, contamination(docs, items, **options).where(F.size("spans") > 0))
