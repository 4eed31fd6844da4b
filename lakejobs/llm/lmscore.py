"""Stupid-backoff scores of documents, computed relationally.

Documents are exploded to hashed n-grams, counts are tables over all documents dealt by that hash,
n-grams are joined to their counts, and logarithms are summed per document. A word's score is
count(n-gram) / count(its first n-1 words) for the longest n-gram up to ``order`` that the counts hold,
times ``alpha`` for each word of context given up; a single word's is count / words.

:func:`score_documents` joins any documents to given counts. :func:`score_corpus` scores documents by
the counts of those same documents: there every n-gram is held, so a document's score is a signed sum
of log counts over its n-grams and their contexts, and counting and joining share one shuffle in which
a task's n-grams travel packed by hash range, and their sums travel back packed by documents. The most frequent words and n-grams do not take part in it:
their counts are added up per task first.

:func:`score_held_out` scores documents by the counts of all *other* documents: a document's own
occurrences are taken off each count before it is used, so an n-gram that stands nowhere else is not held
and its score backs off. The n-grams of a pack of documents are dealt by hash range as sorted differences with the
pack's counts, counted there over all packs, and those that other packs hold go back to their pack, where a second
scan of its documents takes off their own occurrences and sums their words' scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.tables import PART_BITS, Beside, beside_scan, by_part, from_files, kept, lean, numbered, read_part, small_side, stored, with_row
from lakejobs.llm.textbytes import grams, mix, slices, text_bytes, words
from lakejobs.session import scratch_path

ORDER = 2
HELD_OUT_ORDER = 3
ALPHA = 0.4
HOT_WORDS = 60_000  # single words (or n-grams) whose exact counts are handed to every task
BUCKET_GRAMS = 2_000_000  # n-gram entries of a hash range, about
PACK_BYTES = 4 << 20  # text whose n-grams are packed together
HELD_PACK_BYTES = 8 << 20  # the same where documents are scored by all others
BYTES_PER_GRAM = 4  # of text, for each distinct n-gram of a pack and size, about
HOT_SHARE = 8  # an n-gram held by more than one in so many packed documents is added up per pack first
MICRO = 1_000_000  # scores are summed as integers, so the order of adding does not matter


def _grams(data: np.ndarray, offsets: np.ndarray, order: int):
    """Words, and per size 1..order the n-grams (hash, index of first word). Hashes differ between sizes."""
    w = words(data, offsets)
    return w, [grams(w.hashes, w.row, size) for size in range(1, order + 1)]


def _per_row(row: np.ndarray, hashes: np.ndarray, values: np.ndarray):
    """Distinct (row, hash) with the sums of ``values`` (columns)."""
    order = np.lexsort((hashes, row))
    row, hashes, values = row[order], hashes[order], values[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return row[at], hashes[at], np.add.reduceat(values, at, axis=0) if len(at) else values[:0]


def _summed(hashes: np.ndarray, values: np.ndarray):
    keys, place = np.unique(hashes, return_inverse=True)
    return keys, np.bincount(place, weights=values, minlength=len(keys)).astype(np.int64)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return with_row(docs.select(F.col(text_col).alias("_text"))).select("_row", "_text")


def ngram_counts(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """(size, h, n): how often each n-gram of 1 to ``order`` words stands in all documents together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            for a, b in slices(offsets, PACK_BYTES):
                _, found = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], order)
                for size, (hashes, _) in enumerate(found, 1):
                    keys, n = _summed(hashes, np.ones(len(hashes)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), size, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["size", "h", "n"])

    return _texts(docs, text_col).mapInArrow(run, "size int, h bigint, n bigint").groupBy("size", "h").agg(F.sum("n").alias("n"))


def score_documents(
    docs: DataFrame, counts: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(_row, id, n_words, micros): the sum of log scores in millionths, by counts of any corpus.

    A word the counts do not hold counts as held once. ``micros`` of a text without words is 0.
    """
    source = with_row(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_row").to_numpy()
            data, offsets = text_bytes(batch.column("_text"))
            for a, b in slices(offsets):
                w, found = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], order)
                ends = np.arange(len(w.hashes))
                table = np.zeros((len(ends), order + 1, 2), np.int64)  # per last word and size: n-gram, its context
                for size, (hashes, at) in enumerate(found, 1):
                    table[at + size - 1, size, 0] = hashes.view(np.int64)
                    if size > 1:
                        shorter = np.zeros(len(ends), np.int64)
                        shorter[found[size - 2][1]] = found[size - 2][0].view(np.int64)
                        table[at + size - 1, size, 1] = shorter[at]
                longest = np.minimum(ends - w.first[w.row] + 1, order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[a:b][w.row]), pa.array(longest, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * (2 * order + 2)), pa.array(table.ravel()))],
                    ["_row", "size", "keys"],
                )

    exploded = source.select("_row", "_text").mapInArrow(run, "_row bigint, size int, keys array<bigint>")
    counts = kept(counts)
    total = counts.where("size = 1").agg(F.sum("n")).first()[0] or 1
    open_ = exploded.groupBy("_row", "size", "keys").agg(F.count("*").alias("times"))
    parts, lost = None, 0.0
    for size in range(order, 0, -1):
        key = lambda which: F.element_at("keys", 2 * F.col("size") + 1 + which)
        table = counts.where(F.col("size") == size).select(F.col("h").alias("_h"), F.col("n").alias("_n"))
        here = open_.where(F.col("size") == size).withColumn("_key", key(0))
        joined = here.join(table, F.col("_key") == F.col("_h"), "left")
        if size > 1:
            shorter = counts.where(F.col("size") == size - 1).select(F.col("h").alias("_c"), F.col("n").alias("_m"))
            held = joined.where("_n is not null").withColumn("_ctx", key(1)).join(shorter, F.col("_ctx") == F.col("_c"))
            score = F.log(F.col("_n")) - F.log(F.col("_m"))
        else:
            held = joined
            score = F.log(F.coalesce("_n", F.lit(1))) - F.lit(math.log(total))
        backed = score + F.coalesce("lost", F.lit(0.0)) if "lost" in open_.columns else score
        part = held.select("_row", (F.round(backed * MICRO).cast("bigint") * F.col("times")).alias("micros"))
        parts = part if parts is None else parts.unionByName(part)
        if size > 1:
            lost_here = (F.coalesce("lost", F.lit(0.0)) if "lost" in open_.columns else F.lit(0.0)) + math.log(alpha)
            given_up = joined.where("_n is null").select("_row", (F.col("size") - 1).alias("size"), "keys", "times", lost_here.alias("lost"))
            rest = open_.where(F.col("size") < size)
            rest = rest if "lost" in rest.columns else rest.withColumn("lost", F.lit(0.0))
            open_ = rest.select("_row", "size", "keys", "times", "lost").unionByName(given_up)
    sums = parts.groupBy("_row").agg(F.sum("micros").alias("micros"))
    sizes = exploded.groupBy("_row").agg(F.count("*").alias("n_words"))
    joined = source.select("_row", "_id").join(sizes, "_row", "left").join(sums, "_row", "left")
    return joined.select("_row", F.col("_id").alias(id_col), F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("micros", F.lit(0)).alias("micros"))


# --- documents scored by their own corpus ---------------------------------------------------------


def _micros(count) -> np.ndarray:
    return np.rint(np.log(np.maximum(count, 1)) * MICRO).astype(np.int64)


def _demands(w, found, order: int):
    """(row, hash, is single word, (occurrences, weight)): a score is the sum of weight * log count.

    Each word adds its longest n-gram and takes off that n-gram's context; a first word, which has no
    context, takes off the log of all words instead (left to the caller).
    """
    rows, hashes, single, values = [], [], [], []
    longest = np.minimum(np.arange(len(w.hashes)) - w.first[w.row] + 1, order)
    for size, (h, at) in enumerate(found, 1):
        add = (longest[at + size - 1] == size).astype(np.int64)
        after = np.minimum(at + size, max(len(w.hashes) - 1, 0))  # the word that has this n-gram as context
        context = (at + size < len(w.hashes)) & (w.row[after] == w.row[at]) & (longest[after] == size + 1)
        rows.append(w.row[at])
        hashes.append(h)
        single.append(np.full(len(at), size == 1))
        values.append(np.stack([np.ones(len(at), np.int64), add - context], 1))
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(single), np.concatenate(values)


# A row is one of: the n-grams of a pack of documents in one hash range (keys, and per document how many,
# occurrences and weights; ids of the documents, or null where they go up from base by one); a frequent
# n-gram and the documents that wait for its count; what the documents of a pack have without the shuffle
# (micros, and their words). Counting gives back a row per pack and hash range as well: the places in the
# pack (at) of documents that gain something, and what they gain (micros).
_PACK = {
    "bucket": ("int", pa.int32()), "keys": ("binary", pa.binary()), "sizes": ("binary", pa.binary()), "occurs": ("binary", pa.binary()),
    "weights": ("binary", pa.binary()), "base": ("bigint", pa.int64()), "ids": ("binary", pa.binary()), "h": ("bigint", pa.int64()),
    "waiting": ("array<bigint>", pa.list_(pa.int64())), "waiting_weights": ("array<bigint>", pa.list_(pa.int64())),
    "micros": ("binary", pa.binary()), "n_words": ("binary", pa.binary()),
}
_COUNTED = {k: _PACK[k] for k in ("h", "waiting", "waiting_weights", "base", "ids", "micros", "n_words")} | {
    "at": ("binary", pa.binary()), "n": ("bigint", pa.int64()),
}


def _ddl(columns: dict) -> str:
    return ", ".join(f"{name} {kind}" for name, (kind, _) in columns.items())


def _batch(columns: dict, values: dict, count: int) -> pa.RecordBatch:
    arrays = [pa.array(values[n], t) if n in values else pa.nulls(count, t) for n, (_, t) in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _pack(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, order: int, buckets: int, hot_keys, hot_logs) -> Iterator[pa.RecordBatch]:
    """The demands of one pack of documents."""
    count = len(ids)
    parts, direct, n_words = [], np.zeros(count, np.int64), np.zeros(count, np.int64)
    for c, d in slices(offsets):
        w, found = _grams(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c], order)
        row, h, single, value = _demands(w, found, order)
        n_words[c:d] = np.diff(w.first)
        if len(hot_keys):
            place = np.minimum(np.searchsorted(hot_keys, h), len(hot_keys) - 1)
            known = single & (hot_keys[place] == h)
            gained = value[known, 1] * hot_logs[place[known]]
            direct[c:d] += np.bincount(row[known], weights=gained, minlength=d - c).astype(np.int64)
            row, h, value = row[~known], h[~known], value[~known]
        row, h, value = _per_row(row, h, value)
        parts.append(((row + c).astype(np.int32), h, value.astype(np.int32)))
        del w, found, single
    row, h, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
    parts.clear()
    base, in_line = int(ids[0]), bool((np.diff(ids) == 1).all())
    numbers = None if in_line else ids.tobytes()
    yield _batch(_PACK, {"bucket": [base % buckets], "base": [base], "ids": [numbers], "micros": [direct.tobytes()], "n_words": [n_words.tobytes()]}, 1)
    if not len(h):
        return
    keys, place, held_by = np.unique(h, return_inverse=True, return_counts=True)
    often = held_by > max(count // HOT_SHARE, 16)
    many = often[place]
    if many.any():  # one entry with the pack's count; the documents wait for the total beside it
        total = np.bincount(place[many], weights=value[many, 0], minlength=len(keys)).astype(np.int64)[often]
        by = np.flatnonzero(many)[np.argsort(place[many], kind="stable")]
        cuts = np.flatnonzero(np.diff(place[by])) + 1
        groups = np.split(by, cuts)
        yield _batch(
            _PACK,
            {
                "bucket": [(base + k) % buckets for k in range(len(groups))], "h": h[[g[0] for g in groups]].view(np.int64),
                "waiting": [ids[row[g]] for g in groups], "waiting_weights": [value[g, 1] for g in groups],
            },
            len(groups),
        )
        row = np.concatenate([row[~many], np.full(int(often.sum()), count, np.int32)])
        h = np.concatenate([h[~many], keys[often]])
        value = np.concatenate([value[~many], np.stack([total, np.zeros_like(total)], 1).astype(np.int32)])
    del keys, place, held_by, often, many
    bucket = (mix(h ^ np.uint64(0xABCDEF)) % np.uint64(buckets)).astype(np.int32)
    by = np.lexsort((row, bucket))
    bucket, row, h, value = bucket[by], row[by], h[by], value[by]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
    packs = [(p, s, e) for p, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
    yield _batch(
        _PACK,
        {
            "bucket": [p for p, _, _ in packs],
            "keys": [h[s:e].tobytes() for _, s, e in packs],
            "sizes": [np.bincount(row[s:e], minlength=count + 1).astype("<u4").tobytes() for _, s, e in packs],
            "occurs": [value[s:e, 0].astype("<i4").tobytes() for _, s, e in packs],
            "weights": [value[s:e, 1].astype("<i4").tobytes() for _, s, e in packs],
            "base": [base] * len(packs),
            "ids": [numbers] * len(packs),
        },
        len(packs),
    )


def _packed(order: int, buckets: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_row").to_numpy()
            data, offsets = text_bytes(batch.column("_text"))
            for a, b in slices(offsets, PACK_BYTES):
                yield from _pack(ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], order, buckets, *hot.value)

    return run


def _count_range(packs: list[dict]) -> Iterator[pa.RecordBatch]:
    """Counts of one hash range and what they give its packs; (h, n) of the frequent n-grams."""
    keys = np.concatenate([np.frombuffer(p["keys"], np.uint64) for p in packs])
    occurs = np.concatenate([np.frombuffer(p["occurs"], "<i4") for p in packs])
    distinct, place = np.unique(keys, return_inverse=True)
    count = np.bincount(place, weights=occurs, minlength=len(distinct)).astype(np.int64)
    logs, at, frequent, gains = _micros(count), 0, [], []
    for p in packs:
        sizes = np.frombuffer(p["sizes"], "<u4")
        docs = len(sizes) - 1
        row, weight = np.repeat(np.arange(docs + 1), sizes), np.frombuffer(p["weights"], "<i4")
        here = place[at : at + len(row)]
        at += len(row)
        frequent.append(here[row == docs])
        sums = np.bincount(row, weights=logs[here] * weight, minlength=docs + 1).astype(np.int64)[:-1]
        some = np.flatnonzero(sums)
        if len(some):
            gains.append({"base": p["base"], "at": some.astype("<u4").tobytes(), "micros": sums[some].tobytes()})
    yield _batch(_COUNTED, {n: [g[n] for g in gains] for n in ("base", "at", "micros")}, len(gains))
    often = np.unique(np.concatenate(frequent))
    yield _batch(_COUNTED, {"h": distinct[often].view(np.int64), "n": count[often]}, len(often))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, packs = None, []
    for batch in batches:  # sorted by bucket
        beside = batch.filter(batch.column("keys").is_null())
        if beside.num_rows:
            yield _batch(_COUNTED, {n: beside.column(n) for n in _COUNTED if n in _PACK}, beside.num_rows)
        for p in batch.filter(batch.column("keys").is_valid()).select(["bucket", "keys", "sizes", "occurs", "weights", "base", "ids"]).to_pylist():
            if p["bucket"] != bucket and packs:
                yield from _count_range(packs)
                packs = []
            bucket = p["bucket"]
            packs.append(p)
    if packs:
        yield from _count_range(packs)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, micros, n_words) of each document, from all rows of its pack."""

    def documents(rows: list[dict]) -> pa.RecordBatch:
        whole = next(r for r in rows if r["n_words"] is not None)
        micros = np.frombuffer(whole["micros"], np.int64).copy()
        for r in rows:
            if r["at"] is not None:
                micros[np.frombuffer(r["at"], "<u4")] += np.frombuffer(r["micros"], np.int64)  # places are distinct
        ids = np.frombuffer(whole["ids"], np.int64) if whole["ids"] is not None else whole["base"] + np.arange(len(micros))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(micros), pa.array(np.frombuffer(whole["n_words"], np.int64))], ["_row", "micros", "n_words"])

    rows: list[dict] = []
    for batch in batches:  # sorted by base
        for r in batch.to_pylist():
            if rows and r["base"] != rows[0]["base"]:
                yield documents(rows)
                rows = []
            rows.append(r)
    if rows:
        yield documents(rows)


def _hot_words(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (sorted) and log counts of the most frequent words, at most :data:`HOT_WORDS`; and all words."""
    keys, n, total = _most_frequent(kept(ngram_counts(docs, 1, text_col).select("h", "n")))
    return keys, _micros(n), total


def _most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (sorted) and counts of the most frequent rows of (h, n), at most :data:`HOT_WORDS`; and the sum of all n."""
    step = F.floor(F.log2("n") * 8)
    total, floor, held = 0, None, 0
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("c"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    for row in steps:  # a few hundred
        total += row["n"]
        held += row["c"]
        if held <= HOT_WORDS:
            floor = row["step"]
    if floor is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), total
    table = counts.where(step >= floor).toArrow()
    keys, n = table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order], total


def score_corpus(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, id, n_words, micros): as :func:`score_documents` with the counts of ``docs`` themselves.

    Null texts have no words (0 words, 0 micros); rows with equal ids stay apart and both count; other
    columns are not read. Counts cover every document; n-grams are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    hot_keys, hot_logs, total = _hot_words(docs, text_col)
    hot = spark.sparkContext.broadcast((hot_keys, hot_logs))
    buckets = max(spark.sparkContext.defaultParallelism, -(-total * order // BUCKET_GRAMS))
    demands = _texts(docs, text_col).mapInArrow(_packed(order, buckets, hot), _ddl(_PACK))
    dealt = demands.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    counted = stored(dealt.mapInArrow(_counted, _ddl(_COUNTED)), "counted")
    frequent = counted.where("n is not null").select("h", "n")
    waiting = counted.where("waiting is not null").select("h", "waiting", "waiting_weights").join(small_side(frequent.distinct()), "h")
    each = waiting.select("n", F.explode(F.arrays_zip("waiting", "waiting_weights")).alias("w"))
    late = each.select(F.col("w.waiting").alias("_row"), (F.round(F.log("n") * MICRO).cast("bigint") * F.col("w.waiting_weights")).alias("micros"))
    packs = counted.where("base is not null").select("base", "ids", "at", "micros", "n_words")
    gathered = packs.repartition("base").sortWithinPartitions("base").mapInArrow(_gathered, "_row bigint, micros bigint, n_words bigint")
    sums = (
        gathered
        .unionByName(late.withColumn("n_words", F.lit(None).cast("bigint")))
        .groupBy("_row").agg(F.sum("micros").alias("micros"), F.sum("n_words").alias("n_words"))
    )
    ids = with_row(docs.select(F.col(id_col).alias("_id")))
    whole = F.lit(int(round(math.log(max(total, 1)) * MICRO)))
    # A word without context takes off the log of all words: a text's first, or with order 1 each.
    alone = F.col("n_words") if order == 1 else F.least("n_words", F.lit(1))
    return ids.join(sums, "_row").select(
        "_row", F.col("_id").alias(id_col), "n_words", (F.col("micros") - whole * alone).cast("bigint").alias("micros")
    )


# --- documents scored by all other documents ------------------------------------------------------

# A row is a pack's n-grams in one hash range (first, bucket, count, block: how often the pack holds each, and
# after counting what all other packs together hold of them), or the pack itself (first, docs, words).
_HELD = {
    "bucket": ("int", pa.int32()), "first": ("bigint", pa.int64()), "count": ("int", pa.int32()), "block": ("binary", pa.binary()),
    "docs": ("bigint", pa.int64()), "words": ("bigint", pa.int64()),
}
_ZSTD = pa.Codec("zstd", compression_level=1)


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one block: first all lowest bytes, then all next ones; most higher bytes are zeros."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes() for c in columns]
    return _ZSTD.compress(b"".join(planes), asbytes=True)


def _unsqueezed(block: bytes, count: int, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    data = np.frombuffer(_ZSTD.decompress(block, count * sum(sizes)), np.uint8)
    cuts = np.cumsum([0, *sizes]) * count
    return [np.ascontiguousarray(data[a:b].reshape(-1, count).T).view(k).ravel() for a, b, k in zip(cuts, cuts[1:], kinds)]


def _steps(ascending: np.ndarray) -> np.ndarray:
    """The first value and the differences (modulo the type) to the next ones; ``np.cumsum`` undoes it."""
    steps = ascending.copy()
    steps[1:] -= ascending[:-1]
    return steps


def _sorted_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of non-negative ``keys``, and the keys in that order."""
    bits = max(len(keys) - 1, 1).bit_length()
    if len(keys) and int(keys.max()) >> (63 - bits) == 0:  # one sort of numbers, the places in their low bits
        both = np.sort(keys << bits | np.arange(len(keys)))
        return both & ((1 << bits) - 1), both >> bits
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


def _by_high_bits(hashes: np.ndarray) -> np.ndarray:
    """An order of ``hashes`` that is ascending but for those whose high bits are equal, which stay in order of place."""
    low = np.uint64((1 << max(len(hashes) - 1, 1).bit_length()) - 1)
    return (np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)) & low).astype(np.int64)


def _changes(*sorted_columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before; the first does."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


class _Pack:
    """The n-grams of 1 to ``order`` words of a few whole documents.

    ``sizes`` has per size, for each n-gram in order of place: the index of its first word, its number among
    the pack's distinct n-grams, and how often its own document holds it; it is left empty without ``own``.
    ``hashes`` and ``counts`` are those of the distinct n-grams of all sizes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, order: int, own: bool):
        parts = []
        for a, b in slices(offsets):
            w = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            parts.append((w.hashes, w.row + a, np.diff(w.first)))
        hashes, self.row, self.n_words = (np.concatenate([p[i] for p in parts]) for i in range(3))
        self.first = np.cumsum(self.n_words) - self.n_words
        self.sizes, known, counts, base = [], [], [], 0
        single = shorter = None
        for size in range(1, order + 1):
            h, at = grams(hashes, self.row, size)
            if size == 1:
                by = _by_high_bits(h)
                keys = h[by]
                if (keys[1:] < keys[:-1]).any():  # different words with equal high bits
                    by = np.argsort(h, kind="stable")
                    keys = h[by]
            else:  # numbers instead of hashes: that of the first words, that of the last one
                by, keys = _sorted_places(shorter[at] * np.int64(single.max(initial=0) + 1) + single[at + size - 1])
            new = _changes(keys)
            heads = np.flatnonzero(new)
            known.append(h[by[heads]])
            counts.append(np.diff(np.append(heads, len(by))))
            if own or size < order:
                shorter = np.zeros(len(hashes), np.int64)
                shorter[at[by]] = np.cumsum(new) - 1
                single = shorter if single is None else single
            if own:
                starts = np.flatnonzero(new | _changes(self.row[at[by]]))
                times, held = np.diff(np.append(starts, len(by))), np.empty(len(by), np.int64)
                held[by] = np.repeat(times, times)
                self.sizes.append((at, shorter[at] + base, held))
            base += len(heads)
        self.hashes, self.counts = np.concatenate(known), np.concatenate(counts)

    def by_range(self, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The distinct n-grams, about in order of hash, and (bucket, from, to) of each hash range that has any."""
        by = _by_high_bits(self.hashes)
        bucket = (self.hashes[by] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
        cuts = np.flatnonzero(_changes(bucket)).tolist()
        return by, [(int(bucket[a]), a, b) for a, b in zip(cuts, [*cuts[1:], len(by)])]


def _held_packs(order: int, buckets: int):
    """Rows of :data:`_HELD` for runs of documents of one part that follow each other, of :data:`HELD_PACK_BYTES` or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            rows, data, offsets = _joined(parts)
            pack = _Pack(data, offsets, order, own=False)
            by, ranges = pack.by_range(buckets)
            h, n, count = pack.hashes[by], pack.counts[by].astype("<i8"), len(ranges)
            first, spread = int(rows[0]), int(rows[0]) % buckets
            values = {
                "bucket": [p for p, _, _ in ranges] + [spread], "first": [first] * (count + 1), "count": [b - a for _, a, b in ranges] + [None],
                "block": [_squeezed(_steps(h[a:b]), n[a:b]) for _, a, b in ranges] + [None],
                "docs": [None] * count + [len(rows)], "words": [None] * count + [len(pack.row)],
            }
            return _batch(_HELD, values, count + 1)

        parts, size = [], 0
        for batch in by_part(batches):
            rows = batch.column("_row").to_numpy()
            data, offsets = text_bytes(batch.column("_text"))
            if parts and (rows[0] < parts[-1][0][-1] or rows[0] >> PART_BITS != parts[-1][0][-1] >> PART_BITS):
                yield packed(parts)
                parts, size = [], 0
            for a, b in slices(offsets, HELD_PACK_BYTES // 4):
                if parts and size + offsets[b] - offsets[a] > HELD_PACK_BYTES:
                    yield packed(parts)
                    parts, size = [], 0
                parts.append((rows[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                size += offsets[b] - offsets[a]
        if parts:
            yield packed(parts)

    return run


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, bytes and offsets of texts that come in parts."""
    ends = np.cumsum([0, *[len(d) for _, d, _ in parts]])
    offsets = np.concatenate([[0], *[o[1:] + e for (_, _, o), e in zip(parts, ends)]])
    return np.concatenate([r for r, _, _ in parts]), np.concatenate([d for _, d, _ in parts]), offsets


def _others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pack and hash range, which of its n-grams other packs hold, and how often."""

    def counted(packs: list[dict]) -> Iterator[pa.RecordBatch]:
        blocks = [_unsqueezed(p["block"], p["count"], "<u8", "<i8") for p in packs]
        keys, n = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in blocks]), np.concatenate([n for _, n in blocks])
        del blocks
        by = np.argsort(keys)
        new = _changes(keys[by])
        total = np.add.reduceat(n[by], np.flatnonzero(new))
        others = np.empty(len(by), np.int64)
        others[by] = total[np.cumsum(new) - 1]
        others -= n
        at = 0
        for p in packs:
            some = np.flatnonzero(others[at : at + p["count"]])
            if len(some):
                block = _squeezed(_steps(some.astype("<u4")), others[at + some])
                yield _batch(_HELD, {"bucket": [p["bucket"]], "first": [p["first"]], "count": [len(some)], "block": [block]}, 1)
            at += p["count"]

    packs: list[dict] = []
    for batch in batches:  # sorted by bucket
        yield batch.filter(batch.column("block").is_null())
        for p in batch.filter(batch.column("block").is_valid()).select(["bucket", "first", "count", "block"]).to_pylist():
            if packs and p["bucket"] != packs[0]["bucket"]:
                yield from counted(packs)
                packs = []
            packs.append(p)
    if packs:
        yield from counted(packs)


def _backed_off(pack: _Pack, others: np.ndarray, order: int, alpha: float, total: int) -> np.ndarray:
    """The score of each document in millionths; ``others`` is what other packs hold of each distinct n-gram."""
    everywhere = pack.counts + others
    held = np.zeros((order + 1, len(pack.row)), np.int64)  # per size and last word: how often other documents hold it
    for size, (at, number, own) in enumerate(pack.sizes, 1):
        held[size, at + size - 1] = everywhere[number] - own
    level = np.minimum(np.arange(len(pack.row)) - pack.first[pack.row] + 1, order)
    lost = np.zeros(len(pack.row))
    score = np.zeros(len(pack.row))
    for size in range(order, 1, -1):
        here = np.flatnonzero(level == size)
        gone = here[held[size, here] == 0]
        level[gone] -= 1
        lost[gone] += math.log(alpha)
        here = here[held[size, here] > 0]
        score[here] = np.log(held[size, here]) - np.log(held[size - 1, here - 1])
    last = np.flatnonzero(level == 1)
    score[last] = np.log(np.maximum(held[1, last], 1)) - np.log(np.maximum(total - pack.n_words[pack.row[last]], 1))
    return np.bincount(pack.row, weights=np.rint((score + lost) * MICRO), minlength=len(pack.n_words)).astype(np.int64)


def _scored(order: int, alpha: float, buckets: int, total: int, packs_path: str, others_path: str):
    """(_row, _id, n_words, micros, _text) of documents in ascending runs of rows.

    Where a task does not see all documents of a pack, because files were split otherwise when packs were made, it
    gives back their texts instead of a score.
    """

    def scores(parts: list, ids: list, first: int) -> pa.RecordBatch:
        rows, data, offsets = _joined(parts)
        pack = _Pack(data, offsets, order, own=True)
        by, ranges = pack.by_range(buckets)
        starts, others = {p: a for p, a, _ in ranges}, np.zeros(len(by), np.int64)
        found = read_part(others_path, "pack", first)
        for p in found.select(["bucket", "count", "block"]).to_pylist() if found is not None else []:
            at, n = _unsqueezed(p["block"], p["count"], "<u4", "<i8")
            others[by[starts[p["bucket"]] + np.cumsum(at, dtype=np.int64)]] = n
        micros = _backed_off(pack, others, order, alpha, total)
        count = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.concat_arrays(ids), pa.array(pack.n_words), pa.array(micros), pa.nulls(count, pa.string())],
            ["_row", "_id", "n_words", "micros", "_text"],
        )

    def left(parts: list, ids: list, texts: list) -> pa.RecordBatch:
        rows = np.concatenate([r for r, _, _ in parts])
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.concat_arrays(ids), none, none, pa.concat_arrays(texts).fill_null("")], ["_row", "_id", "n_words", "micros", "_text"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Beside(packs_path)
        parts, ids, texts, first, missing = [], [], [], None, 0

        def done() -> pa.RecordBatch:
            return left(parts, ids, texts) if missing else scores(parts, ids, first)

        for batch in by_part(batches):
            rows = batch.column("_row").to_numpy()
            beside.of(rows)  # all packs of the part
            data, offsets = text_bytes(batch.column("_text"))
            pack = np.searchsorted(beside.rows, rows, "right") - 1
            cuts = np.append(np.flatnonzero(_changes(pack)), len(rows)).tolist()
            for a, b in zip(cuts, cuts[1:]):
                here = int(beside.rows[pack[a]])
                if parts and (here != first or rows[a] < parts[-1][0][-1]):
                    yield done()
                    parts, ids, texts = [], [], []
                if not parts:
                    first, missing = here, beside.table.column("docs")[int(pack[a])].as_py()
                parts.append((rows[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                ids.append(batch.column("_id").slice(a, b - a))
                texts.append(batch.column("_text").slice(a, b - a))
                missing -= b - a
        if parts:
            yield done()

    return run


def score_held_out(
    docs: DataFrame, order: int = HELD_OUT_ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(_row, id, n_words, micros): as :func:`score_documents`, each document by the counts of all others.

    A word no other document holds counts as held once, and all words are those of the others (at least
    1). A document with a copy is scored by its copy as well. Null texts have no words (0 words, 0
    micros); rows with equal ids stay apart and both count; other columns are not read. N-grams are told
    apart by 64-bit hashes. A hash range has an n-gram once per pack, however frequent it is.
    """
    spark = docs.sparkSession
    docs = from_files(docs)
    source = numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))).select("_row", "_id", "_text")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("bigint"))).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, -(-size * order // (BYTES_PER_GRAM * BUCKET_GRAMS)))
    packed = source.select("_row", "_text").mapInArrow(lean(_held_packs(order, buckets)), _ddl(_HELD))
    dealt = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    counted = stored(dealt.mapInArrow(lean(_others), _ddl(_HELD)), "counted")
    packs = counted.where("block is null").select(F.col("first").alias("_row"), "docs", "words")
    total = packs.agg(F.sum("words")).first()[0] or 0
    others_path = scratch_path(spark, "others")
    others = counted.where("block is not null").select(F.col("first").alias("pack"), "bucket", "count", "block")
    others.repartition("pack").sortWithinPartitions("pack").write.partitionBy("pack").parquet(others_path)
    kind = source.schema["_id"].dataType.simpleString()
    score = lean(_scored(order, alpha, buckets, total, beside_scan(packs, "packs"), others_path))
    schema = f"_row bigint, _id {kind}, n_words bigint, micros bigint, _text string"
    scanned = stored(source.mapInArrow(score, schema), "scores")
    # Texts of packs that were cut: a part's documents meet again, in order.
    cut = scanned.where("_text is not null").select("_row", "_id", "_text", F.shiftright("_row", PART_BITS).alias("_part"))
    whole = cut.repartition("_part").sortWithinPartitions("_row").select("_row", "_id", "_text").mapInArrow(score, schema)
    scored = scanned.where("_text is null").unionByName(whole)
    return scored.select("_row", F.col("_id").alias(id_col), "n_words", "micros")
