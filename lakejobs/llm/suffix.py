"""Repeated byte strings by suffix order and longest-previous-factor arrays.

A string of ``length`` bytes that repeats has the same smallest k-gram hash at each place; that
anchor decides the bucket a start belongs to, so equal strings always meet in one bucket. Starts of a
document with the same anchor form a segment. Segments that are alone in their bucket repeat nothing;
equal segments repeat wholly; only segments that share a bucket with different ones need their text.
There a suffix array is built over several whole buckets at a time; previous and next smaller places in
suffix order give each start its longest earlier match and the place of it. A bucket with very many
segments is divided once more by anchors in another order; what is still as large is dealt into
blocks, and what these leave open is settled by the strings' own digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.tables import Beside, beside_scan, by_part, from_files, lean, numbered, stored
from lakejobs.llm.textbytes import SLICE_BYTES, Spans, mix, slices, text_bytes, window_minima

LENGTH = 400
KGRAM = 64
CHUNK_BYTES = 8 << 20  # a longer text is worked through in overlapping parts
SORT_BYTES = 1 << 20  # text in one suffix array, about
BLOCK_SEGMENTS = 2_000
LEVELS = 1  # how often a bucket with more segments is divided by further anchors before it is dealt into blocks

_PLACE_BITS = 25


def ranks_by_doubling(data: np.ndarray, depth: int) -> list[np.ndarray]:
    """``ranks[i]`` orders the prefixes of length 8 * 2**i of all suffixes, the last at least ``depth`` long."""
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    high = np.zeros(n, np.uint64)
    for i in range(8):  # nine bits a byte: the end of the data sorts before every byte
        if i < 7:
            key = (key << np.uint64(9)) | padded[i : i + n]
        else:
            high = padded[i : i + n]
    first = _dense(key)
    rank = _dense(first.astype(np.uint64) << np.uint64(9) | high)
    ranks, size = [rank], 8
    while size < depth:
        ahead = np.zeros(n, np.int64)
        if n > size:
            ahead[: n - size] = rank[size:] + 1
        rank = _dense(rank.astype(np.uint64) * np.uint64(n + 2) + ahead.astype(np.uint64))
        ranks.append(rank)
        size *= 2
    return ranks


def _dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct keys."""
    order = np.argsort(keys, kind="quicksort")
    sorted_keys = keys[order]
    step = np.zeros(len(keys), np.int64)
    step[1:] = sorted_keys[1:] != sorted_keys[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(step)
    return out


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at ``a`` and ``b`` share, up to twice the depth of the ranks."""
    n = len(ranks[0])
    a, b, shared = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        step = np.where(same, 8 << level, 0)
        shared += step
        a, b = a + step, b + step
    return shared  # a multiple of eight, at most the true value


def previous_smaller(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier smaller value of the same (contiguous) group, or -1.

    Each round jumps along what is known so far; all values between an index and its jump are larger.
    """
    at = np.arange(-1, len(values) - 1)
    open_ = np.arange(len(values))
    while len(open_):
        there = at[open_]
        outside = (there < 0) | (group[np.maximum(there, 0)] != group[open_])
        at[open_[outside]] = -1
        open_ = open_[~outside]
        open_ = open_[values[at[open_]] > values[open_]]
        at[open_] = at[at[open_]]
    return at


def longest_previous(data: np.ndarray, starts: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``starts`` (ascending) the length of its longest match with an earlier one, and that one's index.

    Only matches of at least ``length`` count (else 0 and -1); ``room`` is how far a start's text reaches.
    """
    ranks = ranks_by_doubling(data, length)
    whole = ranks[-1][starts]
    # In suffix order; ties in the last rank are equal for at least ``length`` bytes and in order of place.
    order = np.lexsort((np.arange(len(starts)), whole))
    lpf, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    # A match that counts lies among neighbours that agree on ``length`` bytes.
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(~_equal_to(ranks, starts[order[:-1]], starts[order[1:]], length))
    for side, near in ((order, group), (order[::-1], group[::-1])):
        before = previous_smaller(side, near)
        has = before >= 0
        here, there = side[has], side[before[has]]
        shared = np.maximum(length, common_prefix(ranks, starts[here], starts[there]))
        shared = np.minimum(shared, np.minimum(room[here], room[there]))
        better = shared > lpf[here]
        lpf[here[better]], source[here[better]] = shared[better], there[better]
    return lpf, source


def _equal_to(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether ``length`` bytes from ``a`` and ``b`` are equal: two overlapping powers of two."""
    level = max(i for i in range(len(ranks)) if 8 << i <= length)
    size, rank = 8 << level, ranks[level]
    same, covered = np.ones(len(a), bool), 0
    while covered < length:
        at = min(covered, length - size)
        same &= rank[a + at] == rank[b + at]
        covered = at + size
    return same


def segments_of(data: np.ndarray, offsets: np.ndarray, base: np.ndarray, length: int, level: int = 0):
    """Segments of the starts whose whole string lies in its row: (row, x, starts, h, one, two), or None.

    ``base`` is the place of each row's first byte. Each ``level`` orders k-grams in its own way.
    """
    if len(data) < length:
        return None
    spans = Spans(data)
    at = np.arange(len(data) - KGRAM + 1)
    hashes = spans.hash(at, at + KGRAM)
    if level:
        hashes = mix(hashes ^ np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    # Hash above, place below (the last of equal ones wins), so the minimum tells where it is.
    low = np.uint64((1 << _PLACE_BITS) - 1)
    packed = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | (low - at.astype(np.uint64))
    anchor = (low - (window_minima(packed, length - KGRAM + 1) & low)).astype(np.int64)
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    if not len(row):
        return None
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    anchor = anchor[start]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) + 1
    first = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([first, [len(row)]]))
    x, r = start[first], row[first]
    end = x + size + length - 1
    place = (anchor[first] - x).astype(np.uint64)
    two = Spans(data ^ np.uint8(0x5A)).hash(x, end)
    return r, x - offsets[r] + base[r], size, hashes[anchor[first]], spans.hash(x, end) + mix(place), two


def _segment_batch(rows: np.ndarray, got: tuple) -> pa.RecordBatch:
    r, x, size, *digests = got
    columns = [pa.array(rows[r]), pa.array(x, pa.int64()), pa.array(size, pa.int32()), *[pa.array(d.view(np.int64)) for d in digests]]
    return pa.RecordBatch.from_arrays(columns, ["_row", "x", "starts", "h", "one", "two"])


def _segments(length: int):
    """Segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_row").to_numpy()
            data, offsets = text_bytes(batch.column("_text"))
            for a, b in slices(offsets, min(SLICE_BYTES, CHUNK_BYTES)):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                # A long text goes in parts that share the bytes a start needs.
                for c in range(0, max(len(part), 1), CHUNK_BYTES):
                    whole = len(part) <= CHUNK_BYTES
                    piece = part if whole else part[c : c + CHUNK_BYTES + length - 1]
                    bounds = at if whole else np.array([0, len(piece)])
                    got = segments_of(piece, bounds, np.full(len(bounds) - 1, c), length)
                    if got is not None:
                        yield _segment_batch(rows[a:b], got)

    return run


def _pieces(batch: pa.RecordBatch, beside: Beside, length: int):
    """Row, place, starts and bytes of the wanted segments in a batch's texts, and what else is known of them."""
    rows = batch.column("_row").to_numpy()
    found = beside.of(rows)
    if found is None:
        return None
    data, offsets = text_bytes(batch.column("_text"))
    x, starts = found.column("x").to_numpy(), found.column("starts").to_numpy()
    at = offsets[np.searchsorted(rows, found.column("_row").to_numpy())] + x
    return found, [data[p:q] for p, q in zip(at.tolist(), (at + starts + length - 1).tolist())]


def _divided(length: int, level: int, path: str):
    """Segments of the next level within the wanted ones; equal strings of a bucket stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Beside(path)
        for batch in by_part(batches):
            if (got := _pieces(batch, beside, length)) is None:
                continue
            found, pieces = got
            rows, x, h = (found.column(c).to_numpy() for c in ("_row", "x", "h"))
            offsets = np.cumsum([0, *map(len, pieces)])
            for a, b in slices(offsets):
                r, place, size, key, one, two = segments_of(np.concatenate(pieces[a:b]), offsets[a : b + 1] - offsets[a], x[a:b], length, level)
                key = mix(key + h[a:b][r].view(np.uint64) * np.uint64(31))
                yield _segment_batch(rows[a:b], (r, place, size, key, one, two))

    return run


def _cut(length: int, path: str):
    """The texts of the wanted segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Beside(path)
        for batch in by_part(batches):
            if (got := _pieces(batch, beside, length)) is not None:
                found, pieces = got
                names = ["h", "block", "split", "twice", "x", "starts", "_row"]
                columns = [found.column(c).combine_chunks() for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([p.tobytes() for p in pieces], pa.binary())], [*names, "bytes"])

    return run


def _matches(length: int, keep_first: bool):
    """Repeated starts within whole (bucket, block) groups, which come sorted; (_row, start, end, one, two).

    ``one`` and ``two`` are set, with the place of the start, for starts of split buckets that are to be
    compared between blocks.
    """

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        # In order of place, so that an earlier index is an earlier place.
        rows.sort(key=lambda r: (r[0], r[1]))
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        at = np.cumsum([0, *[len(r[3]) for r in rows]])
        counts = np.array([r[2] for r in rows])
        segment = np.repeat(np.arange(len(rows)), counts)
        inner = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = at[segment] + inner
        room = at[segment + 1] - starts
        lpf, source = longest_previous(data, starts, room, length)
        found = lpf >= length
        open_ = ~found
        if not keep_first:
            found = found.copy()
            found[source[lpf >= length]] = True
        row, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        twice, split = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        # Starts of segments that repeat wholly are known already, but for the first in keep-first order.
        told = found & ~twice[segment] if not keep_first else found
        run = np.flatnonzero(told)
        cut = np.flatnonzero((np.diff(run) != 1) | (segment[run[1:]] != segment[run[:-1]])) + 1 if len(run) else np.zeros(0, int)
        first = run[np.concatenate([[0], cut])] if len(run) else run
        last = run[np.concatenate([cut - 1, [len(run) - 1]])] if len(run) else run
        r = row[segment[first]].tolist()
        s = (x[segment[first]] + inner[first]).tolist()
        e = (x[segment[last]] + inner[last] + length).tolist()
        ask = np.flatnonzero(open_ & split[segment])
        one = Spans(data).hash(starts[ask], starts[ask] + length)
        two = Spans(data ^ np.uint8(0x5A)).hash(starts[ask], starts[ask] + length)
        place = (x[segment[ask]] + inner[ask]).tolist()
        nulls = [None] * len(r)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(r + row[segment[ask]].tolist(), pa.int64()), pa.array(s + place, pa.int64()), pa.array(e + [p + length for p in place], pa.int64()),
                pa.array(nulls + one.view(np.int64).tolist(), pa.int64()), pa.array(nulls + two.view(np.int64).tolist(), pa.int64()),
            ],
            ["_row", "start", "end", "one", "two"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, key = [], 0, None
        for batch in batches:
            names = ("h", "block", "_row", "x", "starts", "bytes", "twice", "split")
            for h, block, *rest in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
                if (h, block) != key and size >= SORT_BYTES:
                    yield solve(rows)
                    rows, size = [], 0
                key = (h, block)
                rows.append(tuple(rest))
                size += len(rest[3])
        if rows:
            yield solve(rows)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, text_col: str = "text") -> DataFrame:
    """(_row, start, end): byte ranges of each document row that strings repeated elsewhere cover, not merged.

    A string counts if its ``length`` bytes also start anywhere else, in the same text or another; with
    ``keep_first`` only if they start at an earlier place (row, then byte), so one copy of each stays.
    """
    if length < KGRAM:
        raise ValueError(f"length must be at least {KGRAM}")
    source = numbered(from_files(docs).select(F.col(text_col).alias("_text"))).select("_row", "_text")
    return _spans_of(source, stored(source.mapInArrow(lean(_segments(length)), _SEGMENT), "segments"), length, keep_first, 0)


_SEGMENT = "_row bigint, x bigint, starts int, h bigint, one bigint, two bigint"


def _spans_of(source: DataFrame, segments: DataFrame, length: int, keep_first: bool, level: int) -> DataFrame:
    """The repeated ranges among ``segments``."""
    shared = stored(segments.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    met = stored(segments.join(shared, "h"), "met")

    place = F.struct("_row", "x")
    groups = stored(met.groupBy("h", "one", "two", "starts").agg(F.count("*").alias("copies"), F.min(place).alias("rep")), "groups")
    buckets = stored(groups.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "buckets")
    equal = met.join(groups.where("copies > 1").select("h", "one", "two", "starts", "rep"), ["h", "one", "two", "starts"])
    if keep_first:
        equal = equal.where((F.col("_row") != F.col("rep._row")) | (F.col("x") != F.col("rep.x")))
    spans = equal.select("_row", F.col("x").alias("start"), (F.col("x") + F.col("starts") + (length - 1)).alias("end"))

    mixed = groups.join(buckets, "h")
    if level < LEVELS and not buckets.where(F.col("kinds") > BLOCK_SEGMENTS).isEmpty():
        path = _wanted(mixed.where(F.col("kinds") > BLOCK_SEGMENTS))
        divided = stored(source.mapInArrow(lean(_divided(length, level + 1, path)), _SEGMENT), "divided")
        spans = spans.unionByName(_spans_of(source, divided, length, keep_first, level + 1))
        mixed = mixed.where(F.col("kinds") <= BLOCK_SEGMENTS)
    texts = source.mapInArrow(
        lean(_cut(length, _wanted(mixed))), "h bigint, block int, split boolean, twice boolean, x bigint, starts int, _row bigint, bytes binary"
    )
    solved = stored(
        texts.repartition("h", "block").sortWithinPartitions("h", "block")
        .mapInArrow(lean(_matches(length, keep_first)), "_row bigint, start bigint, end bigint, one bigint, two bigint"),
        "matches",
    )
    within = solved.where("one is null").select("_row", "start", "end")

    # Between blocks of split buckets: strings that are first in their block, by their own digests.
    asked = solved.where("one is not null")
    again = asked.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(F.struct("_row", "start")).alias("first")).where("n > 1")
    across = asked.join(again, ["one", "two"])
    if keep_first:
        across = across.where((F.col("_row") != F.col("first._row")) | (F.col("start") != F.col("first.start")))
    return spans.unionByName(within).unionByName(across.select("_row", "start", "end"))


def _wanted(groups: DataFrame) -> str:
    """Where the representatives of ``groups`` are written for the tasks that scan their texts."""
    blocks = F.ceil(F.col("kinds") / BLOCK_SEGMENTS).cast("int")
    each = groups.select(
        F.col("rep._row").alias("_row"), "h", F.pmod(F.xxhash64("one", "two"), blocks).cast("int").alias("block"),
        (blocks > 1).alias("split"), (F.col("copies") > 1).alias("twice"), F.col("rep.x").alias("x"), "starts",
    )
    return beside_scan(each, "wanted")


def _without(path: str):
    """Each text without its ranges."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Beside(path)
        for batch in by_part(batches):
            rows = batch.column("_row").to_numpy()
            data, offsets = text_bytes(batch.column("_text"))
            merged: list[list] = [[] for _ in rows]
            if (found := beside.of(rows)) is not None:
                row, start, end = (found.column(c).to_numpy() for c in ("_row", "start", "end"))
                order = np.lexsort((start, row))
                for i, s, e in zip(np.searchsorted(rows, row[order]).tolist(), start[order].tolist(), end[order].tolist()):
                    spans = merged[i]
                    if spans and s <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], e)
                    else:
                        spans.append({"start": s, "end": e})
            texts = []
            for i, spans in enumerate(merged):
                text, at, parts = data[offsets[i] : offsets[i + 1]].tobytes(), 0, []
                for span in spans:
                    parts.append(text[at : span["start"]])
                    at = span["end"]
                texts.append(b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_id"), pa.array(np.diff(offsets)), pa.array(merged, kind), pa.array(texts, pa.binary())],
                ["_row", "_id", "n_bytes", "spans", "kept"],
            )

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: (_row, id, n_bytes, spans, kept): maximal removed byte ranges and the bytes left.

    A null text is empty. Rows with equal ids stay apart; an empty table gives no rows; other columns
    are not read. ``kept`` is binary: a removed range may end inside a character.
    """
    docs = from_files(docs)
    path = beside_scan(repeated_spans(docs, length, keep_first, text_col), "ranges")
    source = numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))).select("_row", "_id", "_text")
    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(
        lean(_without(path)), f"_row bigint, _id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    ).withColumnRenamed("_id", id_col)
