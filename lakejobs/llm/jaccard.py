"""N-gram Jaccard join: MinHash banding, verified on whole n-gram sets.

A document's set holds its runs of five words (one run of all its words, if it has fewer). Documents
with equal sets are one class and are represented by one row. Band hashes of representatives are
shuffled; a bucket that two or more classes share is a set of candidates. Buckets with the same members
are worked through once; a large bucket is dealt into blocks, and each pair of blocks is a task of
its own, so no task holds more than two blocks. A pair is verified in the first bucket it shares, on
the sets made again from the texts, and links are added up per document where they are found: pairs
are never rows. Groups are the connected components of a spanning set of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.components import components
from lakejobs.llm.tables import Beside, beside_scan, by_part, executors_hand_back, from_files, kept, lean, numbered, stored, without_rows
from lakejobs.llm.textbytes import grams, mix, slices, text_bytes, words

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9995  # of pairs at the threshold; more similar ones are found more surely
BLOCK = 256  # members of a block, about
BLOCK_GRAMS = 400_000  # distinct n-grams of its members together, about, or one longer text
CELL_ROWS = 200_000
COLUMNS = 4096  # n-grams compared at a time


def bands_for(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which the target recall takes at most ``most_hashes`` hashes."""
    best = None
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows) + 1e-15)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"recall {recall} at {threshold} takes more than {most_hashes} hashes")
    return best


def shingle_sets(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, n-gram hash) of all rows, in order."""
    w = words(data, offsets)
    counts = np.diff(w.first)
    found = [grams(w.hashes, w.row, gram)]
    for size in range(1, gram):
        hashes, at = grams(w.hashes, w.row, size)
        whole = counts[w.row[at]] == size
        found.append((hashes[whole], at[whole]))
    hashes = np.concatenate([f[0] for f in found])
    row = w.row[np.concatenate([f[1] for f in found])]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def _sets_in_slices(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingle_sets` of many texts, a slice of them at a time; only the sets are held."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for a, b in slices(offsets):
        row, hashes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], gram)
        found.append((row + a, hashes))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _signatures(gram: int, bands: int, rows: int):
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            for a, b in slices(offsets):
                row, hashes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], gram)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                full = bounds[1:] > bounds[:-1]
                starts = bounds[:-1][full]
                keys = np.zeros((b - a, bands), np.uint64)
                if len(starts):
                    for band in range(bands):
                        key = np.full(len(starts), np.uint64(band + 1))
                        for seed in seeds[band * rows : band * rows + rows]:
                            key = mix(key * np.uint64(31) + np.minimum.reduceat((hashes ^ seed) * np.uint64(seed | np.uint64(1)), starts))
                        keys[full, band] = key
                part = batch.slice(a, b - a)
                # The set as 128 bits that do not depend on the order; a text without words equals no other.
                one = np.where(full, _sums(mix(hashes), bounds).view(np.int64), part.column("_row").to_numpy())
                two = np.where(full, _sums(mix(hashes ^ np.uint64(0x5DEECE66D)), bounds).view(np.int64), -1)
                listed = pa.ListArray.from_arrays(
                    pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), part.column("_id"), pa.array(one), pa.array(two), pa.array(np.diff(bounds), pa.int64()), listed],
                    ["_row", "_id", "one", "two", "grams", "bands"],
                )

    return run


def _linked_pairs(left, right, same: bool, cell: int, threshold: float):
    """Indexes (i, j) of verified pairs between two blocks that are to be counted in this cell."""
    equal = left["bands"][:, None, :] == right["bands"][None, :, :]
    shared = equal.any(2)
    if same:
        shared = np.triu(shared, 1)
    i, j = np.nonzero(shared)
    first = equal[i, j].argmax(1)
    here = left["canon"][i, first] == cell
    i, j = i[here], j[here]
    if not len(i):
        return i, j
    rows = np.concatenate([left["row"], right["row"] + left["n"]])
    hashes = np.concatenate([left["hashes"], right["hashes"]])
    _, column = np.unique(hashes, return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    common = np.zeros((left["n"], right["n"]), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        dense = np.zeros((left["n"] + right["n"], min(COLUMNS, int(column[hi - 1]) - at + 1)), np.float32)
        dense[rows[lo:hi], column[lo:hi] - at] = 1
        common += dense[: left["n"]] @ dense[left["n"] :].T
    both = common[i, j]
    union = left["size"][i] + right["size"][j] - both
    good = both >= threshold * union - 1e-6
    return i[good], j[good]


def _blocks(rows: pa.Table, gram: int) -> tuple[dict, dict]:
    sides = []
    for side in (True, False):
        part = rows.filter(pa.compute.equal(rows.column("left"), side)).combine_chunks()
        texts = pa.concat_arrays(part.column("_text").chunks) if part.num_rows else pa.array([], pa.string())
        row, hashes = _sets_in_slices(*text_bytes(texts), gram)
        matrix = lambda name: np.array(part.column(name).to_pylist() or [[0]], np.int64)[: part.num_rows]  # noqa: E731, B023
        sides.append({
            "n": part.num_rows, "row": row, "hashes": hashes, "size": np.bincount(row, minlength=part.num_rows),
            "rep": part.column("rep").to_numpy(), "members": part.column("members").to_numpy(),
            "bands": matrix("bands"), "canon": matrix("canon"),
        })
    return sides[0], sides[1]


def _links_of(rows: pa.Table, gram: int, threshold: float) -> tuple[list, list, list]:
    """(representative, documents it links to, smallest representative tied to it) found in one cell."""
    left, right = _blocks(rows, gram)
    cell, same = rows.column("cell")[0].as_py(), rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
    if same:
        right = left
    if not left["n"] or not right["n"]:
        return [], [], []
    i, j = _linked_pairs(left, right, same, cell, threshold)
    shift = 0 if same else left["n"]
    reps = left["rep"] if same else np.concatenate([left["rep"], right["rep"]])
    links = np.zeros(len(reps))
    np.add.at(links, i, right["members"][j])
    np.add.at(links, j + shift, left["members"][i])
    parent = list(range(len(reps)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), (j + shift).tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            low, high = (a, b) if reps[a] < reps[b] else (b, a)
            parent[high] = low
    linked = np.flatnonzero(links)
    return reps[linked].tolist(), links[linked].astype(int).tolist(), [int(reps[root(x)]) for x in linked.tolist()]


def _with_texts(path: str):
    """Candidates with their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Beside(path)
        for batch in by_part(batches):
            rows = batch.column("_row").to_numpy()
            found = beside.of(rows)
            if found is not None:
                texts = batch.column("_text").take(pa.array(np.searchsorted(rows, found.column("_row").to_numpy())))
                columns = [found.column(c).combine_chunks() for c in ("_row", "members", "bands", "canon")]
                yield pa.RecordBatch.from_arrays([*columns, texts, found.column("cells").combine_chunks()], ["rep", "members", "bands", "canon", "_text", "cells"])

    return run


def _verify(gram: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.Table]) -> pa.RecordBatch:
            reps, links, tied = _links_of(pa.concat_tables(parts), gram, threshold)
            return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(links, pa.int64()), pa.array(tied, pa.int64())], ["rep", "links", "tied"])

        open_key, parts = None, []
        for batch in batches:  # sorted by cell
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(keys[a])
                if open_key is not None and key != open_key:
                    yield done(parts)
                    parts = []
                open_key = key
                parts.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if parts:
            yield done(parts)

    return run


def similar_groups(
    docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, recall: float = RECALL, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document row: (_row, id, class_id, keep_row, n_links, copies).

    ``class_id`` is the smallest id of the documents its links tie it to (null ids last), ``keep_row``
    the row that has it, ``n_links`` the documents it is similar to, itself not counted, ``copies`` those
    with an equal set. A null or wordless text is similar to nothing, also not to another such text.
    Rows with equal ids stay apart. Other columns are not read.
    """
    bands, rows = bands_for(threshold, recall)
    source = numbered(from_files(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = stored(
        source.select("_row", "_id", "_text").mapInArrow(
            lean(_signatures(gram, bands, rows)), f"_row bigint, _id {kind}, one bigint, two bigint, grams bigint, bands array<bigint>"
        ),
        "signatures",
    )
    place = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    key = ["one", "two", "grams"]
    classes = stored(signed.groupBy(*key).agg(F.min("_row").alias("rep"), F.count("*").alias("members"), F.min(place).alias("first")), "classes")

    # Candidate buckets of representatives.
    lone = signed.where("grams > 0").join(classes.select(F.col("rep").alias("_row"), "members"), "_row")
    entries = lone.select(F.col("_row").alias("rep"), "grams", F.explode("bands").alias("bucket"))
    buckets = stored(
        entries.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.sum("grams").alias("grams"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("sum"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(20,0)")).alias("sum2"))
        .where("n > 1"),
        "buckets",
    )
    # Buckets with the same members are one: the smallest of them.
    canon = buckets.groupBy("n", "sum", "sum2").agg(F.min("bucket").alias("canon"))
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks")
    named = buckets.join(canon, ["n", "sum", "sum2"]).select("bucket", "canon", blocks)
    hits = lone.select(F.col("_row").alias("rep"), "members", F.posexplode("bands").alias("band", "bucket")).join(named, "bucket")
    candidates = (
        hits.groupBy("rep", "members")
        .agg(F.collect_list(F.struct("band", "bucket", "canon", "blocks")).alias("hits"))  # <= bands
        .select(
            F.col("rep").alias("_row"), "members",
            F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.coalesce(F.get(F.filter("hits", lambda h: h["band"] == b), F.lit(0))["bucket"], F.col("rep") * 64 + b)).alias("bands"),
            F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.coalesce(F.get(F.filter("hits", lambda h: h["band"] == b), F.lit(0))["canon"], F.lit(0).cast("bigint"))).alias("canon"),
            F.array_distinct(F.transform("hits", lambda h: F.struct(h["canon"].alias("cell"), h["blocks"]))).alias("cells"),
        )
    )

    # Members of each pair of blocks, with their texts, which are read where the documents are scanned.
    wide = source.select("_row", "_text").mapInArrow(
        lean(_with_texts(beside_scan(candidates, "candidates"))),
        "rep bigint, members bigint, bands array<bigint>, canon array<bigint>, _text string, cells array<struct<cell:bigint,blocks:int>>",
    )
    each = wide.select("rep", "members", "bands", "canon", "_text", F.explode("cells").alias("c")).withColumn("own", F.pmod(F.xxhash64("rep", "c.cell"), F.col("c.blocks")).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("c.blocks") - 1),
        lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), (F.col("own") <= o).alias("left")),
    )
    cells = each.select("rep", "members", "bands", "canon", "_text", F.col("c.cell").alias("cell"), F.explode(others).alias("p")).select(
        "cell", "p.i", "p.j", "p.left", "rep", "members", "bands", "canon", "_text"
    )
    dealt = cells.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = kept(dealt.mapInArrow(lean(_verify(gram, threshold)), "rep bigint, links bigint, tied bigint"))

    tied = components(found.select(F.col("rep").alias("a"), F.col("tied").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    around = (
        classes.join(tied.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(links, "rep", "left")
        .select(*key, "members", "first", "links", F.coalesce("component", "rep").alias("component"))
    )
    groups = around.groupBy("component").agg(F.min("first").alias("head"))
    per_class = around.join(groups, "component").select(*key, "members", "head", "links")
    return signed.select("_row", "_id", *key).join(per_class, key).select(
        "_row", F.col("_id").alias(id_col), F.col("head.id").alias("class_id"), F.col("head.row").alias("keep_row"),
        (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), (F.col("members") - 1).alias("copies"),
    )


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """The documents with one left of each group of similar ones, with all their columns."""
    docs = from_files(docs)
    groups = similar_groups(docs, **options)
    executors_hand_back(docs.sparkSession)  # the texts that were compared; only numbers are joined from here on
    return without_rows(docs, groups.where("_row != keep_row"))
