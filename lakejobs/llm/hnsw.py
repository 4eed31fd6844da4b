"""Nearest neighbours by inner product: a navigable small-world graph per shard, results merged.

Equal vectors are one node, which carries the smallest of their ids, so a vector that very many rows share
costs what a single one does. Nodes are dealt into shards by size class (dimension and the power of two nearest
to the length) and hash. A shard is one graph: each node has a random top level; the graph of a level links
the nodes that reach it. Levels and links are flat arrays of whole numbers, a row of neighbours per node, kept as one
row of a table. An added component makes all vectors of a shard equally long, so that the largest inner product
is the smallest distance and the graph's links serve both.

A batch of nodes is added at a time, and a batch of queries is searched at a time: NumPy moves all of them one
step on at once. Every distinct query vector visits every shard of its dimension, in blocks; what a shard finds is scored
again in double precision on the original vectors, and the best of all shards are merged by a ranking that
keeps few rows per task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakejobs.llm.tables import stored

NEIGHBOURS = 20
LINKS = 16  # a new node's links; the lowest level holds up to twice as many per node
BUILD_WIDTH = 64  # nodes kept in view while a node is added
SEARCH_WIDTH = 128  # nodes kept in view while a query is searched
STEP = 4  # nodes whose links are followed at a time
BATCH = 512
SHARD_VALUES = 1 << 19  # components of a shard, at most about
SHARDS = 16  # so many shards of a size class at least, if it is large enough to share out
LEAST_ROWS = 512  # of a shard worth sharing out
BLOCK = 4096  # distinct queries of a block

_INDEX = "shard bigint, dimension int, ids binary, counts binary, vectors binary, norm double, tops binary, links binary, widths binary"


def _sims(vectors: np.ndarray, targets: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", vectors[nodes], targets[rows])


def search_level(vectors: np.ndarray, links: np.ndarray, targets: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes found for each target, nearest first, with their similarity; -1 where fewer are found.

    Best-first search from ``entry`` (a row of start nodes per target), all targets a step at a time: the nearest nodes
    not yet followed are followed, until every node in view has been.
    """
    n, b = len(vectors), len(targets)
    every = np.arange(b)
    seen = np.zeros((b, n), bool)
    view, near, done = np.full((b, width), -1), np.full((b, width), -np.inf, np.float32), np.zeros((b, width), bool)
    starts = min(entry.shape[1], width)
    view[:, :starts] = entry[:, :starts]
    r, c = np.nonzero(view[:, :starts] >= 0)
    near[r, c] = _sims(vectors, targets, r, view[r, c])
    seen[r, view[r, c]] = True
    active = every
    while len(active):
        open_ = np.where(done[active] | (view[active] < 0), -np.inf, near[active])
        step = min(STEP, width)
        pick = np.argpartition(-open_, step - 1, axis=1)[:, :step]
        fresh = np.take_along_axis(open_, pick, 1) > -np.inf
        go = fresh.any(1)
        active, pick, fresh = active[go], pick[go], fresh[go]
        if not len(active):
            break
        follow = np.where(fresh, view[active[:, None], pick], -1)
        done[active[:, None], pick] |= fresh
        around = np.where(follow[:, :, None] >= 0, links[follow], -1).reshape(len(active), -1)
        row = np.repeat(np.arange(len(active)), around.shape[1])
        node = around.ravel()
        ok = node >= 0
        row, node = row[ok], node[ok]
        ok = ~seen[active[row], node]
        row, node = row[ok], node[ok]
        _, first = np.unique(row * n + node, return_index=True)  # one node may be around several that are followed
        row, node = row[first], node[first]
        if not len(row):
            continue
        seen[active[row], node] = True
        sims = _sims(vectors, targets, active[row], node)
        better = sims > near[active].min(1)[row]
        row, node, sims = row[better], node[better], sims[better]
        if not len(row):
            continue
        counts = np.bincount(row, minlength=len(active))
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        got = np.flatnonzero(counts)
        some = active[got]
        new, new_near = np.full((len(got), counts.max()), -1), np.full((len(got), counts.max()), -np.inf, np.float32)
        at = np.searchsorted(got, row)
        new[at, place], new_near[at, place] = node, sims
        all_view, all_near = np.concatenate([view[some], new], 1), np.concatenate([near[some], new_near], 1)
        all_done = np.concatenate([done[some], np.zeros(new.shape, bool)], 1)
        best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        view[some], near[some], done[some] = (np.take_along_axis(a, best, 1) for a in (all_view, all_near, all_done))
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(view, order, 1), np.take_along_axis(near, order, 1)


def chosen_links(vectors: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates (nearest first, -1 for none) as links, nearest first.

    A candidate is passed over if it is nearer to one chosen before than to the node itself; room
    that is left goes to the nearest ones passed over.
    """
    b, width = near.shape
    held = vectors[np.maximum(near, 0)]
    between = np.einsum("bid,bjd->bij", held, held)
    real = near >= 0
    chosen = np.zeros((b, width), bool)
    count = np.zeros(b, np.int64)
    closest = np.full((b, width), -np.inf, np.float32)  # similarity of each candidate to the nearest chosen one
    for i in range(width):
        take = real[:, i] & (closest[:, i] <= sims[:, i]) & (count < most)
        chosen[:, i] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, between[:, i]), closest)
    rank = np.where(chosen, np.arange(width), np.where(real, width + np.arange(width), 3 * width))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(rank, order, 1) < 3 * width, np.take_along_axis(near, order, 1), -1)


def _link_back(vectors: np.ndarray, links: np.ndarray, used: np.ndarray, nodes: np.ndarray, forward: np.ndarray, most: int) -> None:
    """Add each new node to the rows of those it links to; a row that is full is chosen anew."""
    source = np.repeat(nodes, forward.shape[1])
    target = forward.ravel()
    ok = target >= 0
    source, target = source[ok], target[ok]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    hit, first, counts = np.unique(target, return_index=True, return_counts=True)
    room = links.shape[1]
    place = np.arange(len(target)) - np.repeat(first, counts) + used[target]
    fits = np.repeat(used[hit] + counts <= room, counts)
    links[target[fits], place[fits]] = source[fits]
    plain = used[hit] + counts <= room
    used[hit[plain]] += counts[plain]
    for a in range(0, len(full := np.flatnonzero(~plain)), BATCH):
        part = full[a : a + BATCH]
        extra = int(counts[part].max())
        near = np.full((len(part), room + extra), -1)
        near[:, :room] = links[hit[part]]
        for i, f in enumerate(part.tolist()):
            near[i, room : room + counts[f]] = source[first[f] : first[f] + counts[f]]
        r, c = np.nonzero(near >= 0)
        sims = np.full(near.shape, -np.inf, np.float32)
        sims[r, c] = _sims(vectors, vectors, hit[part][r], near[r, c])
        best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * most]
        kept = chosen_links(vectors, np.take_along_axis(near, best, 1), np.take_along_axis(sims, best, 1), most)
        links[hit[part]] = -1
        links[hit[part], : kept.shape[1]] = kept
        used[hit[part]] = (kept >= 0).sum(1)


def descend(vectors: np.ndarray, levels: list[np.ndarray], targets: np.ndarray, down_to: int, first: int) -> np.ndarray:
    """Start nodes for a search on level ``down_to``: the nearest node of each level above, from the top."""
    entry = np.full((len(targets), 1), first)
    for level in range(len(levels) - 1, down_to, -1):
        entry = search_level(vectors, levels[level], targets, entry, 1)[0]
    return entry


def build_graph(vectors: np.ndarray, tops: np.ndarray) -> list[np.ndarray]:
    """Links of each level, from the lowest: a row per node, -1 for none. ``vectors`` are equally long."""
    n = len(vectors)
    order = np.argsort(-tops, kind="stable")  # nodes of high levels first: the level above is whole when a node looks down from it
    levels: list[np.ndarray] = [np.empty(0, np.int64)] * (int(tops.max()) + 1)
    for level in range(len(levels) - 1, -1, -1):
        most = 2 * LINKS if level == 0 else LINKS
        links, used = np.full((n, most + LINKS), -1), np.zeros(n, np.int64)
        levels[level] = links
        here = order[tops[order] >= level]
        at, size = 1, 1
        while at < len(here):
            nodes = here[at : at + size]
            targets = vectors[nodes]
            # The level's first node is the entry of a top level; below, the search comes down to it.
            entry = descend(vectors, levels, targets, level, int(order[0]))
            near, sims = search_level(vectors, links, targets, entry, BUILD_WIDTH)
            mutual = targets @ targets.T
            np.fill_diagonal(mutual, -np.inf)
            beside = np.argsort(-mutual, axis=1, kind="stable")[:, : LINKS * 2]
            known = np.take_along_axis(mutual, beside, 1)
            near = np.concatenate([near, np.where(known > -np.inf, nodes[beside], -1)], 1)
            sims = np.concatenate([sims, known], 1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_WIDTH]
            forward = chosen_links(vectors, np.take_along_axis(near, best, 1), np.take_along_axis(sims, best, 1), LINKS)
            links[nodes, : forward.shape[1]] = forward
            used[nodes] = (forward >= 0).sum(1)
            _link_back(vectors, links, used, nodes, forward, most)
            at += len(nodes)
            size = min(BATCH, max(1, at))
    return levels


def random_tops(n: int, seed: int) -> np.ndarray:
    """Each node's highest level; one in ``LINKS`` reaches the next."""
    draw = np.random.default_rng(seed & (1 << 62) - 1).random(n)
    return np.floor(-np.log(1 - draw) / math.log(LINKS)).astype(np.int64)


def lengthened(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors, scaled and with one more component that makes all equally long, and the scale."""
    scale = float(np.abs(vectors).max())
    scaled = vectors / scale
    squares = (scaled**2).sum(1)
    return np.concatenate([scaled, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], 1).astype(np.float32), scale


def _rows(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    """A list column as a matrix."""
    return np.concatenate([np.zeros((0, dimension)), *[c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), dimension) for c in column.chunks]])


def _index_row(table: pa.Table) -> pa.Table:
    """One shard's nodes (ids, _vector, node) to one row of flat arrays."""
    shard, dimension = table.column("shard")[0].as_py(), table.column("dimension")[0].as_py()
    table = table.sort_by("node")  # a shard that is built again comes out the same
    vectors = _rows(table.column("_vector"), dimension)
    longer, scale = lengthened(vectors)
    tops = random_tops(len(vectors), shard)
    levels = build_graph(longer, tops)
    ids = table.column("ids").combine_chunks()
    return pa.table({
        "shard": [shard], "dimension": pa.array([dimension], pa.int32()), "ids": [ids.flatten().to_numpy().tobytes()], "counts": [np.diff(ids.offsets.to_numpy()).astype(np.int32).tobytes()],
        "vectors": [vectors.tobytes()], "norm": [scale], "tops": [tops.astype(np.int8).tobytes()],
        "links": [b"".join(x[tops >= i].astype(np.int32).tobytes() for i, x in enumerate(levels))], "widths": [np.array([x.shape[1] for x in levels], np.int32).tobytes()],
    })


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ids, first id of each node, vectors, tops, links per level) of an index row."""
    vectors = np.frombuffer(row["vectors"]).reshape(-1, row["dimension"])
    tops = np.frombuffer(row["tops"], np.int8)
    first = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], np.int32))])
    levels, at = [], 0
    flat = np.frombuffer(row["links"], np.int32)
    for i, width in enumerate(np.frombuffer(row["widths"], np.int32).tolist()):
        here = tops >= i
        links = np.full((len(tops), width), -1)
        links[here] = flat[at : at + here.sum() * width].reshape(-1, width)
        at += here.sum() * width
        levels.append(links)
    return np.frombuffer(row["ids"], np.int64), first, vectors, tops, levels


def _found(want: int, width: int):
    """A block of queries in one shard: the ``want`` best ids of each, scored on the original vectors."""
    names = ["k1", "k2", "vec_id", "score", "own"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]

    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        if not queries.num_rows or not shard.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        row = shard.slice(0, 1).to_pylist()[0]
        ids, first, vectors, tops, levels = _opened(row)
        targets = _rows(queries.column("_vector"), row["dimension"])
        longer, _ = lengthened(vectors)
        scaled = targets / np.abs(targets).max(1, keepdims=True)
        scaled = np.concatenate([scaled, np.zeros((len(scaled), 1))], 1).astype(np.float32)
        out: list[list] = [[], [], [], [], []]
        k1, k2 = (queries.column(c).to_numpy() for c in ("k1", "k2"))
        for a in range(0, len(targets), BATCH):
            part = scaled[a : a + BATCH]
            entry = descend(longer, levels, part, 0, int(np.argsort(-tops, kind="stable")[0]))
            near = search_level(longer, levels[0], part, entry, max(width, want))[0]
            q, c = np.nonzero(near >= 0)
            node = near[q, c]
            score = (vectors[node] * targets[a : a + BATCH][q]).sum(1)
            same = (vectors[node] == targets[a : a + BATCH][q]).all(1)
            # Ids of a node's equal vectors, then the best by (score, id) of each query.
            times = first[node + 1] - first[node]
            at = np.repeat(first[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            q, score, same, found = np.repeat(q, times), np.repeat(score, times), np.repeat(same, times), ids[at]
            order = np.lexsort((found, -score, q))
            best = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < want]
            for column, values in zip(out, (k1[a + q[best]], k2[a + q[best]], found[best], score[best], same[best]), strict=True):
                column.append(values)
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(out, types, strict=True)], names)

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, _vector, dimension, band, k1, k2) of the rows that take part.

    k1 and k2 are 128 bits that equal vectors share, ``band`` the power of two nearest to the length.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_vector")).where(
        F.col("vec_id").isNotNull() & F.forall("_vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("_vector", lambda x: x != 0)
    )
    largest = F.array_max(F.transform("_vector", F.abs))
    # The logarithm of the length, without the squares of very large or small components.
    length = F.log2(largest) + F.log2(F.aggregate("_vector", F.lit(0.0), lambda s, x: s + (x / largest) * (x / largest))) / 2
    return rows.select(
        "vec_id", "_vector", F.size("_vector").alias("dimension"), F.round(length).cast("int").alias("band"),
        F.xxhash64("_vector").alias("k1"), F.xxhash64(F.lit("second"), "_vector").alias("k2"),
    )


def nodes_of(rows: DataFrame, most_ids: int) -> DataFrame:
    """One row per distinct vector: its ``most_ids`` smallest ids, and whether ``is_query`` holds for any of its rows.

    No result of fewer than ``most_ids`` rows can hold a larger id, since the smaller ones tie with it.
    """
    key = ["k1", "k2"]
    rank = F.row_number().over(W.partitionBy(*key, "is_query").orderBy("vec_id"))
    few = rows.withColumn("_rank", rank).where(F.col("_rank") <= most_ids)  # limited per task before the shuffle
    return few.groupBy(*key).agg(
        F.slice(F.sort_array(F.collect_list("vec_id")), 1, most_ids).alias("ids"), F.max("is_query").alias("is_query"),
        F.first("_vector").alias("_vector"), F.first("dimension").alias("dimension"), F.first("band").alias("band"),
    )


def build_index(nodes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The graphs of all shards, one row each, written to the shared folder."""
    spark = nodes.sparkSession
    sizes = nodes.groupBy("dimension", "band").agg(F.count("*").alias("n")).collect()  # size classes: few
    classes, shard = [], 0
    for row in sorted(sizes):
        parts = max(-(-row["n"] * row["dimension"] // SHARD_VALUES), min(shards, -(-row["n"] // LEAST_ROWS)))
        classes.append((row["dimension"], row["band"], shard, parts))
        shard += parts
    if not classes:
        return spark.createDataFrame([], _INDEX)
    table = F.broadcast(spark.createDataFrame(classes, "dimension int, band int, _first bigint, _parts bigint"))
    dealt = nodes.join(table, ["dimension", "band"]).select(
        (F.col("_first") + F.pmod("k1", "_parts")).alias("shard"), "dimension", "ids", F.struct("k1", "k2").alias("node"), "_vector"
    )
    spread = dealt.repartition(2 * shard, "shard")
    return stored(spread.groupBy("shard").applyInArrow(_index_row, _INDEX), "graphs")


def search_index(index: DataFrame, queries: DataFrame, want: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """(k1, k2, vec_id, score, own, rank): the ``want`` best of all shards for each query (k1, k2, _vector, dimension).

    Queries go to the shards in blocks; a task holds one block and one graph.
    """
    spark = index.sparkSession
    shards = [(r["shard"], r["dimension"]) for r in index.select("shard", "dimension").collect()]  # numbers only, one per shard
    blocks = max(1, -(-queries.count() // BLOCK))
    if not shards:
        return spark.createDataFrame([], "k1 bigint, k2 bigint, vec_id bigint, score double, own boolean, rank int")
    of = F.broadcast(spark.createDataFrame(shards, "shard bigint, dimension int").groupBy("dimension").agg(F.collect_list("shard").alias("shards")))
    asked = queries.join(of, "dimension").select("k1", "k2", "_vector", F.explode("shards").alias("shard"), F.pmod("k2", F.lit(blocks)).alias("block"))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    parts = min(2 * len(shards) * blocks, 20_000)
    asked, graphs = (x.repartition(parts, "shard", "block") for x in (asked, graphs))
    found = asked.groupBy("shard", "block").cogroup(graphs.groupBy("shard", "block")).applyInArrow(_found(want, width), "k1 bigint, k2 bigint, vec_id bigint, score double, own boolean")
    rank = F.row_number().over(W.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= want)


def nearest_neighbours(
    vectors: DataFrame, every: int = 20, k: int = NEIGHBOURS, shards: int = SHARDS, width: int = SEARCH_WIDTH,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``.

    Nearest is the largest inner product; equal ones go by the smaller id. A row's own vector is left out, equal vectors
    of other rows are not. Vectors that are null, zero, or hold null or non-finite components, and rows without
    an id, take no part; vectors of different dimension are never compared. Repeated rows count each, as query
    and as candidate. An empty table gives no rows. Other columns are not read.
    """
    rows = usable(vectors, id_col, vector_col).withColumn("is_query", F.col("vec_id") % every == 0)
    nodes = stored(nodes_of(rows, k + 1), "nodes")
    found = search_index(build_index(nodes, shards), nodes.where("is_query"), k + 1, width)
    # Few rows per distinct query, in order of rank.
    lists = found.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score", "own"))).alias("found"))
    named = rows.where("is_query").select(F.col("vec_id").alias("query_id"), "k1", "k2").join(lists, ["k1", "k2"])
    mine = F.array_position(F.transform("found", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), True)
    others = F.when(mine > 0, F.concat(F.slice("found", 1, mine.cast("int") - 1), F.slice("found", mine.cast("int") + 1, k + 1))).otherwise(F.col("found"))
    return named.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("_at", "_f")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_f.vec_id").alias("vec_id"), F.col("_f.score").alias("score")
    )
