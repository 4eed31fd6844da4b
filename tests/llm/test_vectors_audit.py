"""Neighbour search, filter audit and centroid clustering against brute-force versions, over odd rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from compare import difference, oracle_connection

from lakejobs.llm import centroids, filter_audit, hnsw, queries
from lakejobs.plans.registry import table

# --- 11 neighbour search --------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, label int, k1 string, shard string, score string, _vector int"


def make_vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c", 2) for i, v in rows], VECTORS)


def odd_vectors(n=400, dimension=8):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=dimension).tolist()) for i in range(n)]
    same = rng.normal(size=dimension).tolist()
    rows += [(n + i, same) for i in range(150)]  # one vector that many rows share
    rows += [(1000, rows[5][1]), (1000, rows[5][1]), (1000, rows[6][1]), (None, rows[7][1])]  # repeated and missing ids
    rows += [(1020, [0.0] * dimension), (1040, None), (1060, []), (1080, [1.0, None, *[0.0] * 6]), (1100, [math.inf, *[1.0] * 7]), (1120, [math.nan] * dimension)]
    rows += [(1140, [3.0, 4.0]), (1160, [1.0, 1.0]), (1161, [-0.0, 2.0]), (1180, [1e200, *[0.0] * 7]), (1200, [1e-200, *[0.0] * 7])]
    return rows


def fits(v):
    return v is not None and v != [] and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_neighbours(rows, k, every=20):
    rows = [(i, np.array(v)) for i, v in rows if i is not None and fits(v)]
    out = []
    for at, (q, v) in enumerate(rows):
        if q % every == 0:
            with np.errstate(over="ignore"):
                near = sorted((-float((v * w).sum()), i) for j, (i, w) in enumerate(rows) if j != at and len(w) == len(v))
            out.append((q, tuple((i, -s) for s, i in near[:k])))
    return Counter(out)


def neighbours(df):
    by_query = defaultdict(list)
    for r in df.collect():
        by_query[r.query_id].append((r["rank"], r.vec_id, r.score))
    return by_query


def test_neighbours_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "LEAST_ROWS", 64)
    rows = odd_vectors()
    df = make_vectors(spark, rows)
    got = hnsw.nearest_neighbours(df, k=7)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got, expected = neighbours(got), brute_neighbours(rows, 7)
    assert sum(len(x) for x in got.values()) == sum(len(near) for _, near in expected.elements())
    right = 0
    for q in {q for q, _ in expected}:  # an id that repeats has the neighbours of each of its rows
        near = Counter(x for p, near in expected.elements() if p == q for x in near)
        right += (Counter((i, s) for _, i, s in got[q]) & near).total()
    total = sum(len(near) for _, near in expected.elements())
    assert right >= 0.97 * total
    # A vector shared by many: the smallest ids, own row left out, ties in order of id.
    same = [i for i, v in rows if v == rows[400][1]]
    for q, near in expected:
        if q in same:
            ids = [i for _, i, _ in sorted(got[q]) if i in same]
            assert ids == [i for i, _ in near if i in same] == [i for i in same if i != q][: len(ids)]
    assert [i for _, i, _ in sorted(got[1140])] == [1161, 1160]


def test_neighbours_of_few_rows(spark):
    assert hnsw.nearest_neighbours(make_vectors(spark, [])).count() == 0
    assert hnsw.nearest_neighbours(make_vectors(spark, [(0, [1.0, 2.0])])).count() == 0
    got = hnsw.nearest_neighbours(make_vectors(spark, [(0, [1.0, 2.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0])])).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 2, 3.0), (0, 2, 3, 3.0)]
    assert hnsw.nearest_neighbours(make_vectors(spark, [(1, [1.0]), (2, [1.0])])).count() == 0


def test_blocks_and_shards_change_nothing_but_the_way(spark, monkeypatch):
    rows = [(i, v) for i, v in odd_vectors(300) if v is not None]
    monkeypatch.setattr(hnsw, "BLOCK", 4)
    monkeypatch.setattr(hnsw, "SHARD_VALUES", 500)
    got, expected = neighbours(hnsw.nearest_neighbours(make_vectors(spark, rows), k=5)), brute_neighbours(rows, 5)
    right = sum(len({(i, s) for _, i, s in got[q]} & set(near)) for q, near in expected.elements())
    assert right >= 0.97 * sum(len(near) for _, near in expected.elements())


def test_graph_of_a_shard():
    """Recall of one graph, links within bounds, every level reachable, and flat arrays that open to the same graph."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(3000, 24)) * rng.uniform(0.7, 1.4, size=(3000, 1))
    longer, scale = hnsw.lengthened(vectors)
    assert np.allclose((longer**2).sum(1), (longer**2).sum(1)[0], rtol=1e-4) and scale == np.abs(vectors).max()
    tops = hnsw.random_tops(3000, 5)
    levels = hnsw.build_graph(longer, tops)
    assert len(levels) == tops.max() + 1 and levels[0].max() < 3000 and (levels[0] >= 0).any(1).all()
    for i, links in enumerate(levels):
        linked = np.unique(links[links >= 0])
        assert (tops[linked] >= i).all() and (links[tops < i] == -1).all()
    targets = np.concatenate([vectors[:200], np.zeros((200, 1))], 1).astype(np.float32)
    entry = hnsw.descend(longer, levels, targets, 0, int(np.argsort(-tops, kind="stable")[0]))
    near, sims = hnsw.search_level(longer, levels[0], targets, entry, 128)
    assert (np.diff(sims, axis=1)[np.isfinite(sims[:, 1:])] <= 0).all()
    truth = np.argsort(-(vectors[:200] @ vectors.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(near, truth)]) > 0.95


def test_recall_over_a_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in df.collect()]
    got = neighbours(queries.QUERIES["op11_hnsw"](spark, sf_dir))
    right = total = 0
    for q, v in rows:
        if q % 20 == 0:
            near = sorted((-float((v * w).sum()), i) for i, w in rows if i != q)[:20]
            assert [r for r, _, _ in sorted(got[q])] == list(range(1, 21))
            right += len({i for _, i, _ in got[q]} & {i for _, i in near})
            total += 20
    assert right >= 0.95 * total


# --- 12 filter audit ------------------------------------------------------------------------------


def brute_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    fails = []
    for i, text, part in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i,
        }
        fails.append((part or "", {x for x in f if f[x]}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [f for f in fails if f[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order):
                lost = [f for f in left if letter in f[1]]
                stay = [f for f in left if letter not in f[1]]
                shapley[letter] += len(lost)
                out[part, "".join(order), step + 1] = [
                    len(stay), len(lost), sum(letter in f[1] for f in mine) - len(lost), sum(f[1] == {letter} for f in mine),
                    sum(f[2] for f in lost), sum(f[3] for f in lost),
                ]
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark, make_docs, odd_rows):
    rows = [*odd_rows, (30, "A B " * 80), (31, "x $ " + "word%d " * 3), (32, " ".join(f"w{i}" for i in range(60)) + " #"), (32, "same " * 400), (33, "same " * 400)]
    docs = make_docs(rows)
    given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    given += [(40, "same " * 400, None), (41, None, None), (41, None, ""), (None, None, "lone")]
    docs = spark.createDataFrame([(*g, 1, "x", True) for g in given], "doc_id bigint, text string, source string, mask int, part string, good boolean")
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (33, 1, 1), (777, 1, 1), (12, None, 1), (41, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.filter_audit(docs, marks).collect()}
    expected = brute_audit(given, labels)
    assert got == expected and len(got) == 600 * len({g[2] or "" for g in given})
    assert filter_audit.filter_audit(docs.limit(0), marks).count() == 0
    assert filter_audit.filter_audit(docs, marks.limit(0)).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_packed_fields_do_not_run_over():
    steps, packed = filter_audit.packed_outcomes("ABCDE")
    assert len(steps) == 600 and len(packed) == 32
    many = (1 << 62) + 12345
    fields = filter_audit.unpacked(many * packed[31], 601)
    assert set(fields.tolist()) == {0, many} and fields[-1] == many
    assert fields[:600].reshape(120, 5)[:, 0].tolist() == [many] * 120
    assert filter_audit.unpacked(sum(packed), 601)[:600].reshape(120, 5).sum(1).tolist() == [31] * 120


# --- 13 centroid clustering -----------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dimension):
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, hashlib.sha256(f"1:{rows[r][0]}".encode()).hexdigest(), rows[r][1]))
    centres = [rows[r][1] for r in order[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in rows:
            members[place(v)[1]].append(v)
        centres = [[sum(x) // len(members[n]) for x in zip(*members[n])] if members[n] else c for n, c in enumerate(centres)]
    return Counter((i, place(v)[1], place(v)[0]) for i, v in rows), centres


def test_centroid_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * 3).tolist()) for i in range(300)] + [(i, [0.5, -0.5, 0, 0, 0, 0.015625]) for i in range(50, 150)]
    rows += [(None, [1.0] * 6), (400, None), (401, [1.0] * 5), (402, [1.0] * 7), (403, [1.0, None, 1, 1, 1, 1]), (404, [math.nan] * 6), (405, [math.inf] * 6), (406, [])]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, distance string, _vector string").repartition(5)
    assigned, centres = centroids.centroid_clusters(df, clusters=9, dimensions=6)
    expected, expected_centres = brute_clusters(rows, 9, 3, 6)
    assert centres.tolist() == expected_centres
    assert Counter(tuple(r) for r in assigned.collect()) == expected
    full = centroids.with_inertia(assigned, centres).collect()
    assert {r.inertia for r in full} == {sum(k[2] for k in expected.elements())}
    for r in full:
        assert r.cluster_inertia == sum(k[2] for k in expected.elements() if k[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, expected_centres[r.cluster])).encode()).hexdigest()


def test_few_and_no_vectors(spark):
    kind = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])], kind)
    assigned, centres = centroids.centroid_clusters(few, dimensions=2)
    assert len(centres) == 3 and assigned.where("distance = 0").count() == 3
    assert assigned.where("vec_id < 3").select("cluster").distinct().count() == 1  # the smaller of two equal centroids
    none, centres = centroids.centroid_clusters(few.limit(0), dimensions=2)
    assert centroids.with_inertia(none, centres).count() == 0 and centres.shape == (0, 2)
    with pytest.raises(Exception, match="would not fit"):
        centroids.centroid_clusters(spark.createDataFrame([(1, [1e30])], kind), dimensions=1)


def test_lookup_tables():
    rng = np.random.default_rng(8)
    grid, centres = rng.integers(-70, 70, (500, 5)), rng.integers(-70, 70, (4, 5))
    assert (centroids.distances(grid, centres) == ((grid[:, None] - centres) ** 2).sum(2)).all()


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_centroid_clusters"])
def test_same_as_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert difference(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name], oracle_connection(sf_dir)) is None
