"""Job trees, sketches that merge, and statistics from footers."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.errors import BadParam
from lakejobs.operators import trees
from lakejobs.operators.footers import footer_stats
from lakejobs.operators.partitions import add_partition, drop_partition, partitions
from lakejobs.operators.sketches import column_sketches, current_sketches, merged, profile_of, refresh_sketches, sketch_profile
from lakejobs.operators.trees import job_roots
from lakejobs.session import scratch_path
from lakejobs.sources.spec import Column, TableSpec
from lakejobs.sources.tables import write_table


def brute_roots(pairs):
    parent = {}
    for i, p in pairs:
        if i is not None:
            parent[i] = min((x for x in (parent.get(i), p) if x is not None), default=None)
    size, out = Counter(), {}
    for i in parent:
        at, path, seen = i, [], set()
        while at not in seen:
            seen.add(at)
            path.append(at)
            if parent[at] not in parent:
                out[i] = (at, len(path) - 1)
                size.update(path)
                break
            at = parent[at]
    return {i: (*out[i], size[i]) if i in out else (None, None, None) for i in parent}


def roots(spark, pairs):
    return {r.id: (r.root, r.depth, r.size) for r in job_roots(spark.createDataFrame(pairs, "id bigint, parent bigint")).collect()}


def test_roots_of_any_shape(spark):
    rng = random.Random(5)
    pairs = [(i, rng.choice([None, 9999, rng.randrange(300), max(0, i - 1), i // 2])) for i in range(300)]
    pairs += [(400, 401), (401, 402), (402, 400), (403, 402), (404, 404), (405, 404), (None, 3), (7, 6), (7, 6)]
    assert roots(spark, pairs) == brute_roots(pairs)
    assert roots(spark, [(1, 2), (2, 1)]) == {1: (None, None, None), 2: (None, None, None)}
    assert roots(spark, []) == {}


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    plain = trees._doubled
    monkeypatch.setattr(trees, "_doubled", lambda state: rounds.append(1) or plain(state))
    n = 500
    got = roots(spark, [(i, i - 1 if i else None) for i in range(n)])
    assert got == {i: (0, i, n - i) for i in range(n)} and len(rounds) <= math.ceil(math.log2(n)) + 1


def test_a_star_takes_one_round(spark, monkeypatch):
    rounds = []
    plain = trees._doubled
    monkeypatch.setattr(trees, "_doubled", lambda state: rounds.append(1) or plain(state))
    got = roots(spark, [(0, None)] + [(i, 0) for i in range(1, 400)])
    assert got[0] == (0, 0, 400) and got[7] == (0, 1, 1) and len(rounds) == 1


def test_many_jobs_above_one_ancestor_are_not_dealt_by_it(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(trees, "HOT_JUMPS", 20)
    states, plain = [], trees._doubled
    monkeypatch.setattr(trees, "_doubled", lambda state: states.append(plain(state)) or states[-1])
    pairs = [(0, 1), (1, 0), (2, None)] + [(i, rng.choice([0, 1, 2, 3, rng.randrange(i)])) for i in range(3, 400)]
    assert roots(spark, pairs) == brute_roots(pairs)
    plan = states[0]._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "BroadcastHashJoin [jump" in plan


# --- sketches -------------------------------------------------------------------------------------

COLUMNS = (Column("id", "bigint"), Column("price", "double"), Column("name", "string"), Column("day", "date"), Column("tags", "array<string>"))


def sales(spark, low, high):
    n = F.col("id")
    return spark.range(low, high).select(
        "id", F.when(n % 10 > 0, n / 4).alias("price"), F.concat(F.lit("n"), n % 37).alias("name"), F.date_add(F.lit("2020-01-01").cast("date"), (n % 90).cast("int")).alias("day"),
        F.array(F.lit("x")).alias("tags"), F.when(n % 3 == 0, "IN").when(n % 3 == 1, "US").alias("country"),
    )


def test_sketches_merge_to_those_of_all_rows(spark):
    df = sales(spark, 0, 5000)
    parts = merged(column_sketches(df, ["country"]), skip=["country"])
    whole = column_sketches(df.drop("country"))
    got, one = profile_of(parts).collect(), profile_of(whole).collect()
    assert [(*r[:4], *r[5:7]) for r in got] == [(*r[:4], *r[5:7]) for r in one]
    assert [r.name for r in got] == ["id", "price", "name", "day"]
    by_name = {r.name: r for r in got}
    assert by_name["price"].nulls == 500 and (by_name["id"].min, by_name["id"].max) == ("0", "4999")
    for name, truly in (("id", 5000), ("price", 4500), ("name", 37), ("day", 90)):
        assert abs(by_name[name].distinct - truly) <= 0.05 * truly
    for at, q in zip((0.25, 0.5, 0.75), by_name["id"].quantiles):
        assert abs(q / 5000 - at) < 0.03
    assert by_name["name"].quantiles is None
    by_country = profile_of(merged(column_sketches(df, ["country"]), ["country"]), ["country"]).where("name = 'id'")
    assert {r.country: r.rows for r in by_country.collect()} == {"IN": 1667, "US": 1667, None: 1666}


def test_only_new_partitions_are_sketched(spark, new_table):
    name, folder = new_table("sales"), scratch_path(spark, "sketches")
    spec = TableSpec(name, COLUMNS, (Column("country", "string"),), location=scratch_path(spark, "sales"))
    write_table(sales(spark, 0, 900), spec)
    assert sorted(refresh_sketches(spark, name, folder), key=str) == [("IN",), ("US",), (None,)]
    assert refresh_sketches(spark, name, folder) == []
    add_partition(spark, name, "country='FR'", sales(spark, 2000, 2300).drop("country"))
    assert refresh_sketches(spark, name, folder) == [("FR",)]
    drop_partition(spark, name, "country='IN'")
    spark.table(name).where("country = 'US'").limit(5).drop("country").createOrReplaceTempView("few")
    spark.sql(f"INSERT INTO {name} PARTITION (country='US') SELECT * FROM few")
    assert refresh_sketches(spark, name, folder) == [("US",)]
    now = spark.table(name)
    got = {r.name: r for r in sketch_profile(spark, name, folder).collect()}
    exact = now.agg(F.count("*"), F.min("id"), F.max("id"), F.count_if(F.col("price").isNull())).first()
    assert (got["id"].rows, got["id"].min, got["id"].max, got["price"].nulls) == (exact[0], str(exact[1]), str(exact[2]), exact[3])
    assert current_sketches(spark, name, folder).count() == 3  # US, FR and null
    # Counts and bounds are those of all rows; estimates depend a little on the order of merging.
    for r in profile_of(merged(column_sketches(now, ["country"]), skip=["country"])).collect():
        mine = got[r.name]
        assert (mine.rows, mine.nulls, mine.min, mine.max) == (r.rows, r.nulls, r.min, r.max) and abs(mine.distinct - r.distinct) <= 0.04 * r.distinct


def test_sketches_of_a_plain_and_an_empty_table(spark, new_table):
    name, folder = new_table("plain"), scratch_path(spark, "sketches")
    write_table(sales(spark, 0, 10).drop("country"), TableSpec(name, COLUMNS, location=scratch_path(spark, "plain")))
    with pytest.raises(ValueError, match="no sketches"):
        current_sketches(spark, name, folder)
    assert refresh_sketches(spark, name, folder) == [()] and refresh_sketches(spark, name, folder) == []
    assert {r.name: r.rows for r in sketch_profile(spark, name, folder).collect()}["id"] == 10
    empty = profile_of(column_sketches(sales(spark, 0, 0))).where("name = 'id'").first()
    assert (empty.rows, empty.nulls, empty.distinct, empty.min, empty.quantiles) == (0, 0, 0, None, None)


# --- footers --------------------------------------------------------------------------------------


@pytest.mark.parametrize("word", ["parquet", "orc"])
def test_footers_answer(spark, new_table, word):
    from lakejobs.sources.spec import Storage

    name = new_table("footers")
    spec = TableSpec(name, COLUMNS, (Column("country", "string"),), location=scratch_path(spark, "footers"), storage=Storage(stored_as=word))
    write_table(sales(spark, 0, 900), spec)
    got: DataFrame = footer_stats(spark, name, ["id", "price"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan.replace("\n", "") and "PushedGroupBy: [country" in plan
    assert "ReadSchema: struct<country:string,count(*):bigint" in plan  # no data column
    exact = spark.table(name).groupBy("country").agg(
        F.count("*"), *[f(c) for c in ("id", "price") for f in (lambda c: F.count_if(F.col(c).isNull()), F.min, F.max)]
    )
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, exact.collect()))
    rows = {r.name: r.rows for r in partitions(spark, name).collect()}
    assert sorted(rows.values()) == sorted(r.rows for r in got.collect())


def test_partitions_elsewhere_count_too(spark, new_table):
    name = new_table("footers")
    write_table(sales(spark, 0, 90), TableSpec(name, COLUMNS, (Column("country", "string"),), location=scratch_path(spark, "footers")))
    add_partition(spark, name, "country='FR'", sales(spark, 500, 530).drop("country"), location=scratch_path(spark, "elsewhere"))
    got = {r.country: (r.rows, r.id_min, r.id_max) for r in footer_stats(spark, name, ["id"]).collect()}
    assert got == {"IN": (30, 0, 87), "US": (30, 1, 88), None: (30, 2, 89), "FR": (30, 500, 529)}


def test_footers_have_no_bounds_of_texts(spark, new_table):
    name = new_table("footers")
    write_table(sales(spark, 0, 9).drop("country"), TableSpec(name, COLUMNS, location=scratch_path(spark, "footers")))
    with pytest.raises(BadParam, match="no bounds"):
        footer_stats(spark, name, ["name"])
    assert [tuple(r) for r in footer_stats(spark, name, ["id"]).collect()] == [(9, 0, 0, 8)]
