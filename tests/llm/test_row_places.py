"""Rows are matched between scans whatever way each scan deals them."""

from __future__ import annotations

from collections import Counter
from itertools import cycle

import pytest
from pyspark.sql import functions as F
from test_operators import brute_contamination, brute_exact, brute_groups, brute_repeats, repeats

from lakejobs.llm import decontaminate, exact_dedup, jaccard, suffix, tables, warc
from lakejobs.session import scratch_path

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def other_splits(spark, monkeypatch):
    """Whatever is written between two scans changes how the next one is split."""
    numbers = cycle(["1", "9", "3"])

    def turned(function):
        def run(*args, **kwargs):
            out = function(*args, **kwargs)
            spark.conf.set(SPLITS, next(numbers))
            return out

        return run

    for module in (suffix, jaccard, warc, decontaminate, exact_dedup, tables):
        for name in ("stored", "kept", "beside_scan"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, turned(getattr(module, name)))
    yield
    spark.conf.unset(SPLITS)


@pytest.fixture
def filed(spark, make_docs, odd_rows):
    """The odd rows in several files, one with a name that needs escapes, some without rows."""
    path = scratch_path(spark, "odd rows %20 é+")
    make_docs(odd_rows).repartition(5, "doc_id").write.parquet(path)
    make_docs([(500, "alone " * 30)]).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path), [*odd_rows, (500, "alone " * 30)]


def test_numbers_stay(spark, filed):
    docs, given = filed
    seen = set()
    for parts in ("1", "13"):
        spark.conf.set(SPLITS, parts)
        seen.add(frozenset((r._row, r.doc_id, r.text) for r in tables.numbered(docs.select("doc_id", "text")).collect()))
    spark.conf.unset(SPLITS)
    assert len(seen) == 1 and len({x[0] for x in seen.pop()}) == len(given)


def test_numbers_need_no_python_worker(spark, filed):
    """The files' numbers come from a local relation; rows of a Python list would need workers of their own."""
    plan = tables.numbered(filed[0].select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LocalTableScan" in plan and "ExistingRDD" not in plan


def test_one_python_worker_a_task(spark, filed, make_docs, odd_rows):
    items = make_docs(odd_rows[:5]).selectExpr("cast(doc_id as string) item_id", "text")
    plan = decontaminate.contamination(filed[0], items)._jdf.queryExecution().executedPlan().toString()
    between = plan.split("MapInArrow")[1:-1]
    assert between and all("Exchange hashpartitioning" in part for part in between)


def test_only_plain_tables_are_taken_as_they_are(spark, filed):
    docs, given = filed
    plain = docs.where("doc_id > 3").select("doc_id", "text")
    assert tables.from_files(plain) is plain
    for other in (docs.unionByName(docs), docs.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), docs.limit(4), spark.range(3)):
        copy = tables.from_files(other)
        assert copy is not other and tables.from_files(copy) is copy
        numbers = [r[0] for r in tables.numbered(copy).select("_row" if "_row" not in other.columns else copy.columns[0]).collect()]
        assert len(numbers) == other.count()


def test_batches_are_cut_by_part():
    import pyarrow as pa

    rows = [5, 6, 1 << 16, (1 << 33) + 1, (1 << 33) + 2, 3]
    pieces = [b.column("_row").to_pylist() for b in tables.by_part([pa.record_batch([pa.array(rows)], ["_row"]), pa.record_batch([pa.array([], pa.int64())], ["_row"])])]
    assert pieces == [[5, 6], [1 << 16], [(1 << 33) + 1, (1 << 33) + 2], [3]]


def test_repeats(filed, other_splits):
    docs, given = filed
    assert repeats(docs, length=100) == brute_repeats(given, 100)


def test_similar(filed, other_splits):
    docs, given = filed
    got = Counter((r.doc_id, r.class_id) for r in jaccard.similar_groups(docs).collect())
    expected = brute_groups(given)
    assert got == Counter(k[:2] for k in expected.elements())
    left = Counter(r.doc_id for r in jaccard.drop_similar(docs).collect())
    assert sum(left.values()) < len(given) and set(left) >= {k[1] for k in expected}


def test_contaminated(spark, filed, other_splits):
    docs, given = filed
    items = [(1, given[0][1])]
    kept = decontaminate.remove_contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    expected = brute_contamination(given, items)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k in expected.elements() if not k[2])


def test_copies(filed, other_splits):
    docs, given = filed
    assert Counter(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == Counter(k[0] for k in brute_exact(given).elements() if k[3])


def test_revisits(spark, filed, other_splits):
    docs, given = filed
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a").alias("url"), F.col("text").alias("html"))
    folder = scratch_path(spark, "warc-splits")
    warc.write_bundles(pages, folder)
    got = Counter(r.record_type for r in warc.resolved(warc.read_bundles(spark, folder)).collect())
    kinds = len({t or "" for _, t in given})
    assert got == Counter(response=kinds, revisit=len(given) - kinds)
