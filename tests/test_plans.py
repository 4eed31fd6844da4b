"""The plans that matter at scale: what is shuffled, pushed down, pruned and left in the JVM."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lakejobs.operators import jobs as J
from lakejobs.operators.lists import pack_lists, unpack_lists
from lakejobs.operators.mapreduce import stream_map_reduce, word_count
from lakejobs.operators.ordered import limit_bytes, range_pieces
from lakejobs.operators.partitions import partition_stats
from lakejobs.operators.stats import profile_columns
from lakejobs.plans import derived
from lakejobs.plans.check_sources import orders_by_status
from lakejobs.plans.registry import table
from lakejobs.sources.delimited import scan_delimited
from lakejobs.sources.files import file_inventory
from lakejobs.sources.spec import Clustering, Column, SortKey, TableSpec
from lakejobs.sources.tables import write_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange (?:hash|range|SinglePartition|Round)", plan(df)))


def test_delimited_scan_stays_in_the_jvm_without_shuffle(spark, tmp_path):
    (tmp_path / "t").write_text("1\x01a\n")
    text = plan(scan_delimited(spark, str(tmp_path / "t"), "a int, b string, m map<string,int>"))
    assert "Exchange" not in text and "Python" not in text
    assert text.count("split(value") == 1  # a line is taken apart once, not once per column


def test_one_shuffle_each(spark, sf_dir):
    events = derived.job_events(spark, sf_dir)
    documents = table(spark, sf_dir, "documents")
    assert exchanges(J.latest_fields(events)) == 1
    assert exchanges(J.job_table(derived.field_events(spark, sf_dir))) == 1
    assert exchanges(word_count(documents, "text")) == 1
    small = documents.select("source", "doc_id", "lang")
    assert exchanges(unpack_lists(pack_lists(small, "source", "lang", "doc_id").select("source", "list"), "list")) == 1


def test_groups_shrink_before_the_shuffle(spark, sf_dir):
    words = plan(word_count(table(spark, sf_dir, "documents"), "text"))
    assert re.search(r"Exchange hash.*partial_count", words, re.S)
    jobs = plan(J.job_table(derived.field_events(spark, sf_dir)))
    assert re.search(r"Exchange hash.*partial_max_by", jobs, re.S)
    latest = plan(J.latest_fields(derived.job_events(spark, sf_dir)))
    assert re.search(r"Exchange hash.*WindowGroupLimit [^\n]*Partial", latest, re.S)


NARROW = ("f5_annotate_json", "f7_first_entries", "j1_progress", "j9_callbacks", "q2_row_rand", "t1_conform", "f3_drop_unset")


@pytest.mark.parametrize("name", NARROW)
def test_row_jobs_do_not_shuffle(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    assert "Exchange" not in text and "Python" not in text


def test_scans_read_only_what_they_use(spark, sf_dir):
    user = plan(J.jobs_by_user(derived.jobs(spark, sf_dir), derived.tracker(spark, sf_dir), 42))
    assert "EqualTo(o_custkey,42)" in user
    words = plan(word_count(table(spark, sf_dir, "documents"), "text"))
    assert "ReadSchema: struct<text:string>" in words
    files = plan(file_inventory(spark, sf_dir, "*.parquet"))
    assert "ReadSchema: struct<>" in files
    one = plan(profile_columns(table(spark, sf_dir, "lineitem").select("l_returnflag")))
    assert "ReadSchema: struct<l_returnflag:string>" in one


def test_partition_jobs_read_no_data_column(spark, sf_dir):
    stored = spark.table(orders_by_status(spark, sf_dir, "plan"))
    text = plan(partition_stats(stored, ["o_orderstatus"]))
    assert "ReadSchema: struct<>" in text
    pruned = plan(stored.where("o_orderstatus = 'F'").agg(F.count("*")))
    assert re.search(r"PartitionFilters: \[isnotnull\(o_orderstatus", pruned)


def test_byte_limit_filters_the_scan(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    text = plan(limit_bytes(documents, "text", 100_000, "doc_id"))
    assert "LessThanOrEqual(doc_id" in text and "Exchange" not in text
    grouped = plan(limit_bytes(documents, "text", 10_000, "doc_id", "source"))
    assert "Window" not in grouped.split("text#")[0]


def test_bucketed_tables_join_without_shuffle(spark, sf_dir):
    orders, names = table(spark, sf_dir, "orders"), []
    for label in ("b1", "b2"):
        spec = TableSpec(
            f"plan_{label}_{id(names)}", (Column("o_custkey", "bigint"), Column("o_orderkey", "bigint")),
            clustered_by=Clustering(("o_custkey",), 4, (SortKey("o_custkey"),)),
        )
        write_table(orders.select("o_custkey", "o_orderkey"), spec)
        names.append(spec.table)
    left, right = map(spark.table, names)
    joined = left.hint("merge").join(right, "o_custkey")
    assert "Exchange" not in plan(joined)
    assert joined.count() > 0
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_map_reduce_shuffles_once_and_sorts_in_the_jvm(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("text")
    text = plan(stream_map_reduce(spark, texts, "cat", "wc -w", 4, combiner="wc -w"))
    assert len(re.findall(r"Exchange hashpartitioning\(key", text)) == 1 and text.count("MapInArrow") == 3


def test_status_joins_are_equi_joins(spark, sf_dir):
    text = plan(J.job_status(derived.jobs(spark, sf_dir), derived.tracker(spark, sf_dir)))
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.fixture
def small_pieces(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "16k")
    yield
    spark.conf.set(name, before)


def _files_per(spark, table_name, column):
    seen = spark.table(table_name).select(column, F.col("_metadata.file_path").alias("f")).distinct()
    return {r[0]: r[1] for r in seen.groupBy(column).count().collect()}


def test_a_hot_partition_is_written_by_several_tasks(spark, tmp_path, small_pieces):
    rows = spark.range(40_000).select(
        F.xxhash64("id").alias("v"), F.when(F.col("id") % 10 < 8, "hot").otherwise((F.col("id") % 10).cast("string")).alias("p")
    )
    spec = TableSpec("plan_hot_partition", (Column("v", "bigint"),), (Column("p", "string"),), location=str(tmp_path / "t"))
    stored = write_table(rows.repartition(16), spec)
    files = _files_per(spark, spec.table, "p")
    assert files["hot"] > 1 and files["8"] <= files["hot"]
    assert stored.where("p = 'hot'").count() == 32_000
    spark.sql(f"DROP TABLE {spec.table}")


def test_a_hot_bucket_is_written_by_several_tasks(spark, tmp_path, small_pieces):
    rows = spark.range(40_000).select(
        F.xxhash64("id").alias("v"), F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id")).cast("bigint").alias("k")
    )
    cluster = Clustering(("k",), 4, (SortKey("v"),))
    spec = TableSpec("plan_hot_bucket", (Column("v", "bigint"), Column("k", "bigint")), clustered_by=cluster, location=str(tmp_path / "t"))
    stored = write_table(rows.repartition(16), spec)
    assert _files_per(spark, spec.table, "k")[1] > 1
    assert stored.where("k = 1").count() >= 32_000
    spark.sql(f"DROP TABLE {spec.table}")


def test_a_hot_group_spreads_over_range_pieces(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("g"), "id")
    pieces = range_pieces(rows, ["g", "id"], 20_000, piece_bytes=1000)
    per_piece = pieces.groupBy("_piece").agg(F.count("*").alias("n"), F.min("g"), F.max("g")).collect()
    assert len(per_piece) > 10 and max(r.n for r in per_piece) < 5000
    assert pieces.where("g = 0").select("_piece").distinct().count() > 10


def test_hot_status_keys_are_split_by_aqe(spark):
    jobs = spark.range(200_000).select(
        "id", F.when(F.col("id") % 3 == 0, -1).cast("bigint").alias("childid"), F.sha2(F.col("id").cast("string"), 256).alias("note")
    )
    tracker = spark.range(0, 200_000, 2).select("id", F.lit(2).alias("runState"))
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        status = J.job_status(jobs.repartition(8), tracker)
        assert status.where("note IS NOT NULL AND runState = 2").count() == 100_000
        status.write.format("noop").mode("overwrite").save()
        out = status.select("id", "runState", "note")
        assert len(out.collect()) == 200_000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_written_table_is_not_counted_bucket_by_bucket(spark, sf_dir):
    """Else as many tasks as there are buckets hold all orders."""
    from lakejobs.plans.check_sources import s9_write_table

    plan = s9_write_table(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Bucketed: true" not in plan and "REPARTITION_BY_NUM" in plan
