"""Declared tables, partitions, evolution and statistics."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from lakejobs.errors import AlreadyExists, BadParam, JobError, NotFound
from lakejobs.operators.partitions import (
    NULL_PARTITION, add_partition, describe_partition, drop_partition, partitions,
)
from lakejobs.operators.stats import (
    describe_column, describe_columns, profile_column, profile_columns, table_stats,
)
from lakejobs.sources.spec import Clustering, Column, RowFormat, SortKey, Storage, TableSpec
from lakejobs.sources.tables import (
    add_column, conform, create_like, create_table, describe, load_overwrite, scan_external, write_table,
)

I, J = Column("i", "int", "column with comment"), Column("j", "bigint")
PARTS = (Column("dt", "string"), Column("country", "string"))
US, IN = "dt='20120101',country='US'", "dt='20120101',country='IN'"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_simple_table(spark, new_table, tmp_path):
    name = new_table()
    spec = TableSpec(name, (I, J), location=str(tmp_path / "t"), comment="it's a table", properties={"prop1": "va'l1"})
    create_table(spark, spec)
    facts = describe(spark, name)
    assert facts["comment"] == "it's a table" and facts["table_properties"]["prop1"] == "va'l1"
    assert [(r.name, r.type, r.comment) for r in describe_columns(spark, name).collect()] == [
        ("i", "int", "column with comment"), ("j", "bigint", None),
    ]
    with pytest.raises(AlreadyExists):
        create_table(spark, spec)
    df = spark.createDataFrame([(1, 2)], "i int, j bigint")
    assert write_table(df, TableSpec(name, (I, J), if_not_exists=True)).count() == 0


def test_full_table(spark, new_table, tmp_path):
    spec = TableSpec(
        new_table(), (I, J, Column("note", "string", "free text")), PARTS,
        Clustering(("j",), 6, (SortKey("j"), SortKey("i"))),
        Storage(RowFormat("\x01", "\x02", "\x03", "\n"), "rcfile"),
        location=str(tmp_path / "t"), properties={"team": "ops"},
    )
    df = spark.range(50).select(
        F.lit("20120101").alias("dt"), F.when(F.col("id") < 30, "US").alias("country"),
        F.col("id").cast("int").alias("i"), F.col("id").alias("j"), F.lit("-").alias("note"),
    )
    table = write_table(df, spec)
    assert table.columns == ["i", "j", "note", "dt", "country"]
    assert rows_of(table.groupBy("country").count()) == [("US", 30), (None, 20)]
    names = [r.name for r in partitions(spark, spec.table).collect()]
    assert names == [US, f"dt='20120101',country='{NULL_PARTITION}'"] or names == sorted(names)
    about = describe_partition(spark, spec.table, f"dt='20120101',country='{NULL_PARTITION}'").first()
    assert about.numberOfRows == 20


def test_external_table_leaves_files(spark, new_table, tmp_path):
    place = str(tmp_path / "e")
    spark.range(5).write.parquet(place)
    spec = TableSpec(new_table(), (Column("id", "bigint"),), location=place, external=True)
    assert create_table(spark, spec).count() == 5
    spark.sql(f"DROP TABLE {spec.table}")
    assert scan_external(spark, place, "id bigint, more string").where("more IS NULL").count() == 5
    with pytest.raises(BadParam):
        create_table(spark, TableSpec(spec.table, (I,), external=True))


def test_failed_fill_leaves_no_table(spark, new_table, tmp_path):
    spec = TableSpec(new_table(), (I,), location=str(tmp_path / "t"))
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("i"))
    with pytest.raises(Exception, match="no"):
        write_table(bad, spec)
    assert not spark.catalog.tableExists(spec.table)


def test_nested_text_table_is_refused(spark, new_table):
    columns = (Column("a", "array<int>"),)
    with pytest.raises(BadParam):
        create_table(spark, TableSpec(new_table(), columns, storage=Storage(stored_as="textfile")))


def test_conform(spark):
    df = spark.createDataFrame([(1, "5")], "a int, b string")
    out = conform(df, (Column("b", "int"), Column("c", "array<int>"), Column("a", "chararray", "text")))
    assert out.schema.simpleString() == "struct<b:int,c:array<int>,a:string>"
    assert tuple(out.first()) == (5, None, "1") and out.schema["a"].metadata == {"comment": "text"}
    with pytest.raises(BadParam, match="unable to find column b"):
        conform(df, (Column("a", "int"),))


@pytest.mark.parametrize("order", ["ASC", "DESC"])
def test_bucket_files_are_sorted(spark, new_table, tmp_path, order):
    spec = TableSpec(
        new_table(), (I, J), clustered_by=Clustering(("i",), 4, (SortKey("j", order),)), location=str(tmp_path / "t")
    )
    df = spark.range(2000).select((F.col("id") % 50).cast("int").alias("i"), F.hash("id").cast("bigint").alias("j"))
    write_table(df.repartition(7), spec)
    assert spark.table(spec.table).count() == 2000
    for path in glob.glob(f"{tmp_path}/t/*.parquet"):
        stored = spark.read.parquet(path).withColumn("b", F.pmod(F.hash("i"), F.lit(4)))
        for bucket in {r.b for r in stored.select("b").distinct().collect()}:
            js = [r.j for r in stored.where(F.col("b") == bucket).collect()]
            assert js == sorted(js, reverse=order == "DESC")


def partitioned(spark, new_table, tmp_path):
    spec = TableSpec(new_table(), (I, J), PARTS, location=str(tmp_path / "t"))
    create_table(spark, spec)
    return spec.table


def test_partition_walk(spark, new_table, tmp_path):
    name = partitioned(spark, new_table, tmp_path)
    rows = spark.createDataFrame([(1, 10), (2, 20)], "i int, j bigint")
    assert add_partition(spark, name, US, rows, location=str(tmp_path / "loc1"))
    assert add_partition(spark, name, IN)
    with pytest.raises(AlreadyExists, match="Partition already exists") as caught:
        add_partition(spark, name, IN)
    assert caught.value.code == 409 and '"errorCode": 409' in caught.value.document()
    assert not add_partition(spark, name, IN, if_not_exists=True)
    listed = partitions(spark, name).collect()
    assert [(r.name, r["rows"], r.files > 0) for r in listed] == [
        ("dt='20120101',country='IN'", 0, False), ("dt='20120101',country='US'", 2, True),
    ]
    assert [tuple(v) for v in listed[0]["values"]] == [("dt", "20120101"), ("country", "IN")]
    about = describe_partition(spark, name, US).first()
    assert (about.partition, about.numberOfRows, about.location.endswith("/loc1")) == (US, 2, True)
    assert [c.name for c in about.partitionColumns] == ["dt", "country"]
    assert about.totalFileSize > 0 and about.totalNumberFiles >= 1
    assert table_stats(spark, name).first().totalFileSize == about.totalFileSize
    drop_partition(spark, name, IN)
    with pytest.raises(NotFound, match="does not exist"):
        describe_partition(spark, name, IN)
    with pytest.raises(NotFound):
        drop_partition(spark, name, IN)
    drop_partition(spark, name, IN, if_exists=True)
    for country in ("A/B", "C+D=E", "F%G"):
        add_partition(spark, name, f"dt='20120102',country='{country}'", rows)
    assert [r["values"][1].columnValue for r in partitions(spark, name).collect()] == ["US", "A/B", "C+D=E", "F%G"]
    drop_partition(spark, name, "dt='20120102'")
    assert [r.name for r in partitions(spark, name).collect()] == [US]


def test_failed_partition_goes_again(spark, new_table, tmp_path):
    name = partitioned(spark, new_table, tmp_path)
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("i"))
    with pytest.raises(Exception, match="no"):
        add_partition(spark, name, US, bad)
    assert partitions(spark, name).count() == 0


def test_unknown_tables(spark, new_table, tmp_path):
    for call in (partitions, table_stats, describe_columns):
        with pytest.raises(NotFound, match="Table nowhere does not exist"):
            call(spark, "nowhere")
    plain = TableSpec(new_table(), (I,), location=str(tmp_path / "x"))
    create_table(spark, plain)
    with pytest.raises(NotFound):
        partitions(spark, plain.table)


def test_load_overwrite(spark, new_table, tmp_path):
    name = partitioned(spark, new_table, tmp_path)
    df = spark.createDataFrame([(1, 10)], "i int, j bigint")
    add_partition(spark, name, US, df)
    add_partition(spark, name, IN, df)
    load_overwrite(spark, df.withColumn("j", F.lit(99).cast("bigint")), name, US)
    assert rows_of(spark.table(name).select("j", "country")) == [(10, "IN"), (99, "US")]
    load_overwrite(spark, df.limit(0), name, IN)
    assert rows_of(spark.table(name).select("j", "country")) == [(99, "US")]
    both = spark.createDataFrame([(5, 50, "20120101", "US")], "i int, j bigint, dt string, country string")
    for mode in ("dynamic", "static"):
        add_partition(spark, name, IN, df, if_not_exists=True)
        load_overwrite(spark, df, name, IN)
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        load_overwrite(spark, both, name)
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
        assert rows_of(spark.table(name)) == [(5, 50, "20120101", "US")]
    text = TableSpec(new_table(), (Column("id", "INT"), Column("bar", "STRING")),
                     storage=Storage(RowFormat("\x01"), "textfile"), location=str(tmp_path / "pokes_table"))
    create_table(spark, text, spark.createDataFrame([(9, "old")], "id int, bar string"))
    (tmp_path / "pokes.data").write_bytes(b"1\x01a\n2\x01bb\n3\x01ccc\n")
    load_overwrite(spark, str(tmp_path / "pokes.data"), text.table)
    assert rows_of(spark.table(text.table)) == [(1, "a"), (2, "bb"), (3, "ccc")]
    with pytest.raises(NotFound, match="File .* does not exist."):
        load_overwrite(spark, str(tmp_path / "none"), text.table)


def test_add_column(spark, new_table, tmp_path):
    name = partitioned(spark, new_table, tmp_path)
    add_partition(spark, name, US, spark.createDataFrame([(1, 10)], "i int, j bigint"))
    add_column(spark, name, Column("k", "string", "The k column"))
    found = [(r.name, r.comment) for r in describe_columns(spark, name).orderBy("position").collect()]
    assert found == [("i", "column with comment"), ("j", None), ("k", "The k column"), ("dt", None), ("country", None)]
    assert rows_of(spark.table(name).select("i", "k")) == [(1, None)]
    with pytest.raises(AlreadyExists):
        add_column(spark, name, Column("k", "string"))
    with pytest.raises(BadParam):
        add_column(spark, name, Column("l", ""))
    assert describe_column(spark, name, "k").first().type == "string"
    with pytest.raises(JobError, match="unable to find column K"):
        describe_column(spark, name, "K")


def test_create_like(spark, new_table, tmp_path):
    name, new = partitioned(spark, new_table, tmp_path), new_table("like")
    add_partition(spark, name, US, spark.createDataFrame([(1, 10)], "i int, j bigint"))
    create_like(spark, name, new, str(tmp_path / "like"))
    assert spark.table(new).schema == spark.table(name).schema and spark.table(new).count() == 0
    with pytest.raises(AlreadyExists):
        create_like(spark, name, new)
    create_like(spark, name, new, if_not_exists=True)
    with pytest.raises(NotFound):
        create_like(spark, "nowhere", new_table())


def test_stats_of_an_empty_table(spark, new_table, tmp_path):
    spec = TableSpec(new_table(), (I, J), location=str(tmp_path / "t"))
    create_table(spark, spec)
    os.makedirs(tmp_path / "t", exist_ok=True)
    row = table_stats(spark, spec.table).first()
    assert (row.totalNumberFiles, row.totalFileSize, row.maxFileSize, row.minFileSize) == (0, 0, 0, 0)
    assert len(str(row.lastUpdateTime)) == 13 and not row.partitioned


def test_stats_of_a_directory(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "d"))
    sizes = [os.path.getsize(p) for p in glob.glob(f"{tmp_path}/d/*.parquet")]
    row = table_stats(spark, str(tmp_path / "d")).first()
    assert (row.totalNumberFiles, row.totalFileSize, row.maxFileSize, row.minFileSize) == (
        len(sizes), sum(sizes), max(sizes), min(sizes),
    )
    assert [c.name for c in row.columns] == ["id"]


def test_profile(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', map(1, 2)), (1, NULL, NULL), (3, 'b', map()) AS t(n, s, m)")
    exact = {r.name: tuple(r)[2:] for r in profile_columns(df.drop("m"), exact_distinct=True).collect()}
    assert exact == {"n": (3, 0, 2, "1", "3"), "s": (3, 1, 2, "a", "b")}
    near = {r.name: (r["rows"], r.nulls) for r in profile_columns(df).collect()}
    assert near == {"n": (3, 0), "s": (3, 1), "m": (3, 1)}
    assert profile_column(df, "s").columns == ["name", "rows", "nulls", "distinct", "min", "max"]
    empty = profile_columns(df.drop("m").limit(0), exact_distinct=True).collect()
    assert [r["distinct"] for r in empty] == [0, 0]


def test_partitions_are_counted_by_value(spark, new_table, tmp_path):
    name, path = new_table(), str(tmp_path / "t")
    spark.range(3).coalesce(1).write.parquet(f"{path}/p=01")
    spark.range(2).coalesce(1).write.parquet(f"{path}/p=__HIVE_DEFAULT_PARTITION__")
    spark.sql(f"CREATE TABLE {name} (id BIGINT, p INT) USING parquet PARTITIONED BY (p) LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    assert sorted(r.rows for r in partitions(spark, name).collect()) == [2, 3]
