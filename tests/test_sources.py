"""Readers and writers on small files."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from lakejobs.errors import BadParam, NotFound
from lakejobs.operators.flow import foreach_generate, group_all_count
from lakejobs.operators.ordered import limit_bytes
from lakejobs.sources.delimited import field, scan_delimited, scan_positional, write_delimited
from lakejobs.sources.files import check_inputs, file_inventory, file_text, modified_before, read_inputs
from lakejobs.sources.formats import format_of
from lakejobs.sources.json_lines import to_documents, write_json_lines
from lakejobs.session import scratch_path
from lakejobs.sources.spec import (
    Clustering, Column, RowFormat, SortKey, Storage, TableSpec, check_identifier, parse_partition,
)
from lakejobs.sources.tables import write_table


def test_pokes(spark, tmp_path):
    path = tmp_path / "pokes.data"
    path.write_bytes(b"1\x01a\n2\x01bb\n3\x01ccc\n")
    rows = scan_delimited(spark, str(path), "id INT, bar STRING").collect()
    assert [tuple(r) for r in rows] == [(1, "a"), (2, "bb"), (3, "ccc")]


def test_short_long_and_bad_lines(spark, tmp_path):
    path = tmp_path / "t"
    path.write_text("1|x|9\n|\nzz|y\n7|\\N\n")
    rows = scan_delimited(spark, str(path), "a int, b string", fields="|").collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (None, ""), (None, "y"), (7, None)]


NESTED = "s string, n int, f double, a array<string>, i array<int>, m map<string,int>, st struct<x:int,y:string>, b binary, t timestamp_ntz, z boolean"


def test_nested_round_trip(spark, tmp_path):
    rows = spark.sql(
        """SELECT * FROM VALUES
        ('x', 1, 1.5D, array('p', NULL, ''), array(1, NULL), map('k', 1, 'l', NULL), named_struct('x', 1, 'y', 'q'),
         X'00FF', timestamp_ntz'2024-01-02 03:04:05.678', true),
        ('', NULL, NULL, array(), array(), map(), NULL, NULL, NULL, NULL),
        (NULL, 2, 1e300D, NULL, NULL, NULL, named_struct('x', NULL, 'y', ''), X'', NULL, false)
        AS t(s, n, f, a, i, m, st, b, t, z)"""
    )
    path = str(tmp_path / "n")
    write_delimited(rows, path)
    back = scan_delimited(spark, path, NESTED)
    assert sorted(back.collect(), key=str) == sorted(rows.collect(), key=str)


def test_refused_values(spark, tmp_path):
    for i, text in enumerate(["a\x01b", "a\nb", "\\N"]):
        df = spark.createDataFrame([(text,)], "v string")
        with pytest.raises(PySparkException, match="cannot be written"):
            write_delimited(df, str(tmp_path / f"bad{i}"))
    with pytest.raises(BadParam):
        write_delimited(spark.sql("SELECT array(array(1)) AS v"), str(tmp_path / "deep"))


def test_partition_directories(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "n int, s string, p string")
    path = str(tmp_path / "p")
    write_delimited(df, path, partition_by=("p",))
    back = scan_delimited(spark, path, "n int, s string")
    assert sorted(map(tuple, back.collect())) == [(1, "a", "x"), (2, "b", "y")]


def test_positional(spark, tmp_path):
    (tmp_path / "readings").write_text(";5.0;n\ns2;;\ns3\n\n")
    df = scan_positional(spark, str(tmp_path / "readings"), ";")
    assert [r.sensor for r in foreach_generate(df, sensor=0).collect()] == ["", "s2", "s3", ""]
    assert [r[0] for r in df.select(field(1)).collect()] == ["5.0", "", None, None]
    (tmp_path / "nums").write_text("1\t3\n2\t4\n")
    nums = scan_positional(spark, str(tmp_path / "nums"))
    assert group_all_count(nums).collect()[0].n == 2
    lines = spark.read.text(str(tmp_path / "nums"))
    assert [r[0] for r in foreach_generate(lines, F.reverse("value")).collect()] == ["3\t1", "4\t2"]
    assert foreach_generate(nums, 0, 1).columns == ["$0", "$1"]


def test_count_of_nothing_is_no_row(spark):
    assert group_all_count(spark.range(0)).collect() == []
    assert group_all_count(spark.sql("SELECT CAST(NULL AS INT) AS a")).collect()[0].n == 0


def test_inputs(spark, tmp_path):
    for name in ("a.txt", "b.txt", "c.dat"):
        (tmp_path / name).write_text(name + "\n")
    both = read_inputs(spark, f"{tmp_path}/a.txt,{tmp_path}/c.dat")
    assert sorted(r.value for r in both.collect()) == ["a.txt", "c.dat"]
    assert read_inputs(spark, [f"{tmp_path}/*.txt"]).count() == 2
    assert check_inputs(spark, f"{tmp_path}/a.txt")[0].startswith("file:/")
    for missing in (f"{tmp_path}/b.tx", f"{tmp_path}/*.csv"):
        with pytest.raises(NotFound):
            read_inputs(spark, [f"{tmp_path}/a.txt", missing])
    (tmp_path / "2.sql").write_text("SELECT 2 AS n")
    (tmp_path / "1.sql").write_text("CREATE OR REPLACE TEMP VIEW first_file AS SELECT 1 AS n;")
    assert file_text(spark, f"{tmp_path}/*.sql") == "CREATE OR REPLACE TEMP VIEW first_file AS SELECT 1 AS n;\nSELECT 2 AS n"


def test_inventory(spark, tmp_path):
    os.makedirs(tmp_path / "x" / "y")
    (tmp_path / "x" / "one").write_text("12345")
    (tmp_path / "x" / "y" / "two").write_text("1")
    os.utime(tmp_path / "x" / "one", (1000, 1000))
    files = file_inventory(spark, str(tmp_path / "x"))
    assert sorted(r.length for r in files.collect()) == [1, 5]
    assert [r.length for r in modified_before(files, 2_000_000, 500_000).collect()] == [5]
    assert [r.length for r in modified_before(files, 1_500_000, 500_000).collect()] == []


def test_json_lines(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b")
    write_json_lines(df, str(tmp_path / "j"), database="d")
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()] == [{"a": 1, "database": "d"}]
    assert json.loads(to_documents(df, table="t").first().doc) == {"a": 1, "table": "t"}


FULL = {
    "table": "sensor_log",
    "comment": "one row per reading",
    "columns": [
        {"name": "sensor", "type": "struct<site:string,no:int>"},
        {"name": "values", "type": "array<double>", "comment": "in order of time"},
        {"name": "at", "type": "timestamp"},
    ],
    "partitionedBy": [{"name": "day", "type": "date"}, {"name": "kind", "type": "int", "comment": "0 to 9"}],
    "clusteredBy": {"columnNames": ["at"], "sortedBy": [{"columnName": "at", "order": "DESC"}], "numberOfBuckets": 3},
    "format": {
        "rowFormat": {"fieldsTerminatedBy": "\x01", "serde": {"name": "my.Serde", "properties": {"k": "v"}}},
        "storedAs": "rcfile",
        "storedBy": {"className": "my.Handler", "properties": {"a": "b"}},
    },
    "location": "/somewhere",
    "external": True,
    "ifNotExists": True,
    "tableProperties": {"owner": "ops", "tier": "2"},
}


def test_spec_json():
    spec = TableSpec.from_json(FULL)
    assert spec.to_json() == FULL
    assert TableSpec.from_json(spec.to_json()) == spec
    assert spec.clustered_by == Clustering(("at",), 3, (SortKey("at", "DESC"),))
    small = TableSpec("t", (Column("i", "int"),))
    assert TableSpec.from_json(small.to_json()) == small
    assert TableSpec.from_json({"columns": []}, "given").table == "given"


def test_names_and_partitions():
    for bad in ("1a", "a-b", "", "a b", "a.b"):
        with pytest.raises(BadParam, match="Invalid DDL identifier table"):
            check_identifier(bad, "table")
    with pytest.raises(BadParam, match="Missing table parameter"):
        check_identifier(None, "table")
    assert parse_partition("dt='20120101',country='US'") == {"dt": "20120101", "country": "US"}
    assert parse_partition("""n=3 , s="a b" """) == {"n": "3", "s": "a b"}
    for bad in ("", "dt", "dt='a' country='b'", "dt='a',", "dt='a"):
        with pytest.raises(BadParam):
            parse_partition(bad)


def test_formats():
    assert format_of(Storage()) == ("parquet", {})
    with pytest.warns(UserWarning, match="rcfile needs a Hive catalog"):
        assert format_of(Storage(stored_as="RCFile"))[0] == "parquet"
    assert format_of(Storage(RowFormat(fields=";")))[1]["sep"] == ";"
    assert format_of(Storage(RowFormat(serde="my.source", serde_properties={"k": "v"}))) == ("my.source", {"k": "v"})
    assert format_of(Storage(stored_by="jdbc", properties={"url": "u"})) == ("jdbc", {"url": "u"})
    full = RowFormat("\x01", "\x02", "\x03", "\n")
    assert format_of(Storage(full, "rcfile"), hive=True) == ("hive", {"fileFormat": "rcfile"})
    assert format_of(Storage(full), hive=True) == ("hive", {
        "fileFormat": "textfile", "fieldDelim": "\x01", "collectionDelim": "\x02", "mapkeyDelim": "\x03", "lineDelim": "\n",
    })
    assert format_of(Storage(stored_as="orc"), hive=True) == ("orc", {})
    with pytest.raises(BadParam):
        format_of(Storage(stored_as="nothing"))


@pytest.mark.parametrize("limit", [0, 1, 7, 8, 50, 333, 10_000])
def test_limit_bytes(spark, limit):
    sizes = [(g, i, "é" * (i * 7 % 5)) for g in ("a", "b", None) for i in range(40)] + [("big", 0, "x" * 60)]
    df = spark.createDataFrame(sizes, "g string, i int, t string").repartition(5)

    def prefix(rows):
        total, kept = 0, []
        for row in sorted(rows, key=lambda r: r[1]):
            total += len(row[2].encode()) + 1
            if total > limit:
                break
            kept.append(row)
        return kept

    expected = {r for g in ("a", "b", None, "big") for r in prefix([s for s in sizes if s[0] == g])}
    assert set(map(tuple, limit_bytes(df, "t", limit, "i", "g").collect())) == expected
    one = [s for s in sizes if s[0] == "a"]
    whole = df.where("g = 'a'")
    assert set(map(tuple, limit_bytes(whole, "t", limit, "i").collect())) == set(prefix(one))
    assert set(map(tuple, limit_bytes(whole, "t", limit, ["g", "i"]).collect())) == set(prefix(one))


def test_limit_bytes_by_null_and_by_time(spark):
    rows = [(None, "ab"), (2, "cd"), (3, "ef")]
    df = spark.createDataFrame(rows, "i int, t string")
    for limit, count in ((2, 0), (3, 1), (6, 2), (1000, 3)):
        assert limit_bytes(df, "t", limit, "i").count() == count
        assert limit_bytes(df.withColumn("g", F.lit(1)), "t", limit, "i", "g").count() == count
    times = spark.range(20).select(F.expr("timestamp_ntz'2024-03-10 02:30:00' + make_dt_interval(0, 0, 0, id)").alias("at"), F.lit("x").alias("t"))
    assert limit_bytes(times, "t", 10, "at").count() == 5


@pytest.mark.parametrize(
    "storage",
    [
        Storage(RowFormat(serde="org.apache.hadoop.hive.ql.io.orc.OrcSerde")),
        Storage(RowFormat(serde="org.apache.hadoop.hive.serde2.JsonSerDe", serde_properties={"timestampNTZFormat": "yyyy/MM/dd"})),
        Storage(RowFormat(serde="org.apache.hadoop.hive.serde2.lazy.LazySimpleSerDe", serde_properties={"sep": ";"})),
        Storage(stored_by="json", properties={"dateFormat": "dd.MM.yyyy"}),
        Storage(stored_as="sequencefile"),
    ],
)
@pytest.mark.filterwarnings("ignore:stored as")
def test_tables_of_serdes_and_handlers(spark, new_table, storage):
    """Written and read again, with the properties in effect."""
    spec = TableSpec(
        new_table("serde"), (Column("id", "bigint"), Column("name", "string"), Column("day", "date")), storage=storage, location=scratch_path(spark, "serde"), partitioned_by=(Column("p", "int"),)
    )
    rows = spark.range(20).select("id", F.concat(F.lit("n;"), "id").alias("name") if "json" in str(storage).lower() else F.concat(F.lit("n"), "id").alias("name"),
                                  F.date_add(F.lit("2024-01-30").cast("date"), F.col("id").cast("int")).alias("day"), (F.col("id") % 3).cast("int").alias("p"))
    write_table(rows, spec)
    assert sorted(map(tuple, spark.table(spec.table).collect())) == sorted(map(tuple, rows.collect()))
    if storage.stored_by:
        assert spark.read.text(spec.location).where("value LIKE '%\"day\":\"30.01.2024\"%'").count() == 1


def test_avro_needs_its_package(spark, new_table):
    """The word is known; without Spark's avro package on the class path the error names it."""
    spec = TableSpec(new_table("avro"), (Column("id", "bigint"),), storage=Storage(stored_as="avro"), location=scratch_path(spark, "avro"))
    try:
        write_table(spark.range(5), spec)
    except AnalysisException as error:
        assert "avro" in str(error).lower()
    else:
        assert spark.table(spec.table).count() == 5
