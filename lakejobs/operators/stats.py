"""Descriptions and statistics of tables and their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.errors import MISSING_COLUMN, MISSING_TABLE, JobError, NotFound
from lakejobs.sources.files import file_inventory
from lakejobs.sources.spec import quote_name, table_exists
from lakejobs.sources.tables import describe

COLUMN_SCHEMA = "position int, name string, type string, comment string, partition boolean"


def _column_facts(df: DataFrame, partition_names: list[str] = ()) -> list[tuple]:
    fields = sorted(df.schema.fields, key=lambda f: f.name in partition_names)
    return [
        (i, f.name, f.dataType.simpleString(), f.metadata.get("comment"), f.name in partition_names)
        for i, f in enumerate(fields)
    ]


def column_array(df: DataFrame, only: list[str] | None = None, skip: list[str] = ()) -> Column:
    """The columns of a relation as a literal array of (name, type, comment)."""
    kept = [f for f in _column_facts(df) if f[1] not in skip and (only is None or f[1] in only)]
    made = [
        F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(c).cast("string").alias("comment"))
        for _, n, t, c, _ in kept
    ]
    kind = "array<struct<name:string,type:string,comment:string>>"
    return (F.array(*made) if made else F.array()).cast(kind)


def describe_columns(spark: SparkSession, target: str | DataFrame) -> DataFrame:
    """One row per column (name, type, comment), partition columns last."""
    df = target
    names: list[str] = []
    if isinstance(target, str):
        if not table_exists(spark, target):
            raise NotFound(MISSING_TABLE.format(target))
        df = spark.table(target)
        names = describe(spark, target).get("partition_columns", [])
    return spark.createDataFrame(_column_facts(df, names), COLUMN_SCHEMA)


def describe_column(spark: SparkSession, target: str | DataFrame, name: str) -> DataFrame:
    """The row of :func:`describe_columns` for one column, by its exact name."""
    df = spark.table(target) if isinstance(target, str) else target
    if name not in df.columns:
        raise JobError(MISSING_COLUMN.format(name))
    return describe_columns(spark, target).where(F.col("name") == name)


def profile_columns(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """Per column: rows, nulls, distinct values, smallest and largest value as text.

    One aggregate over one scan. Exact distinct counts add a second pass that counts each
    (column, value) once per task before the shuffle, so a frequent value costs no more than a rare one.
    """
    facts = []
    for i, f in enumerate(df.schema.fields):
        col = F.col(quote_name(f.name))
        plain = not isinstance(f.dataType, (T.MapType, T.VariantType))
        facts.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("name"),
                F.count("*").alias("rows"),
                F.count_if(col.isNull()).alias("nulls"),
                (F.approx_count_distinct(col) if plain and not exact_distinct else F.lit(None))
                .cast("long")
                .alias("distinct"),
                (F.min(col) if plain else F.lit(None)).cast("string").alias("min"),
                (F.max(col) if plain else F.lit(None)).cast("string").alias("max"),
            )
        )
    profile = df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))
    if not exact_distinct:
        return profile
    cells = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("position"), F.col(quote_name(n)).cast("string").alias("v"))
                    for i, n in enumerate(df.columns)
                ]
            )
        ).alias("cell")
    ).select("cell.*")
    distinct = (
        cells.where(F.col("v").isNotNull())
        .distinct()
        .groupBy("position")
        .agg(F.count("*").alias("distinct"))
    )
    exact = F.coalesce(distinct["distinct"], F.lit(0)).alias("distinct")
    return profile.join(distinct, "position", "left").select(
        "position", "name", "rows", "nulls", exact, "min", "max"
    )


def profile_column(df: DataFrame, name: str, exact_distinct: bool = False) -> DataFrame:
    """:func:`profile_columns` of one column; the scan reads that column only."""
    if name not in df.columns:
        raise JobError(MISSING_COLUMN.format(name))
    return profile_columns(df.select(quote_name(name)), exact_distinct).drop("position")


def _directory_time(spark: SparkSession, location: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(path).getModificationTime() if fs.exists(path) else 0


def file_totals(spark: SparkSession, inventory: DataFrame, location: str) -> DataFrame:
    """File statistics of an inventory as one row; sizes are 0 where there is no file."""
    size = lambda agg: F.coalesce(agg, F.lit(0)).cast("long")
    changed = F.coalesce(F.max(F.unix_millis("modified")), F.lit(_directory_time(spark, location)))
    return inventory.agg(
        F.count("*").alias("totalNumberFiles"),
        size(F.sum("length")).alias("totalFileSize"),
        size(F.max("length")).alias("maxFileSize"),
        size(F.min("length")).alias("minFileSize"),
        changed.cast("long").alias("lastUpdateTime"),
    )


def table_stats(spark: SparkSession, target: str, fmt: str = "parquet") -> DataFrame:
    """One row about a table (by name) or a directory: layout, columns and file statistics.

    Files come from a listing, so those without rows count too. A partitioned table may keep
    partitions elsewhere; their files are added from the metadata of a scan that reads no column.
    """
    if "/" in target:
        df, location, names = spark.read.format(fmt).load(target), target, []
        files = file_inventory(spark, location)
    else:
        if not table_exists(spark, target):
            raise NotFound(MISSING_TABLE.format(target))
        facts = describe(spark, target)
        df, location = spark.table(target), facts["location"]
        names = facts.get("partition_columns", [])
        files = file_inventory(spark, location)
        if names:
            seen = df.select(
                F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_size").alias("length"),
                F.col("_metadata.file_modification_time").alias("modified"),
            )
            files = files.unionByName(seen).distinct()
    return file_totals(spark, files, location).select(
        F.lit(location).alias("location"),
        F.lit(bool(names)).alias("partitioned"),
        column_array(df, skip=names).alias("columns"),
        column_array(df, only=names).alias("partitionColumns"),
        "totalNumberFiles",
        "totalFileSize",
        "maxFileSize",
        "minFileSize",
        "lastUpdateTime",
    )
