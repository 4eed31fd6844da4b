"""Partitions of a catalog table: list, describe, add, drop."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.errors import (
    MISSING_PARTITION,
    MISSING_TABLE,
    NOT_PARTITIONED,
    PARTITION_EXISTS,
    AlreadyExists,
    NotFound,
)
from lakejobs.operators.stats import column_array, file_totals
from lakejobs.sources.files import file_inventory
from lakejobs.sources.spec import (
    parse_partition,
    partition_name,
    quote_name,
    quote_text,
    table_exists,
)
from lakejobs.sources.tables import conform, describe, partition_clause, qualified

# Fixed value: the directory name of a null partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
# Partitions named in one catalog statement.
DROP_AT_ONCE = 500


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    """Partition column names of a table, in declared order."""
    if not table_exists(spark, table):
        raise NotFound(MISSING_TABLE.format(table))
    return describe(spark, table).get("partition_columns", [])


def _name_of(columns: list[str]):
    """``dt='20120101',country='IN'`` from the partition columns of a row."""
    parts = [
        F.concat(
            F.lit(f"{c}='"),
            F.coalesce(F.col(quote_name(c)).cast("string"), F.lit(NULL_PARTITION)),
            F.lit("'"),
        )
        for c in columns
    ]
    return F.concat_ws(",", *parts)


def partition_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, files and bytes per partition of a DataFrame that scans files.

    Only file metadata and the partition columns are read. Counting per file first lets each scan
    task send one row per file, whatever the size of a partition.
    """
    keys = [quote_name(c) for c in columns]
    per_file = df.groupBy(
        *keys,
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_size").alias("_size"),
    ).agg(F.count("*").alias("_rows"))
    return (
        per_file.groupBy(*keys)
        .agg(
            F.sum("_rows").alias("rows"),
            F.count("*").alias("files"),
            F.sum("_size").alias("bytes"),
        )
        .withColumn("name", _name_of(columns))
    )


def _values(col: str):
    """The (columnName, columnValue) pairs of a catalog partition name such as ``dt=1/country=I%2FN``."""

    def decode(text):
        return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))

    return F.transform(
        F.split(col, "/"),
        lambda p: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("columnName"),
            decode(F.split(p, "=", 2)[1]).alias("columnValue"),
        ),
    )


def partitions(spark: SparkSession, table: str) -> DataFrame:
    """One row per partition, also where it has no rows: name, values, rows, files, bytes."""
    columns = partition_columns(spark, table)
    if not columns:
        raise NotFound(NOT_PARTITIONED.format(table))
    declared = spark.sql(f"SHOW PARTITIONS {qualified(table)}").select(
        _values("partition").alias("values")
    )
    named = declared.withColumn(
        "name",
        F.array_join(
            F.transform(
                "values",
                lambda v: F.concat(v["columnName"], F.lit("='"), v["columnValue"], F.lit("'")),
            ),
            ",",
        ),
    )
    full = spark.table(table)
    keys = [f"_key{i}" for i in range(len(columns))]
    found = partition_stats(full, columns).select(
        *[F.col(quote_name(c)).alias(k) for c, k in zip(columns, keys)], "rows", "files", "bytes"
    )
    # By value: a directory such as p=01 of an int column holds rows with p = 1.
    same = F.lit(True)
    for i, (column, key) in enumerate(zip(columns, keys)):
        text = F.nullif(F.col("values")[i]["columnValue"], F.lit(NULL_PARTITION))
        same = same & text.cast(full.schema[column].dataType).eqNullSafe(F.col(key))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", "files", "bytes")]
    return named.join(found, same, "left").select("name", "values", *zero).orderBy("name")


def _partition_location(spark: SparkSession, table: str, values: dict[str, str]) -> str | None:
    """Where a partition's files are, or None if there is no such partition."""
    try:
        return describe(spark, table, values)["location"]
    except AnalysisException as error:
        if (error.getCondition() or "").startswith("PARTITION"):
            return None
        raise


def describe_partition(spark: SparkSession, table: str, spec: str) -> DataFrame:
    """One row about one partition: its files, columns and number of rows.

    Both the row count and the file listing touch that partition only.
    """
    columns = partition_columns(spark, table)
    values = parse_partition(spec)
    location = _partition_location(spark, table, values)
    if location is None:
        raise NotFound(MISSING_PARTITION.format(spec))
    full = spark.table(table)
    wanted = full
    for name, value in values.items():
        text = F.lit(value).cast(full.schema[name].dataType)
        column = F.col(quote_name(name))
        wanted = wanted.where(column.isNull() if value == NULL_PARTITION else column == text)
    totals = file_totals(spark, file_inventory(spark, location), location)
    return totals.select(
        F.lit(partition_name(values)).alias("partition"),
        F.lit(True).alias("partitioned"),
        column_array(full, skip=columns).alias("columns"),
        column_array(full, only=columns).alias("partitionColumns"),
        F.lit(location).alias("location"),
        *totals.columns,
        wanted.agg(F.count("*")).scalar().alias("numberOfRows"),
    )


def add_partition(
    spark: SparkSession,
    table: str,
    spec: str,
    df: DataFrame | None = None,
    location: str | None = None,
    if_not_exists: bool = False,
) -> bool:
    """Add one partition, with the rows of ``df``; True if it was added.

    A partition that exists is an error, or with ``if_not_exists`` is left as it is. If the rows
    cannot be written, the partition goes again.
    """
    partition_columns(spark, table)
    values = parse_partition(spec)
    if _partition_location(spark, table, values) is not None:
        if if_not_exists:
            return False
        raise AlreadyExists(PARTITION_EXISTS, table=table, partition=spec)
    at = f" LOCATION {quote_text(location)}" if location else ""
    clause = f"PARTITION ({partition_clause(values)})"
    spark.sql(f"ALTER TABLE {qualified(table)} ADD {clause}{at}")
    if df is not None:
        schema = spark.table(table).schema
        rows = conform(df, type(schema)([f for f in schema if f.name not in values]))
        try:
            spark.sql(f"INSERT INTO {qualified(table)} {clause} SELECT * FROM {{rows}}", rows=rows)
        except BaseException:
            spark.sql(f"ALTER TABLE {qualified(table)} DROP IF EXISTS {clause}")
            raise
    return True


def drop_partition(spark: SparkSession, table: str, spec: str, if_exists: bool = False) -> None:
    """Drop every partition that matches; a partial spec may match several, none is an error."""
    partition_columns(spark, table)
    clause = partition_clause(parse_partition(spec))
    matching = spark.sql(f"SHOW PARTITIONS {qualified(table)} PARTITION ({clause})")
    named = matching.select(_values("partition").alias("values")).collect()  # names, not rows
    if not named and not if_exists:
        raise NotFound(MISSING_PARTITION.format(spec))
    specs = [f"PARTITION ({partition_clause({v[0]: v[1] for v in row[0]})})" for row in named]
    for start in range(0, len(specs), DROP_AT_ONCE):
        several = ", ".join(specs[start : start + DROP_AT_ONCE])
        spark.sql(f"ALTER TABLE {qualified(table)} DROP IF EXISTS {several}")
