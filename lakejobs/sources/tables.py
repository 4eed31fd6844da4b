"""Tables with a declared layout: create, fill, load, read in place."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.errors import (
    COLUMN_EXISTS,
    MISSING_COLUMN,
    MISSING_PARAM,
    MISSING_TABLE,
    TABLE_EXISTS,
    AlreadyExists,
    BadParam,
    NotFound,
)
from lakejobs.sources.files import check_inputs
from lakejobs.sources.formats import STORED_AS, format_of
from lakejobs.sources.spec import (
    TYPE_ALIASES,
    Clustering,
    Column,
    TableSpec,
    columns_of,
    parse_partition,
    quote_name,
    quote_text,
    table_exists,
)


def conform(df: DataFrame, columns) -> DataFrame:
    """Rename-free projection onto declared columns: order, type and comment as declared.

    A declared column the data lacks is null; a data column that is not declared is an error.
    """
    declared = columns_of(columns).fields
    unknown = [name for name in df.columns if name not in {f.name for f in declared}]
    if unknown:
        raise BadParam(MISSING_COLUMN.format(unknown[0]))
    have = set(df.columns)
    return df.select(
        *[
            (df[quote_name(f.name)] if f.name in have else F.lit(None))
            .cast(f.dataType)
            .alias(f.name, metadata=f.metadata)
            for f in declared
        ]
    )


def create_table(spark: SparkSession, spec: TableSpec, df: DataFrame | None = None) -> DataFrame:
    """Create the declared table and, with ``df``, fill it. Returns the table.

    A table that exists is an error, or with ``if_not_exists`` is left as it is. An external table
    over a location that holds files already takes them as its rows.
    """
    if table_exists(spark, spec.table):
        if spec.if_not_exists:
            return spark.table(spec.table)
        raise AlreadyExists(TABLE_EXISTS.format(spec.table))
    if spec.external and not spec.location:
        raise BadParam(MISSING_PARAM.format("location"))
    spark.sql(_create_statement(spark, spec))
    if df is not None:
        try:
            arrange(conform(df, spec.schema()), spec).write.insertInto(spec.table)
        except BaseException:
            spark.sql(f"DROP TABLE IF EXISTS {qualified(spec.table)}")
            raise
    return spark.table(spec.table)


def write_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Sink: the rows of ``df`` as a new table with the declared layout."""
    return create_table(df.sparkSession, spec, df)


def arrange(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Bring rows of one partition and bucket together before a write.

    The REBALANCE hint lets AQE split a partition value or bucket that holds much of the data over
    several tasks and files, and merge small ones, by the advisory partition size. Files of one
    bucket keep the declared sort order.
    """
    parts, cluster = spec.partition_names, spec.clustered_by
    if cluster is None:
        return df.hint("rebalance", *parts) if parts else df
    placed = df.withColumn("_bucket", bucket_number(cluster))
    placed = placed.hint("rebalance", *parts, "_bucket")
    if _descending(cluster):
        # Catalog buckets sort ascending only; here each file is a run of whole buckets instead.
        keys = [F.col(quote_name(k.column)) for k in cluster.sorted_by]
        order = [c.desc() if k.order == "DESC" else c.asc() for c, k in zip(keys, cluster.sorted_by)]
        placed = placed.sortWithinPartitions(*parts, "_bucket", *order)
    return placed.drop("_bucket")


def bucket_number(cluster: Clustering):
    """The bucket of a row, by the hash Spark's own bucketed tables use."""
    return F.pmod(F.hash(*[quote_name(c) for c in cluster.columns]), F.lit(cluster.buckets))


def _descending(cluster: Clustering) -> bool:
    return any(k.order == "DESC" for k in cluster.sorted_by)


def column_clause(column: Column) -> str:
    type_text = TYPE_ALIASES.get(column.type.strip().lower(), column.type)
    comment = f" COMMENT {quote_text(column.comment)}" if column.comment else ""
    return f"{quote_name(column.name)} {type_text}{comment}"


def qualified(table: str) -> str:
    return ".".join(quote_name(part) for part in table.split("."))


def _properties(properties) -> str:
    return ", ".join(f"{quote_text(k)} = {quote_text(v)}" for k, v in properties.items())


def _create_statement(spark: SparkSession, spec: TableSpec) -> str:
    hive = spark.conf.get("spark.sql.catalogImplementation", "in-memory") == "hive"
    provider, options = format_of(spec.storage, columns_of(spec.columns), hive)
    columns = ", ".join(column_clause(c) for c in (*spec.columns, *spec.partitioned_by))
    clauses = [f"CREATE TABLE {qualified(spec.table)} ({columns}) USING {quote_name(provider)}"]
    if options:
        clauses.append(f"OPTIONS ({_properties(options)})")
    if spec.partitioned_by:
        clauses.append(f"PARTITIONED BY ({', '.join(map(quote_name, spec.partition_names))})")
    cluster = spec.clustered_by
    if cluster and not _descending(cluster):
        clauses.append(f"CLUSTERED BY ({', '.join(map(quote_name, cluster.columns))})")
        if cluster.sorted_by:
            names = ", ".join(quote_name(k.column) for k in cluster.sorted_by)
            clauses.append(f"SORTED BY ({names})")
        clauses.append(f"INTO {cluster.buckets} BUCKETS")
    if spec.location:
        clauses.append(f"LOCATION {quote_text(spec.location)}")
    if spec.comment:
        clauses.append(f"COMMENT {quote_text(spec.comment)}")
    if spec.properties:
        clauses.append(f"TBLPROPERTIES ({_properties(spec.properties)})")
    return " ".join(clauses)


def create_like(
    spark: SparkSession,
    existing: str,
    new: str,
    location: str | None = None,
    if_not_exists: bool = False,
) -> DataFrame:
    """An empty table with the columns, comments, partitioning and format of another."""
    if not table_exists(spark, existing):
        raise NotFound(MISSING_TABLE.format(existing))
    if table_exists(spark, new):
        if if_not_exists:
            return spark.table(new)
        raise AlreadyExists(TABLE_EXISTS.format(new))
    clause = f" LOCATION {quote_text(location)}" if location else ""
    spark.sql(f"CREATE TABLE {qualified(new)} LIKE {qualified(existing)}{clause}")
    return spark.table(new)


def scan_external(
    spark: SparkSession, location: str, schema, fmt: str = "parquet", **options: object
) -> DataFrame:
    """Read an existing directory under a declared schema; nothing is moved or inferred."""
    provider = STORED_AS.get(fmt.lower(), fmt)
    return spark.read.schema(columns_of(schema)).format(provider).options(**options).load(location)


def load_overwrite(
    spark: SparkSession,
    source: DataFrame | str | list[str],
    table: str,
    partition: str | None = None,
) -> None:
    """Replace all rows of a table, or of one partition of it, by ``source``; keep the rest.

    Paths are read in the table's own format. An empty source leaves the target empty.
    """
    if not table_exists(spark, table):
        raise NotFound(MISSING_TABLE.format(table))
    target = spark.table(table)
    values = parse_partition(partition) if partition else {}
    columns = [f for f in target.schema.fields if f.name not in values]
    if isinstance(source, DataFrame):
        rows = source.select(*[quote_name(f.name) for f in columns])
    else:
        facts = describe(spark, table)
        rows = (
            spark.read.format(facts["provider"])
            .options(**facts.get("storage_properties", {}))
            .schema(type(target.schema)(columns))
            .load(check_inputs(spark, source))
        )
    if values:
        clause = f"PARTITION ({partition_clause(values)})"
    else:  # the whole table, also where the session overwrites only partitions with new rows
        clause = "WITH ('partitionOverwriteMode' = 'static')"
        parts = describe(spark, table).get("partition_columns", [])
        rows = rows.hint("rebalance", *parts) if parts else rows
    spark.sql(f"INSERT OVERWRITE TABLE {qualified(table)} {clause} SELECT * FROM {{rows}}", rows=rows)


def describe(spark: SparkSession, table: str, partition: dict[str, str] | None = None) -> dict:
    """Catalog facts about a table or one of its partitions.

    Among them ``provider``, ``location``, ``storage_properties`` and ``partition_columns``.
    """
    clause = f" PARTITION ({partition_clause(partition)})" if partition else ""
    row = spark.sql(f"DESCRIBE TABLE EXTENDED {qualified(table)}{clause} AS JSON").first()
    return json.loads(row.json_metadata)


def partition_clause(values: dict[str, str]) -> str:
    return ", ".join(f"{quote_name(k)}={quote_text(v)}" for k, v in values.items())


def read_evolved(
    spark: SparkSession, path: str | list[str], columns, fmt: str = "parquet"
) -> DataFrame:
    """Files of several generations under the newest columns; older files read null there.

    The declared schema is used as it is, so no file footer is opened to merge schemas.
    """
    return spark.read.schema(columns_of(columns)).format(fmt).load(path)


def add_column(spark: SparkSession, table: str, column: Column) -> DataFrame:
    """Append a data column; rows written before read null. A duplicate name is an error."""
    if not table_exists(spark, table):
        raise NotFound(MISSING_TABLE.format(table))
    if not column.type:
        raise BadParam(MISSING_PARAM.format("column type"))
    try:
        spark.sql(f"ALTER TABLE {qualified(table)} ADD COLUMNS ({column_clause(column)})")
    except AnalysisException as error:
        if (error.getCondition() or "") in ("COLUMN_ALREADY_EXISTS", "FIELD_ALREADY_EXISTS"):
            raise AlreadyExists(COLUMN_EXISTS.format(column.name)) from error
        raise
    return spark.table(table)
