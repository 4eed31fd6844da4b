"""Row counts and bounds from file footers: an aggregate that the scan answers without reading a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.errors import BadParam
from lakejobs.operators.partitions import partition_columns
from lakejobs.sources.spec import quote_name
from lakejobs.sources.tables import describe

# Settings under which an aggregate reaches the footers.
_SETTINGS = {
    "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,text",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.orc.aggregatePushdown": "true",
}
_BOUNDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.BooleanType)


def footer_stats(spark: SparkSession, table: str, columns: Sequence[str] = ()) -> DataFrame:
    """(partition columns.., rows, and per column ``<c>_nulls``, ``<c>_min``, ``<c>_max``) of a Parquet or ORC table.

    Below the table's own folder nothing but footers is read. Files of partitions that lie elsewhere are
    counted by a scan of theirs. Bounds exist for whole and floating numbers, dates and booleans; a
    table without partitions gives one row. The result belongs to a session of its own, which asks the scan to answer.
    """
    keys, facts = partition_columns(spark, table), describe(spark, table)
    full = spark.table(table)
    for c in columns:
        if not isinstance(full.schema[c].dataType, _BOUNDED):
            raise BadParam(f"no bounds of column {c} in a footer")
    source = {"parquet": "parquet", "orc": "orc"}.get(str(facts.get("provider", "parquet")).lower())
    if source is None:
        raise BadParam(f"no footers in a table of {facts.get('provider')}")
    asking = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        asking.conf.set(name, spark.conf.get(name))
    for name, value in _SETTINGS.items():
        asking.conf.set(name, value)
    root = facts["location"].rstrip("/")
    inside = _counted(asking.read.schema(full.schema).format(source).load(root), keys, columns)
    path = F.regexp_replace("_metadata.file_path", r"^(\w+):/+", "$1:/")
    # A filter on the file's name: files below the root are not opened.
    elsewhere = full.where(~path.startswith(_one_slash(root) + "/"))
    if not any(not _one_slash(f).startswith(_one_slash(root) + "/") for f in full.inputFiles()):
        return _named(inside, columns)
    other = _counted(elsewhere, keys, columns).toArrow()  # one row per partition that lies elsewhere
    return _named(_summed(inside.unionByName(asking.createDataFrame(other, inside.schema)), keys, columns), columns)


def _one_slash(uri: str) -> str:
    head, _, rest = uri.partition(":/")
    return f"{head}:/{rest.lstrip('/')}" if rest else uri


def _counted(df: DataFrame, keys: list[str], columns: Sequence[str]) -> DataFrame:
    facts = [F.count("*").alias("rows")]
    for i, name in enumerate(columns):
        c = F.col(quote_name(name))
        facts += [F.count(c).alias(f"_held{i}"), F.min(c).alias(f"_min{i}"), F.max(c).alias(f"_max{i}")]
    return df.groupBy(*map(quote_name, keys)).agg(*facts)


def _summed(counted: DataFrame, keys: list[str], columns: Sequence[str]) -> DataFrame:
    facts = [F.sum("rows").alias("rows")]
    for i in range(len(columns)):
        facts += [F.sum(f"_held{i}").alias(f"_held{i}"), F.min(f"_min{i}").alias(f"_min{i}"), F.max(f"_max{i}").alias(f"_max{i}")]
    return counted.groupBy(*map(quote_name, keys)).agg(*facts)


def _named(counted: DataFrame, columns: Sequence[str]) -> DataFrame:
    keys = [c for c in counted.columns if c != "rows" and not c.startswith(("_held", "_min", "_max"))]
    facts = [F.col("rows")]
    for i, name in enumerate(columns):
        facts += [(F.col("rows") - F.col(f"_held{i}")).alias(f"{name}_nulls"), F.col(f"_min{i}").alias(f"{name}_min"), F.col(f"_max{i}").alias(f"{name}_max")]
    return counted.select(*map(quote_name, keys), *facts)
