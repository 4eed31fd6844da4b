"""Row selection and whole-table use of the value and document functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.functions.documents import response_status
from lakejobs.functions.values import identifier_problem, is_set
from lakejobs.session import scratch_path
from lakejobs.sources.spec import quote_name


def drop_unset(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep rows whose listed columns are all set: not null and not empty."""
    tests = [is_set(F.col(quote_name(c)), df.schema[c].dataType) for c in cols]
    return df.where(reduce(lambda a, b: a & b, tests))


def with_identifier_problem(df: DataFrame, col: str, out: str = "problem") -> DataFrame:
    """Add the reason why a value is no DDL identifier, or null for a valid one."""
    return df.withColumn(out, identifier_problem(F.col(quote_name(col))))


def split_valid(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid rows, invalid rows with their ``problem``, and the number of rows per problem.

    ``df`` is read once: the marked rows are written to the shared folder, the three outputs read them there.
    """
    marked, path = with_identifier_problem(df, col), scratch_path(df.sparkSession, "split_valid")
    marked.write.parquet(path)
    marked = df.sparkSession.read.schema(marked.schema).parquet(path)
    valid = marked.where(F.col("problem").isNull()).drop("problem")
    invalid = marked.where(F.col("problem").isNotNull())
    return valid, invalid, marked.groupBy("problem").agg(F.count("*").alias("rows"))


def status_summary(df: DataFrame, col: str) -> DataFrame:
    """Number of response documents per status."""
    status = response_status(F.col(quote_name(col))).alias("status")
    return df.groupBy(status).agg(F.count("*").alias("documents"))
