"""Rows as JSON objects, one per line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_constants(df: DataFrame, **constants: object) -> DataFrame:
    """Add fixed columns, such as ``database`` and ``table``, to every row."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def to_documents(df: DataFrame, column: str = "doc", **constants: object) -> DataFrame:
    """One JSON object per row; nulls are left out."""
    full = with_constants(df, **constants)
    return full.select(F.to_json(F.struct("*")).alias(column))


def write_json_lines(
    df: DataFrame, path: str, mode: str = "errorifexists", **constants: object
) -> None:
    """Write rows as JSON lines with the constants added; nulls are left out."""
    with_constants(df, **constants).write.mode(mode).option("ignoreNullFields", "true").json(path)
