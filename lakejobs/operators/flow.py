"""Dataflow steps over positional or named relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.sources.delimited import field
from lakejobs.sources.spec import quote_name


def foreach_generate(df: DataFrame, *fields: Column | int | str, **named: Column | int | str) -> DataFrame:
    """Project every row: positions (``0`` is ``$0``), names or expressions, named by keyword."""
    plain = [_expression(f).alias(f"${f}") if isinstance(f, int) else _expression(f) for f in fields]
    return df.select(*plain, *[_expression(f).alias(name) for name, f in named.items()])


def _expression(value: Column | int | str) -> Column:
    if isinstance(value, int):
        return field(value)
    return F.col(value) if isinstance(value, str) else value


def group_all_count(df: DataFrame, col: str | None = None, out: str = "n") -> DataFrame:
    """Number of rows whose ``col`` (by default the first field) is not null.

    A relation without rows gives no row, not a zero.
    """
    name = quote_name(col or df.columns[0])
    first = F.col(name)
    if col is None and df.schema[0].dataType.typeName() == "array":
        first = F.get(first, F.lit(0))
    both = df.agg(F.count(first).alias(out), F.count("*").alias("_all"))
    return both.where(F.col("_all") > 0).select(out)
