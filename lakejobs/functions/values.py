"""Small column expressions: set values, identifiers, repeatable numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Why a value is no identifier.
MISSING = "Missing"
INVALID = "Invalid DDL identifier"


def is_set(col: Column | str, kind: T.DataType) -> Column:
    """True where a value is neither null nor empty; strings, arrays and maps can be empty."""
    col = F.col(col) if isinstance(col, str) else col
    if isinstance(kind, T.StringType):
        return col.isNotNull() & (col != "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return col.isNotNull() & (F.size(col) > 0)
    return col.isNotNull()


def identifier_problem(col: Column | str) -> Column:
    """Null for a simple DDL identifier (a letter, then ASCII word characters), else the reason."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.isNull(), MISSING).when(
        ~col.rlike(r"\A[a-zA-Z][a-zA-Z0-9_]*\z"), INVALID
    )


def row_rand(seed: Column | str) -> Column:
    """A number in [0, 1) that depends on the row's seed value only.

    Taken from 32 bits of a digest of the seed, so it repeats on any engine and any partitioning.
    """
    digest = F.md5((F.col(seed) if isinstance(seed, str) else seed).cast("string"))
    bits = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return bits / F.lit(4294967296.0)
