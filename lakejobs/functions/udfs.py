"""User functions from a Python file, declared with an output schema."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import get_type_hints

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.functions.aggregates import UserAggregate, is_aggregate
from lakejobs.functions.output_schema import output_fields, output_type
from lakejobs.sources.files import file_text


def outputSchema(schema: str) -> Callable:  # noqa: N802 - the name user files call
    """Mark a function or class of a user file with the type of its result.

    ``schema`` is ``name:type``; types are words such as ``chararray``, tuples ``(a:int, b:long)``, bags ``{(a:int)}``, maps ``[int]``
    and any Spark type. A class with ``eval`` is a table function whose rows have these fields; one with ``initial``,
    ``intermediate`` and ``final`` is an aggregate, which also needs a ``state_schema`` of the same grammar.
    """
    kind, fields = output_type(schema), output_fields(schema)

    def mark(member: Callable) -> Callable:
        member.output_type, member.output_fields = kind, fields
        return member

    return mark


def _user_function(function: Callable, kind: T.DataType):
    """By its type hints a function of whole pandas series or Arrow arrays, else of single values."""
    modules = {getattr(hint, "__module__", "").split(".")[0] for hint in get_type_hints(function).values()}
    if "pandas" in modules:
        return F.pandas_udf(function, kind)
    if "pyarrow" in modules:
        return F.arrow_udf(function, kind)
    return F.udf(function, kind, useArrow=True)


def _members(spark: SparkSession, module_path: str, namespace: str) -> dict[str, Callable]:
    """The marked members of a user file, which is run here; it may be on the driver or anywhere Spark reads."""
    if os.path.exists(module_path):
        with open(module_path, encoding="utf-8") as source:
            text = source.read()
    else:
        text = file_text(spark, module_path)
    members = {"outputSchema": outputSchema, "__name__": f"user_functions_{namespace}"}
    exec(compile(text, module_path, "exec"), members)  # noqa: S102 - the caller's own program
    return {n: m for n, m in members.items() if callable(m) and getattr(m, "output_type", None) is not None}


def register_udfs(spark: SparkSession, module_path: str, namespace: str) -> dict[str, T.DataType]:
    """Register the marked functions of a Python file as SQL functions ``<namespace>_<name>``.

    The file need not import anything: ``outputSchema`` is defined for it. Functions may take any number of
    arguments, none included, and travel to the executors inside the query; arguments and results
    move in Arrow batches. A function whose type hints are pandas Series or pyarrow Arrays is called
    once per batch. A marked class with ``eval`` becomes a table function: called on values it may give several rows,
    called on ``TABLE(t) PARTITION BY .. ORDER BY ..`` it sees the rows of a partition one after the other and may add some in
    ``terminate``. Aggregates are left to :func:`user_aggregates`. Returns the registered names with their types.
    """
    registered = {}
    for name, member in _members(spark, module_path, namespace).items():
        if is_aggregate(member):
            continue
        sql_name = f"{namespace}_{name}"
        if isinstance(member, type):
            kind = _row_type(member)
            spark.udtf.register(sql_name, F.udtf(member, returnType=kind))
        else:
            kind = member.output_type
            spark.udf.register(sql_name, _user_function(member, kind))
        registered[sql_name] = kind
    return registered


def _row_type(member: type) -> T.StructType:
    """The columns of a table function: the fields of its schema, or those of the bag or tuple that is its only one."""
    kind = member.output_type
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return kind if isinstance(kind, T.StructType) else member.output_fields


def user_aggregates(spark: SparkSession, module_path: str) -> dict[str, UserAggregate]:
    """The aggregates of a Python file by name, for :func:`lakejobs.functions.aggregates.aggregate`."""
    return {n: UserAggregate(n, m) for n, m in _members(spark, module_path, "aggregates").items() if is_aggregate(m)}
