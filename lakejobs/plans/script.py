"""SQL jobs: the statements of a text or file, in order."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from lakejobs.errors import NO_SCRIPT, BadParam, StatementFailed
from lakejobs.sources.files import file_text

# Parts of a text in which a semicolon does not end a statement: quoted text, names, comments.
_OPAQUE = re.compile(
    r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|(;)""", re.DOTALL
)
_PARAM = re.compile(r"\$(\w+)")


def split_statements(text: str) -> list[str]:
    """The statements of a text, without their semicolons; empty and comment-only ones are dropped."""
    cuts = [m.start() for m in _OPAQUE.finditer(text) if m[1]]
    bounds = zip([0, *[c + 1 for c in cuts]], [*cuts, len(text)])
    statements = [text[a:b].strip() for a, b in bounds]
    comments = re.compile(r"--[^\n]*|/\*.*?\*/", re.DOTALL)
    return [s for s in statements if comments.sub("", s).strip()]


def fill_params(text: str, params: Mapping[str, object]) -> str:
    """Replace each ``$NAME``; a name without a value is an error. ``${...}`` is left to Spark."""

    def value(match: re.Match) -> str:
        if match[1] not in params:
            raise BadParam(f"Undefined parameter {match[1]}")
        return str(params[match[1]])

    return _PARAM.sub(value, text)


def run_sql(
    spark: SparkSession,
    execute: str | None = None,
    file: str | None = None,
    defines: Sequence[str] = (),
    params: Mapping[str, object] | None = None,
    check: bool = False,
) -> DataFrame:
    """Run the statements of ``execute``, or of ``file``, and return the result of the last one.

    ``defines`` are ``NAME=VALUE`` settings that hold while the text runs; they are also variables for
    ``${NAME}``. ``params``, where given, replace ``$NAME`` first. With ``check`` nothing is run:
    every statement is planned only, and the plan of the last one is returned. A failure carries
    its statement.
    """
    if not execute and not file:
        raise BadParam(NO_SCRIPT)
    text = execute or file_text(spark, file)
    settings = {}
    for define in defines:
        name, separator, value = define.partition("=")
        if not separator:
            raise BadParam(f"Invalid define {define}")
        settings[name] = value
    if params is not None:
        text = fill_params(text, params)
    statements = split_statements(text)
    if not statements:
        raise BadParam(NO_SCRIPT)
    before = {name: spark.conf.get(name, None) for name in settings}
    result = None
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        for statement in statements:
            result = _run_one(spark, statement, check)
        result._jdf.queryExecution().executedPlan()  # planned while the settings hold
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return result


def _run_one(spark: SparkSession, statement: str, check: bool) -> DataFrame:
    try:
        result = spark.sql(f"EXPLAIN {statement}" if check else statement)
        # EXPLAIN reports what analysis rejects as text instead of raising.
        plan = result.first()[0] if check else ""
    except Exception as error:
        raise StatementFailed(str(error), statement=statement) from error
    if plan.startswith("Error occurred during query planning"):
        raise StatementFailed(plan, statement=statement)
    return result
