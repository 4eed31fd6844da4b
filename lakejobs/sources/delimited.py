"""Delimited text: four separators, nested arrays and maps, a null token, or no schema at all.

Lines are read as text and taken apart by built-in expressions, so a scan stays inside
whole-stage codegen and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.errors import BadParam
from lakejobs.sources.spec import columns_of

# The usual control-character separators and null marker of such tables.
FIELDS = "\x01"
ITEMS = "\x02"
MAP_KEYS = "\x03"
LINES = "\n"
NULL_TOKEN = "\\N"

_REGEX_CHARS = ".$|()[{^?*+\\"


def literal_pattern(separator: str) -> str:
    """The separator as a pattern for ``split``; one character keeps Java's fast path."""
    if len(separator) == 1:
        return "\\" + separator if separator in _REGEX_CHARS else separator
    return "\\Q" + separator + "\\E"


def _split(text: Column, separator: str) -> Column:
    return F.split(text, literal_pattern(separator), -1)


def scan_delimited(
    spark: SparkSession,
    paths: str | list[str],
    schema,
    fields: str = FIELDS,
    items: str = ITEMS,
    map_keys: str = MAP_KEYS,
    lines: str = LINES,
    null_token: str = NULL_TOKEN,
) -> DataFrame:
    """Read delimited text under a declared schema.

    Missing trailing fields and values that do not cast are null; extra fields are dropped. Columns
    that come from partition directories follow the declared ones.
    """
    raw = spark.read.option("lineSep", lines).text(paths)
    parts = raw.select(_split(F.col("value"), fields).alias("_fields"), *raw.columns[1:])
    reader = _Reader(items, map_keys, null_token)
    declared = columns_of(schema).fields
    return parts.select(
        *[
            reader.value(F.get("_fields", F.lit(i)), f.dataType).alias(f.name, metadata=f.metadata)
            for i, f in enumerate(declared)
        ],
        *raw.columns[1:],
    )


class _Reader:
    def __init__(self, items: str, map_keys: str, null_token: str) -> None:
        self.items, self.map_keys, self.null_token = items, map_keys, null_token

    def value(self, text: Column, kind: T.DataType) -> Column:
        present = F.when(text != self.null_token, text)
        if isinstance(kind, T.ArrayType):
            parts = _split(text, self.items)
            made = F.transform(parts, lambda item: self.atom(item, kind.elementType))
            return F.when(text == "", F.lit([]).cast(kind)).when(text != self.null_token, made)
        if isinstance(kind, T.MapType):
            pairs = F.transform(
                _split(text, self.items), lambda p: F.split(p, literal_pattern(self.map_keys), 2)
            )
            entries = F.transform(
                pairs,
                lambda p: F.struct(
                    self.atom(F.get(p, F.lit(0)), kind.keyType).alias("key"),
                    self.atom(F.get(p, F.lit(1)), kind.valueType).alias("value"),
                ),
            )
            # A key that does not read as its type is left out; of equal keys the last counts.
            known = F.filter(entries, lambda e: e["key"].isNotNull())
            later = lambda i: F.slice(known, i + 2, F.size(known))
            last = F.filter(known, lambda e, i: ~F.exists(later(i), lambda o: o["key"] == e["key"]))
            made = F.map_from_entries(last)
            empty = F.map_from_entries(F.lit([]).cast(_entries(kind)))
            return F.when(text == "", empty).when(text != self.null_token, made)
        if isinstance(kind, T.StructType):
            parts = _split(present, self.items)
            members = [
                self.atom(F.get(parts, F.lit(i)), f.dataType).alias(f.name)
                for i, f in enumerate(kind.fields)
            ]
            return F.when(present.isNotNull(), F.struct(*members))
        return self.atom(text, kind)

    def atom(self, text: Column, kind: T.DataType) -> Column:
        _check_atom(kind)
        present = F.when(text != self.null_token, text)
        if isinstance(kind, T.StringType):
            return present
        if isinstance(kind, T.BinaryType):
            return F.try_to_binary(present, F.lit("base64"))
        return present.try_cast(kind)


def write_delimited(
    df: DataFrame,
    path: str,
    fields: str = FIELDS,
    items: str = ITEMS,
    map_keys: str = MAP_KEYS,
    lines: str = LINES,
    null_token: str = NULL_TOKEN,
    partition_by: tuple[str, ...] = (),
    mode: str = "errorifexists",
    check: bool = True,
) -> None:
    """Write rows as delimited text; the inverse of :func:`scan_delimited`.

    The form has no escapes. With ``check``, a text value that holds a separator or equals the null
    token (or an array of one empty text) fails the write rather than changing the data.
    """
    writer = _Writer(fields, items, map_keys, lines, null_token, check)
    data = [f for f in df.schema.fields if f.name not in partition_by]
    # concat_ws would leave nulls out and shift the fields, so every field is made non-null first.
    line = F.concat_ws(fields, *[writer.value(F.col(_quoted(f.name)), f.dataType) for f in data])
    keep = [F.col(_quoted(name)) for name in partition_by]
    out = df.select(line.alias("value"), *keep)
    if partition_by:
        out = out.hint("rebalance", *partition_by)
    sink = out.write.mode(mode).option("lineSep", lines)
    if partition_by:
        sink = sink.partitionBy(*partition_by)
    sink.text(path)


class _Writer:
    def __init__(self, fields, items, map_keys, lines, null_token, check) -> None:
        self.items, self.map_keys, self.null_token = items, map_keys, null_token
        self.check = check
        self.separators = {"field": [fields, lines], "item": [fields, items, lines]}
        self.separators["pair"] = [fields, items, map_keys, lines]

    def value(self, col: Column, kind: T.DataType) -> Column:
        null = F.lit(self.null_token)
        if isinstance(kind, T.ArrayType):
            parts = F.transform(col, lambda item: self.atom(item, kind.elementType, "item"))
            text = F.array_join(parts, self.items)
            if self.check:
                lone = (F.size(col) == 1) & (text == "")
                text = F.when(lone, _refuse(F.lit("an array of one empty text"))).otherwise(text)
            return F.coalesce(text, null)
        if isinstance(kind, T.MapType):
            pairs = F.transform(
                F.map_entries(col),
                lambda e: F.concat(
                    self.atom(e["key"], kind.keyType, "pair"),
                    F.lit(self.map_keys),
                    self.atom(e["value"], kind.valueType, "pair"),
                ),
            )
            return F.coalesce(F.array_join(pairs, self.items), null)
        if isinstance(kind, T.StructType):
            members = [self.atom(col[f.name], f.dataType, "item") for f in kind.fields]
            return F.when(col.isNull(), null).otherwise(F.concat_ws(self.items, *members))
        return self.atom(col, kind, "field")

    def atom(self, col: Column, kind: T.DataType, level: str) -> Column:
        _check_atom(kind)
        if isinstance(kind, T.BinaryType):
            text = F.base64(col)
        elif isinstance(kind, T.StringType):
            text = self.checked(col, level)
        else:
            text = col.cast("string")
        return F.coalesce(text, F.lit(self.null_token))

    def checked(self, col: Column, level: str) -> Column:
        if not self.check:
            return col
        clash = col == self.null_token
        for separator in self.separators[level]:
            clash = clash | col.contains(separator)
        return F.when(clash, _refuse(col)).otherwise(col)


def _refuse(value: Column) -> Column:
    message = F.concat(F.lit("value cannot be written as delimited text: "), F.left(value, F.lit(80)))
    return F.raise_error(message).cast("string")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _entries(kind: T.MapType) -> T.ArrayType:
    return T.ArrayType(T.StructType().add("key", kind.keyType, False).add("value", kind.valueType))


def _check_atom(kind: T.DataType) -> None:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise BadParam(f"delimited text has no separator for nested type {kind.simpleString()}")


def scan_positional(spark: SparkSession, paths: str | list[str], sep: str = "\t") -> DataFrame:
    """Read text without a schema: one column ``fields``, an array; see :func:`field`."""
    raw = spark.read.text(paths)
    return raw.select(_split(F.col("value"), sep).alias("fields"))


def field(position: int) -> Column:
    """Field ``$position`` of a :func:`scan_positional` relation; null in a row that is too short."""
    return F.get("fields", F.lit(position))
