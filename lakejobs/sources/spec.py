"""Declared layout of a table: columns, partitions, buckets, row format and storage.

Column types are free DDL text; Spark parses them. Specs read and write the JSON request form with
its camelCase keys, so a stored table description can be used unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from lakejobs.errors import INVALID_IDENTIFIER, MISSING_PARAM, BadParam

# Type words of the dataflow language beside Spark's own DDL words.
TYPE_ALIASES = {"chararray": "string", "bytearray": "binary"}

IDENTIFIER = re.compile(r"[a-zA-Z]\w*", re.ASCII)


def check_identifier(value: str | None, what: str) -> str:
    """The value, if it is a simple DDL identifier; databases, tables and properties must be."""
    if value is None:
        raise BadParam(MISSING_PARAM.format(what))
    if not IDENTIFIER.fullmatch(value):
        raise BadParam(INVALID_IDENTIFIER.format(what))
    return value


def quote_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ddl_type(type_text: str) -> T.DataType:
    word = type_text.strip()
    return T.DataType.fromDDL(TYPE_ALIASES.get(word.lower(), word))


@dataclass(frozen=True)
class Column:
    """A declared column."""

    name: str
    type: str
    comment: str | None = None

    def struct_field(self) -> T.StructField:
        metadata = {"comment": self.comment} if self.comment else {}
        return T.StructField(self.name, ddl_type(self.type), True, metadata)


@dataclass(frozen=True)
class SortKey:
    column: str
    order: str = "ASC"

    def __post_init__(self) -> None:
        if self.order not in ("ASC", "DESC"):
            raise BadParam(f"Invalid sort order {self.order}")


@dataclass(frozen=True)
class Clustering:
    """Rows hashed on ``columns`` into ``buckets`` buckets, each sorted by ``sorted_by``."""

    columns: tuple[str, ...]
    buckets: int
    sorted_by: tuple[SortKey, ...] = ()


@dataclass(frozen=True)
class RowFormat:
    """Separators of a delimited text table, or a serde with its properties."""

    fields: str | None = None
    items: str | None = None
    map_keys: str | None = None
    lines: str | None = None
    serde: str | None = None
    serde_properties: Mapping[str, str] = field(default_factory=dict)

    @property
    def delimited(self) -> bool:
        return bool(self.fields or self.items or self.map_keys or self.lines)


@dataclass(frozen=True)
class Storage:
    """A ``stored as`` word, or a storage handler with its properties."""

    row_format: RowFormat | None = None
    stored_as: str | None = None
    stored_by: str | None = None
    properties: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class TableSpec:
    """Everything that can be declared about a table. ``table`` may be ``db.table``."""

    table: str
    columns: tuple[Column, ...]
    partitioned_by: tuple[Column, ...] = ()
    clustered_by: Clustering | None = None
    storage: Storage = Storage()
    location: str | None = None
    external: bool = False
    if_not_exists: bool = False
    comment: str | None = None
    properties: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for part in self.table.split("."):
            check_identifier(part, "table")

    @property
    def partition_names(self) -> list[str]:
        return [c.name for c in self.partitioned_by]

    def schema(self) -> T.StructType:
        """Data columns followed by the partition columns, as a reader sees them."""
        return T.StructType([c.struct_field() for c in (*self.columns, *self.partitioned_by)])

    def to_json(self) -> dict:
        """The request form; keys that are not set are left out."""
        storage, row, cluster = self.storage, self.storage.row_format, self.clustered_by
        row_json = row and {
            "fieldsTerminatedBy": row.fields,
            "collectionItemsTerminatedBy": row.items,
            "mapKeysTerminatedBy": row.map_keys,
            "linesTerminatedBy": row.lines,
            "serde": row.serde and {"name": row.serde, "properties": dict(row.serde_properties)},
        }
        format_json = {
            "rowFormat": row_json,
            "storedAs": storage.stored_as,
            "storedBy": storage.stored_by
            and {"className": storage.stored_by, "properties": dict(storage.properties)},
        }
        cluster_json = cluster and {
            "columnNames": list(cluster.columns),
            "sortedBy": [{"columnName": k.column, "order": k.order} for k in cluster.sorted_by],
            "numberOfBuckets": cluster.buckets,
        }
        return _without_unset(
            {
                "table": self.table,
                "external": self.external,
                "ifNotExists": self.if_not_exists,
                "comment": self.comment,
                "columns": [vars(c) for c in self.columns],
                "partitionedBy": [vars(c) for c in self.partitioned_by],
                "clusteredBy": cluster_json,
                "format": format_json,
                "location": self.location,
                "tableProperties": dict(self.properties),
            }
        )

    @classmethod
    def from_json(cls, body: Mapping, table: str | None = None) -> TableSpec:
        """Inverse of :meth:`to_json`; ``table`` is used where the body names none."""
        fmt = body.get("format") or {}
        row = fmt.get("rowFormat")
        serde = (row or {}).get("serde") or {}
        by = fmt.get("storedBy") or {}
        cluster = body.get("clusteredBy")
        return cls(
            table=body.get("table") or table,
            columns=_columns(body.get("columns")),
            partitioned_by=_columns(body.get("partitionedBy")),
            clustered_by=cluster
            and Clustering(
                tuple(cluster["columnNames"]),
                int(cluster["numberOfBuckets"]),
                tuple(
                    SortKey(k["columnName"], k.get("order", "ASC"))
                    for k in cluster.get("sortedBy") or ()
                ),
            ),
            storage=Storage(
                row
                and RowFormat(
                    row.get("fieldsTerminatedBy"),
                    row.get("collectionItemsTerminatedBy"),
                    row.get("mapKeysTerminatedBy"),
                    row.get("linesTerminatedBy"),
                    serde.get("name"),
                    serde.get("properties") or {},
                ),
                fmt.get("storedAs"),
                by.get("className"),
                by.get("properties") or {},
            ),
            location=body.get("location"),
            external=bool(body.get("external", False)),
            if_not_exists=bool(body.get("ifNotExists", False)),
            comment=body.get("comment"),
            properties=body.get("tableProperties") or {},
        )


def _columns(items: Sequence[Mapping] | None) -> tuple[Column, ...]:
    return tuple(Column(c["name"], c["type"], c.get("comment")) for c in items or ())


def _without_unset(value):
    if isinstance(value, dict):
        kept = {k: _without_unset(v) for k, v in value.items()}
        return {k: v for k, v in kept.items() if v not in (None, {}, [], "", False)}
    if isinstance(value, list):
        return [_without_unset(v) for v in value]
    return value


def columns_of(declared: Sequence[Column] | T.StructType | str) -> T.StructType:
    """A schema from columns, a schema or DDL text."""
    if isinstance(declared, T.StructType):
        return declared
    if isinstance(declared, str):
        return T.StructType.fromDDL(declared)
    return T.StructType([c.struct_field() for c in declared])


def parse_partition(spec: str) -> dict[str, str]:
    """``dt='20120101',country='US'`` as an ordered name -> value mapping."""
    text = spec.strip()
    item = r"\s*(\w+)\s*=\s*(?:'([^']*)'|\"([^\"]*)\"|([^\s,'\"]+))\s*"
    if not re.fullmatch(rf"{item}(?:,{item})*", text):
        raise BadParam(f"Invalid partition {spec}")
    return {m[1]: next(g for g in m.groups()[1:] if g is not None) for m in re.finditer(item, text)}


def partition_name(values: Mapping[str, str]) -> str:
    return ",".join(f"{k}='{v}'" for k, v in values.items())


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)
