"""Storage words, serdes and handlers as Spark data sources."""

from __future__ import annotations

import warnings

from pyspark.sql import types as T

from lakejobs.errors import BadParam
from lakejobs.sources import delimited
from lakejobs.sources.spec import RowFormat, Storage

# The words accepted after "stored as", with the data source each one means. RCFile and
# SequenceFile exist only with catalog support for them; their columnar successor stands in.
STORED_AS = {
    "textfile": "csv",
    "orc": "orc",
    "parquet": "parquet",
    "avro": "avro",
    "json": "json",
    "jsonfile": "json",
    "csv": "csv",
    "rcfile": "parquet",
    "sequencefile": "parquet",
}

# Well-known serde classes and the data source each one means.
SERDES = {
    "org.apache.hadoop.hive.ql.io.orc.OrcSerde": "orc",
    "org.apache.hadoop.hive.ql.io.parquet.serde.ParquetHiveSerDe": "parquet",
    "org.apache.hadoop.hive.serde2.avro.AvroSerDe": "avro",
    "org.apache.hadoop.hive.serde2.JsonSerDe": "json",
    "org.apache.hadoop.hive.serde2.OpenCSVSerde": "csv",
    "org.apache.hadoop.hive.serde2.lazy.LazySimpleSerDe": "csv",
}


# Words that mean something else without such a catalog; this is said by a warning.
WITHOUT_CATALOG = ("rcfile", "sequencefile")
# Words kept as they are where the catalog knows these formats.
CATALOG_WORDS = ("rcfile", "sequencefile", "textfile")


def format_of(
    storage: Storage, schema: T.StructType | None = None, hive: bool = False
) -> tuple[str, dict[str, str]]:
    """The data source and its options for a declared storage; parquet where nothing is declared.

    A storage handler or an unknown serde is taken as a data source name with its properties as
    options. Delimited text becomes the csv source without quoting, which holds flat columns only;
    nested ones go through ``write_delimited`` and ``scan_delimited``. With a Hive catalog
    (``hive``) old formats, serdes and all four separators are handed to it instead.
    """
    row, word = storage.row_format, (storage.stored_as or "").lower()
    if word and word not in STORED_AS:
        raise BadParam(f"Unknown storage format {storage.stored_as}")
    if storage.stored_by:
        return storage.stored_by, dict(storage.properties)
    text = word == "textfile" or (not word and row is not None and row.delimited)
    if hive and (text or word in CATALOG_WORDS or (row and row.serde)):
        return "hive", _catalog_options(word or "textfile", row)
    if word in WITHOUT_CATALOG:
        warnings.warn(f"stored as {word} needs a Hive catalog; the table is kept as {STORED_AS[word]}", stacklevel=2)
    if word and not text:
        return STORED_AS[word], dict(row.serde_properties) if row and row.serde else {}
    if row and row.serde:
        return SERDES.get(row.serde, row.serde), dict(row.serde_properties)
    if not text:
        return "parquet", {}
    nested = [f.name for f in (schema or []) if _is_nested(f.dataType)]
    if nested:
        raise BadParam(f"delimited text tables hold flat columns only: {', '.join(nested)}")
    return "csv", {
        "sep": (row and row.fields) or delimited.FIELDS,
        "lineSep": (row and row.lines) or delimited.LINES,
        "nullValue": delimited.NULL_TOKEN,
        "emptyValue": "",
        "quote": "",
    }


def _catalog_options(word: str, row: RowFormat | None) -> dict[str, str]:
    options = {"fileFormat": word}
    if row is None:
        return options
    if row.serde:
        return {**options, "serde": row.serde, **row.serde_properties}
    if word != "textfile":  # separators mean nothing to a binary format
        return options
    separators = {
        "fieldDelim": row.fields,
        "collectionDelim": row.items,
        "mapkeyDelim": row.map_keys,
        "lineDelim": row.lines,
    }
    return {**options, **{name: value for name, value in separators.items() if value}}


def _is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
