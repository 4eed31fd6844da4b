"""Response documents: JSON objects held as text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakejobs.errors import MISSING_TABLE

# Status codes of a response document.
OK = 200
SERVER_ERROR = 500
MISSING = 404

# Top-level keys are opened, values stay as they are: numbers, nulls and nested parts keep their type.
_TOP_LEVEL = "map<string,variant>"


def _text_of(doc: Column) -> Column:
    return F.when(doc == "", "{}").otherwise(F.coalesce(doc, F.lit("{}")))


def _opened(doc: Column) -> Column:
    return F.from_json(_text_of(doc), _TOP_LEVEL)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _quoted(value: Column) -> Column:
    """``value`` as JSON."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


# What a parsed value may write otherwise than it stands: numbers that are no short whole ones, and the order of several
# keys of an inner object. Texts that only look like it do no harm.
_NOT_PLAIN = r"[0-9][.eE]|-0|[0-9]{19}|[\[:,]\s*\{[^{}]*[,{]"


def _as_json(raw: Column, value: Column) -> Column:
    """A parsed value as JSON: numbers as they stand in ``raw``, where only texts have lost their quotes."""
    kind, plain = F.schema_of_variant(value), F.to_json(value)
    # Fractions of more digits than a double has are exact in the variant only.
    long_fraction = kind.startswith("DECIMAL") & (F.length(plain) > 16) & plain.contains(".")
    return F.when((kind == "STRING") | raw.isNull() | long_fraction, plain).otherwise(raw)


def annotate_json(
    doc: Column | str, put: dict[str, Column] | None = None, remove: Sequence[str] = ()
) -> Column:
    """Set and remove top-level keys of a JSON object.

    A key that exists is overwritten; a null value leaves the object as it was; null or empty text
    counts as ``{}``. Other keys keep their values: whole numbers of any length digit by digit,
    fractions up to 38 digits; numbers with an exponent are written as doubles. Text that is not an
    object gives null.
    """
    doc = F.col(doc) if isinstance(doc, str) else doc
    put = put or {}
    parsed = F.map_entries(_opened(doc))
    plain = F.transform(parsed, lambda v: F.struct(v["key"].alias("key"), F.to_json(v["value"]).alias("value")))
    # Only documents that need it are parsed a second time.
    raw = F.map_entries(F.from_json(_text_of(doc), "map<string,string>"))
    exact = F.zip_with(
        raw, parsed, lambda r, v: F.struct(r["key"].alias("key"), _as_json(r["value"], v["value"]).alias("value"))
    )
    entries = F.when(_text_of(doc).rlike(_NOT_PLAIN), exact).otherwise(plain)
    return _once(entries, lambda e: _object(_changed(e, put, remove)))


def _object(entries: Column) -> Column:
    fields = F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def _changed(entries: Column, put: dict[str, Column], remove: Sequence[str]) -> Column:
    # Of a key that occurs twice the last one counts.
    keys = F.transform(entries, lambda e: e["key"])
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]
        ),
    )
    kept = F.when(repeated, last).otherwise(entries)
    if put or remove:
        kept = F.filter(kept, lambda e: ~_replaced(e["key"], put, remove))
    for name, value in put.items():
        entry = F.struct(F.lit(name).alias("key"), _quoted(value).alias("value"))
        none = F.array().cast("array<struct<key:string,value:string>>")
        kept = F.concat(kept, F.when(value.isNotNull(), F.array(entry)).otherwise(none))
    return kept


def _replaced(key: Column, put: dict[str, Column], remove: Sequence[str]) -> Column:
    gone = key.isin(*remove) if remove else F.lit(False)
    for name, value in put.items():
        gone = gone | ((key == name) & value.isNotNull())
    return gone


def response_status(doc: Column | str) -> Column:
    """The status of a response document.

    200, or 500 if the key ``error`` is there, even as null; an ``errorCode`` that is an integer, as
    a number or as text, overrides both. Text that is not a JSON object is a 500.
    """
    doc = F.col(doc) if isinstance(doc, str) else doc
    return _once(_opened(doc), _status)


def _status(opened: Column) -> Column:
    given = F.to_json(F.map_filter(opened, lambda k, _: k == "errorCode"))
    # Whole numbers, also in quotes; of a number with a fraction the whole part.
    whole = F.regexp_extract(given, r':(?:"?([+-]?\d+)"?|(?:-?\d+)\.\d+)\}\z', 1).try_cast("int")
    part = F.regexp_extract(given, r":(-?\d+)\.\d+\}\z", 1).try_cast("int")
    plain = F.when(F.map_contains_key(opened, "error"), SERVER_ERROR).otherwise(OK)
    named = F.when(F.map_contains_key(opened, "errorCode"), F.coalesce(whole, part))
    return F.when(opened.isNull(), SERVER_ERROR).otherwise(F.coalesce(named, plain))


def first_entry(doc: Column | str, field: str, name: Column | str) -> Column:
    """The first element of an array field of each document, as JSON (texts with their quotes).

    A document with the key ``error`` passes unchanged; where the array is empty or absent the
    result says that table ``name`` does not exist.
    """
    doc = F.col(doc) if isinstance(doc, str) else doc
    name = F.lit(name) if isinstance(name, str) else name
    keys = F.json_object_keys(_text_of(doc))
    absent = F.to_json(
        F.struct(
            F.replace(F.lit(MISSING_TABLE), F.lit("{}"), name).alias("error"),
            F.lit(MISSING).alias("errorCode"),
        )
    )
    listed = F.try_element_at(F.from_json(_text_of(doc), "map<string,string>"), F.lit(field))
    kind = F.schema_of_variant(F.try_element_at(_opened(doc), F.lit(field)))
    raw, value = (F.get(F.from_json(listed, f"array<{t}>"), F.lit(0)) for t in ("string", "variant"))
    # A null element is as good as none.
    first = F.when(kind.startswith("ARRAY") & raw.isNotNull(), _as_json(raw, value))
    return F.when(F.array_contains(keys, "error"), doc).otherwise(F.coalesce(first, absent))
