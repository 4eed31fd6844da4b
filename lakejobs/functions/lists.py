r"""Comma lists in one text value: items are joined by ``,``; ``\`` escapes ``\`` and ``,``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_item(item: Column) -> Column:
    """An item as it stands in a list; a null item is empty."""
    escaped = F.replace(F.replace(item, F.lit("\\"), F.lit("\\\\")), F.lit(","), F.lit("\\,"))
    return F.coalesce(escaped, F.lit(""))


def encode_list(items: Column | str) -> Column:
    """An array of texts as a list; a null array is null, an empty one is empty text."""
    return F.array_join(F.transform(items, escape_item), ",")


def decode_list(text: Column | str) -> Column:
    """The array of items of a list; inverse of :func:`encode_list` but for empty text, taken as no items.

    Each item is found with the comma before it, so an escaped backslash before a comma and
    trailing empty items come out right.
    """
    text = F.col(text) if isinstance(text, str) else text
    items = F.regexp_extract_all(
        F.concat(F.lit(","), text), F.lit(r",((?:\\[\s\S]|[^\\,])*)"), F.lit(1)
    )
    plain = F.transform(items, lambda i: F.regexp_replace(i, r"\\([\s\S])", "$1"))
    return F.when(text == "", F.array().cast("array<string>")).when(text.isNotNull(), plain)
