"""Output schemas of user functions: fields, tuples, bags and maps as Spark types."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import types as T

from lakejobs.errors import BadParam
from lakejobs.sources.spec import ddl_type

# Type words of the dataflow language that Spark does not know.
WORDS = {
    "long": "bigint", "chararray": "string", "bytearray": "binary", "datetime": "timestamp", "biginteger": "decimal(38,0)", "bigdecimal": "decimal(38,18)",
}
_OPENERS = {"tuple": "(", "bag": "{", "map": "["}
_CLOSERS = {"(": ")", "{": "}", "[": "]"}


def output_fields(schema: str) -> T.StructType:
    """``a:int, t:(b:long, c:chararray), g:{(d:int)}, m:[double]`` as columns; a field without a name is ``val_<n>``."""
    return T.StructType([T.StructField(name or f"val_{i}", _type_of(text)) for i, (name, text) in enumerate(_split(schema.strip(), schema))])


def output_type(schema: str) -> T.DataType:
    """The type of one result: that of the only field, or a struct of several."""
    fields = output_fields(schema)
    if not fields:
        raise BadParam(f"Invalid output schema {schema}")
    return fields[0].dataType if len(fields) == 1 else fields


def _split(text: str, whole: str) -> list[tuple[str | None, str]]:
    """(name or None, type) per field; brackets of all kinds are kept whole."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "({[<") - (c in ")}]>")
        if depth < 0:
            raise BadParam(f"Invalid output schema {whole}")
        if c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    if depth:
        raise BadParam(f"Invalid output schema {whole}")
    parts.append(text[start:])
    if parts == [""]:
        return []
    out = []
    for part in parts:
        match = re.fullmatch(r"\s*(?:(\w+)\s*:)?\s*(.*?)\s*", part, re.DOTALL)
        if not match[2]:
            raise BadParam(f"Invalid output schema {whole}")
        out.append((match[1], match[2]))
    return out


def _type_of(text: str) -> T.DataType:
    word = re.fullmatch(r"(tuple|bag|map)\s*(.+)", text, re.IGNORECASE | re.DOTALL)
    if word and word[2][0] == _OPENERS[word[1].lower()]:
        text = word[2]
    if text[0] in _CLOSERS:
        if text[-1] != _CLOSERS[text[0]]:
            raise BadParam(f"Invalid output schema {text}")
        return {"(": _tuple, "{": _bag, "[": _map}[text[0]](text[1:-1].strip())
    try:
        return ddl_type(WORDS.get(text.lower(), text))
    except ParseException as error:
        raise BadParam(f"Invalid output schema {text}") from error


def _tuple(inner: str) -> T.DataType:
    return output_fields(inner)


def _bag(inner: str) -> T.DataType:
    """A list of tuples; fields without a tuple around them are one."""
    fields = _split(inner, inner)
    if len(fields) == 1:
        kind = _type_of(fields[0][1])
        if isinstance(kind, T.StructType):
            return T.ArrayType(kind)
    return T.ArrayType(output_fields(inner))


def _map(inner: str) -> T.DataType:
    return T.MapType(T.StringType(), _type_of(inner) if inner else T.StringType())
