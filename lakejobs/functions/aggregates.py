"""User aggregates in three steps, so that a hot key crosses the network as few partial results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lakejobs.errors import BadParam
from lakejobs.functions.output_schema import output_type
from lakejobs.sources.spec import quote_name

KEYS_AT_ONCE = 50_000  # partial results a task holds before it hands them on
SALTS = 16  # partial results of a key first meet in so many groups


class UserAggregate:
    """A user class with ``initial``, ``intermediate`` and ``final``, and the types of its state and result.

    ``initial(rows)`` makes a state of a list of argument tuples, ``intermediate(states)`` one of several states, ``final(states)``
    the result. States must not depend on how rows are dealt. All three may be called any number of times, but never
    with an empty list.
    """

    def __init__(self, name: str, member: type):
        for step in ("initial", "intermediate", "final"):
            if not callable(getattr(member, step, None)):
                raise BadParam(f"aggregate {name} has no {step}")
        if not hasattr(member, "state_schema"):
            raise BadParam(f"aggregate {name} has no state_schema")
        self.name, self.member = name, member
        self.state_type, self.type = output_type(member.state_schema), member.output_type


def is_aggregate(member: object) -> bool:
    return isinstance(member, type) and hasattr(member, "initial") and hasattr(member, "final")


def aggregate(df: DataFrame, by: Sequence[str], user: UserAggregate, columns: Sequence[str], out: str) -> DataFrame:
    """(by.., out): ``user`` over the values of ``columns`` per group; null keys are a group, no rows give no groups.

    Each task makes a state per key and holds at most :data:`KEYS_AT_ONCE` of them. States of a key meet in a few salted groups
    and then in one, so no group is larger than the number of tasks.
    """
    keys, kinds = list(by), {f.name: f.dataType for f in df.schema}
    if out in keys:
        raise BadParam(f"column {out} is a key")
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(quote_name(k)).alias(n) for k, n in zip(keys, names)], F.struct(*[F.col(quote_name(c)).alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"))
    partial_type = T.StructType([*[T.StructField(n, kinds[k]) for k, n in zip(keys, names)], T.StructField("salt", T.IntegerType()), T.StructField("state", user.state_type)])
    partial = rows.mapInArrow(_first_step(user, names, partial_type), partial_type)
    met = partial.groupBy(*names, "salt").applyInArrow(_later_step(user, names, "intermediate", partial_type), partial_type)
    result_type = T.StructType([*partial_type.fields[:-2], T.StructField("result", user.type)])
    done = met.groupBy(*names).applyInArrow(_later_step(user, names, "final", result_type), result_type)
    return done.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("result").alias(out))


def _plain(value):
    """A state or argument as user code gave it: structs are tuples again."""
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _as_arrow(value, kind: T.DataType):
    """Tuples as structs, by position."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _as_arrow(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)}
    if isinstance(kind, T.ArrayType):
        return [_as_arrow(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return [(k, _as_arrow(v, kind.valueType)) for k, v in value.items()]
    return value


def _first_step(user: UserAggregate, names: list[str], schema: T.StructType):
    arrow, member, state_type = to_arrow_schema(schema), user.member, user.state_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, code = TaskContext.get().partitionId() % SALTS, member()
        held: dict[tuple, object] = {}

        def given() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*held)] if names and held else [[] for _ in names]
            states = [_as_arrow(s, state_type) for s in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, [salt] * len(states), states], arrow)], schema=arrow)

        for batch in batches:
            groups: dict[tuple, list] = {}
            keys = list(zip(*[batch.column(n).to_pylist() for n in names])) if names else [()] * batch.num_rows
            for key, row in zip(keys, batch.column("row").to_pylist()):
                groups.setdefault(key, []).append(_plain(row))
            for key, rows in groups.items():
                state = code.initial(rows)
                held[key] = code.intermediate([held[key], state]) if key in held else state
            if len(held) > KEYS_AT_ONCE:
                yield given()
                held.clear()
        yield given()

    return run


def _later_step(user: UserAggregate, names: list[str], step: str, schema: T.StructType):
    arrow, member, kind = to_arrow_schema(schema), user.member, schema.fields[-1].dataType

    def run(table: pa.Table) -> pa.Table:
        value = getattr(member(), step)([_plain(s) for s in table.column("state").to_pylist()])
        kept = [table.column(n).combine_chunks().slice(0, 1) for n in arrow.names[:-1]]
        return pa.Table.from_arrays([*kept, pa.array([_as_arrow(value, kind)], arrow[-1].type)], schema=arrow)

    return run
