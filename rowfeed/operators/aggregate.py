"""Aggregates of one's own that merge: states are made where the rows are, and only states are shuffled.

A task keeps a state for each key it meets and gives them out when its rows end, or when there are MOST_STATES of them; the shuffle brings the
states of a key together, in order of keys, and a task merges them as a stream. So a group of any size is spread over all tasks, and what meets in one
task of it is a state for each task before.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowfeed.session import share_code

#: States that a task keeps before the shuffle.
MOST_STATES = 50_000


class Aggregate(ABC):
    """Subclass with the state's fields (a DDL string) and the result's type; a state is a tuple of these fields."""

    state: str
    result: str

    @abstractmethod
    def zero(self) -> tuple: ...

    @abstractmethod
    def update(self, state: tuple, *columns: pd.Series) -> tuple:
        """The state with some rows of the group."""

    @abstractmethod
    def merge(self, a: tuple, b: tuple) -> tuple:
        """Of two states one, in whatever order they come."""

    @abstractmethod
    def finish(self, state: tuple) -> Any: ...


class RootMeanSquare(Aggregate):
    """The square root of the mean of squares; null values don't count, and without any other the result is null."""

    state, result = "n bigint, total double", "double"

    def zero(self) -> tuple:
        return 0, 0.0

    def update(self, state: tuple, values: pd.Series) -> tuple:
        known = values.dropna()
        return state[0] + len(known), state[1] + float((known * known).sum())

    def merge(self, a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], a[1] + b[1]

    def finish(self, state: tuple) -> float | None:
        return (state[1] / state[0]) ** 0.5 if state[0] else None


def _key(values: Sequence[Any]) -> tuple:
    """A key to look up: NaN is equal to itself."""
    return tuple("NaN" if isinstance(v, float) and v != v else v for v in values)


def aggregate(df: DataFrame, keys: Sequence[str], columns: Mapping[str, tuple[Aggregate, Sequence[str]]], most_states: int = MOST_STATES) -> DataFrame:
    """The keys and a column for each (aggregate, its columns). Null keys are a group; without keys all rows are one, if there are any."""
    names = list(columns)
    inputs = list(dict.fromkeys(c for _, fields in columns.values() for c in fields))
    key_names = [f"k{i}" for i in range(len(keys))]
    key_fields = [T.StructField(k, df.schema[n].dataType) for k, n in zip(key_names, keys, strict=True)]
    parsed = [T._parse_datatype_string(columns[n][0].state) for n in names]
    state_fields = [T.StructField(f"s{i}", kind) for i, kind in enumerate(parsed)]
    kinds = to_arrow_schema(T.StructType([*key_fields, *state_fields]))
    used = [(a, [inputs.index(c) for c in fields]) for a, fields in columns.values()]

    def rows(states: Mapping[tuple, tuple[tuple, list]]) -> pa.RecordBatch:
        out = [pa.array([k[i] for k, _ in states.values()], kinds.field(i).type) for i in range(len(key_names))]
        for j, kind in enumerate(parsed):
            made = [dict(zip(kind.names, s[j], strict=True)) for _, s in states.values()]
            out.append(pa.array(made, kinds.field(len(key_names) + j).type))
        return pa.RecordBatch.from_arrays(out, schema=kinds)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, tuple[tuple, list]] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = [batch.column(len(key_names) + i).to_pandas() for i in range(len(inputs))]
            found = [batch.column(i).to_pylist() for i in range(len(key_names))]
            codes, first = {}, []
            group = pd.Series([codes.setdefault(_key(k), len(codes)) for k in zip(*found, strict=True)] if found else [codes.setdefault((), 0)] * batch.num_rows)
            for at in group.groupby(group).indices.values():
                first.append(at)
            for key, at in zip(codes, first, strict=True):
                real, state = states.get(key) or (tuple(c[at[0]] for c in found), [a.zero() for a, _ in used])
                states[key] = real, [a.update(s, *(values[i].iloc[at] for i in which)) for s, (a, which) in zip(state, used, strict=True)]
            if len(states) >= most_states:
                yield rows(states)
                states = {}
        if states:
            yield rows(states)

    out_fields = [T.StructField(n, df.schema[n].dataType) for n in keys] + [T.StructField(n, T._parse_datatype_string(columns[n][0].result)) for n in names]
    out_kinds = to_arrow_schema(T.StructType(out_fields))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, real, state, done = None, None, None, []

        def batch_of(done: list[tuple[tuple, list]]) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, _ in done], out_kinds.field(i).type) for i in range(len(keys))]
            columns += [pa.array([a.finish(s[j]) for _, s in done], out_kinds.field(len(keys) + j).type) for j, (a, _) in enumerate(used)]
            return pa.RecordBatch.from_arrays(columns, schema=out_kinds)

        for batch in batches:
            found = [c.to_pylist() for c in batch.columns]
            for i in range(batch.num_rows):
                values = tuple(c[i] for c in found[: len(keys)])
                more = [tuple(c[i].values()) for c in found[len(keys) :]]
                if state is not None and _key(values) == now:
                    state = [a.merge(x, y) for (a, _), x, y in zip(used, state, more, strict=True)]
                    continue
                if state is not None:
                    done.append((real, state))
                now, real, state = _key(values), values, more
            if len(done) >= 10_000:
                yield batch_of(done)
                done = []
        if state is not None:
            yield batch_of([*done, (real, state)])

    share_code(df.sparkSession)
    rows_in = df.select(*[F.col(f"`{n}`").alias(k) for n, k in zip(keys, key_names, strict=True)], *[F.col(f"`{n}`").alias(f"v{i}") for i, n in enumerate(inputs)])
    states = rows_in.mapInArrow(partial, T.StructType([*key_fields, *state_fields]))
    laid = states.repartition(*key_names) if keys else states.repartition(1)  # without keys, a state for each task
    return (laid.sortWithinPartitions(*key_names) if keys else laid).mapInArrow(merged, T.StructType(out_fields))
