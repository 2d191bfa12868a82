"""Row predicates with two-valued logic, compiled to columns.

A predicate on a null is False and its negation True, unlike SQL's. Plain leaves already act so at a filter. Negation is
pushed to the leaves, which then keep nulls by an own clause; wrapping in coalesce would lose the pushdown to Parquet.
"""

from __future__ import annotations

import functools
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowfeed.functions.hashing import bucket, split_bounds


#: Tells which rows of a table to keep.
Mask = Callable[[pa.Table], np.ndarray]
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
PLAIN = (*WHOLE, T.FloatType, T.DoubleType, T.StringType, T.BooleanType, T.BinaryType)


@dataclass(frozen=True)
class Bounds:
    """What is known of a column in a row group, as columns of the manifest: least and greatest value, number of nulls; each null if unknown."""

    low: Column
    high: Column
    nulls: Column
    kind: T.DataType


class Predicate(ABC):
    """Subclass for predicates of your own: which fields, and a column that is true for rows to keep."""

    @abstractmethod
    def fields(self) -> set[str]: ...

    @abstractmethod
    def column(self, negated: bool = False) -> Column:
        """True for the rows to keep (negated: to drop); null counts as False."""

    def check(self, names: Iterable[str]) -> None:
        mine = self.fields()
        if not mine:
            raise ValueError("a predicate needs at least one field")
        if unknown := mine - set(names):
            raise ValueError(f"predicate on unknown fields {sorted(unknown)}")

    def filter(self, df: DataFrame) -> DataFrame:
        self.check(df.columns)
        return df.where(self.column())

    def conjuncts(self) -> list[Predicate]:
        """Predicates that all have to hold, together the same as this one."""
        return [self]

    def possible(self, known: Mapping[str, Bounds]) -> Column:
        """Whether a row group may have rows to keep, by the bounds of its columns; true where they don't tell."""
        return F.lit(True)

    def mask(self, kinds: Mapping[str, T.DataType]) -> Mask | None:
        """A function that a task can run on the columns of a row group before it reads others; None if only Spark can tell."""
        return None


def _may(value: Column) -> Column:
    return F.coalesce(value, F.lit(True))


def _fits(kind: T.DataType, value: Any) -> bool:
    """Whether the value is of the column's own kind, so that Python, Arrow and Spark compare alike."""
    if isinstance(kind, WHOLE):
        return isinstance(value, int) and not isinstance(value, bool)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and value == value
    return isinstance(kind, T.StringType) and isinstance(value, str)


def _within(b: Bounds, value: Any) -> Column:
    return _may((b.low <= F.lit(value)) & (b.high >= F.lit(value)))


def _any(columns: Iterable[Column]) -> Column:
    return functools.reduce(Column.__or__, columns, F.lit(False))


def _series(table: pa.Table, names: Sequence[str]) -> list[pd.Series]:
    return [table[n].to_pandas() for n in names]


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


class InSet(Predicate):
    """The field's value is one of the values; null only if None is one of them."""

    def __init__(self, values: Iterable[Any], field: str) -> None:
        values = list(values)
        self.field, self.null, self.values = field, None in values, [v for v in dict.fromkeys(values) if v is not None]

    def fields(self) -> set[str]:
        return {self.field}

    def column(self, negated: bool = False) -> Column:
        c = _col(self.field)
        inside = c.isin(self.values) if self.values else F.lit(False)
        if negated:
            out = ~inside
            return c.isNotNull() & out if self.null else c.isNull() | out
        return c.isNull() | inside if self.null else inside

    def possible(self, known: Mapping[str, Bounds]) -> Column:
        b = known.get(self.field)
        if b is None or not all(_fits(b.kind, v) for v in self.values):
            return F.lit(True)
        inside = _any(_within(b, v) for v in self.values)
        return inside | _may(b.nulls > 0) if self.null else inside

    def mask(self, kinds: Mapping[str, T.DataType]) -> Mask | None:
        kind, values, null, field = kinds[self.field], self.values, self.null, self.field
        if not isinstance(kind, (*WHOLE, T.StringType)) or not all(_fits(kind, v) for v in values):
            return None

        def run(table: pa.Table) -> np.ndarray:
            c = table[field]
            inside = pc.is_in(c, pa.array(values, pa.string() if isinstance(kind, T.StringType) else pa.int64()).cast(c.type, safe=False)) if _castable(values, c.type) else pc.is_in(c.cast(pa.int64()), pa.array(values, pa.int64()))
            return pc.if_else(c.is_null(), null, inside).to_numpy()

        return run


def _castable(values: list, kind: pa.DataType) -> bool:
    """Whether whole numbers lie in the range of the type; texts always do."""
    if not values or isinstance(values[0], str):
        return True
    most = 1 << (kind.bit_width - 1)
    return all(-most <= v < most for v in values)


class InIntersection(Predicate):
    """The list field shares a value with the values. A null list is an error if `strict`, else False."""

    def __init__(self, values: Iterable[Any], field: str, strict: bool = False) -> None:
        self.field, self.values, self.strict = field, list(values), strict

    def fields(self) -> set[str]:
        return {self.field}

    def column(self, negated: bool = False) -> Column:
        c = _col(self.field)
        if self.strict:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"{self.field} is null"))).otherwise(c)
        shared = functools.reduce(Column.__or__, [F.array_contains(c, F.lit(v)) for v in self.values]) if self.values else F.lit(False)
        # array_contains is null for a null array, and if not found beside nulls in it.
        return F.coalesce(~shared, F.lit(True)) if negated else shared


class InLambda(Predicate):
    """Any function of the fields. One that takes and returns columns keeps the pushdown; `python=True` runs one on values, in batches."""

    def __init__(self, fields: Sequence[str], func: Callable[..., Any], state: Any = None, python: bool = False) -> None:
        if not isinstance(fields, (list, tuple)):
            raise ValueError("fields must be a list")
        self.names, self.func, self.state, self.python = list(fields), func, state, python

    def fields(self) -> set[str]:
        return set(self.names)

    def column(self, negated: bool = False) -> Column:
        more = () if self.state is None else (self.state,)
        if not self.python:
            c = self.func(*[_col(n) for n in self.names], *more)
        else:
            func = self.func

            def run(*series):  # noqa: ANN002, ANN202
                rows = zip(*(s.astype(object).where(s.notna(), None) for s in series), strict=True)
                return pd.Series([bool(func(*r, *more)) for r in rows])

            c = _series_udf(run, len(self.names))(*[_col(n) for n in self.names])
        return ~F.coalesce(c, F.lit(False)) if negated else c

    def mask(self, kinds: Mapping[str, T.DataType]) -> Mask | None:
        if not self.python or not all(isinstance(kinds[n], PLAIN) for n in self.names):
            return None
        names, func, more = self.names, self.func, () if self.state is None else (self.state,)

        def run(table: pa.Table) -> np.ndarray:
            rows = zip(*(s.astype(object).where(s.notna(), None) for s in _series(table, names)), strict=True)
            return np.array([bool(func(*r, *more)) for r in rows], dtype=bool)

        return run


class InVector(Predicate):
    """A function of a pandas frame of the fields that returns a boolean series."""

    def __init__(self, fields: Sequence[str], func: Callable[[pd.DataFrame], pd.Series]) -> None:
        self.names, self.func = list(fields), func

    def fields(self) -> set[str]:
        return set(self.names)

    def column(self, negated: bool = False) -> Column:
        names, func = self.names, self.func

        def run(*series):  # noqa: ANN002, ANN202
            return func(pd.DataFrame(dict(zip(names, series, strict=True)))).astype(bool)

        c = _series_udf(run, len(names))(*[_col(n) for n in names])
        return ~c if negated else c

    def mask(self, kinds: Mapping[str, T.DataType]) -> Mask | None:
        names, func = self.names, self.func
        if not all(isinstance(kinds[n], PLAIN) for n in names):
            return None
        return lambda table: func(pd.DataFrame(dict(zip(names, _series(table, names), strict=True)))).astype(bool).to_numpy()


def _series_udf(run: Callable[..., pd.Series], n: int) -> Callable[..., Column]:
    """A vectorised boolean function of n columns; pandas_udf reads the number and kinds of arguments from the signature."""
    import inspect

    parameters = [inspect.Parameter(f"c{i}", inspect.Parameter.POSITIONAL_ONLY, annotation=pd.Series) for i in range(n)]

    def call(*series):  # noqa: ANN002, ANN202
        return run(*series)

    call.__signature__ = inspect.Signature(parameters, return_annotation=pd.Series)
    call.__annotations__ = {p.name: pd.Series for p in parameters} | {"return": pd.Series}
    return F.pandas_udf(call, "boolean")


class Negate(Predicate):
    """Two-valued not: keeps rows whose inner predicate is False on a null."""

    def __init__(self, inner: Predicate) -> None:
        self.inner = inner

    def fields(self) -> set[str]:
        return self.inner.fields()

    def column(self, negated: bool = False) -> Column:
        return self.inner.column(not negated)

    def mask(self, kinds: Mapping[str, T.DataType]) -> Mask | None:
        inner = self.inner.mask(kinds)
        return None if inner is None else lambda table: ~inner(table)


class Reduce(Predicate):
    """All, any, or a function of a list of booleans over several predicates; every one is evaluated for a function."""

    def __init__(self, predicates: Sequence[Predicate], reduce: Callable[[list[bool]], bool] = all) -> None:
        self.predicates, self.reduce = list(predicates), reduce

    def fields(self) -> set[str]:
        return set().union(*(p.fields() for p in self.predicates))

    def column(self, negated: bool = False) -> Column:
        if self.reduce in (all, any):
            op = Column.__and__ if (self.reduce is all) != negated else Column.__or__
            return functools.reduce(op, [p.column(negated) for p in self.predicates])
        func = self.reduce
        flags = [F.coalesce(p.column(), F.lit(False)) for p in self.predicates]
        c = _series_udf(lambda *s: pd.Series([bool(func([bool(x) for x in r])) for r in zip(*s, strict=True)]), len(flags))(*flags)
        return ~c if negated else c

    def conjuncts(self) -> list[Predicate]:
        return [c for p in self.predicates for c in p.conjuncts()] if self.reduce is all and self.predicates else [self]

    def possible(self, known: Mapping[str, Bounds]) -> Column:
        if self.reduce is any and self.predicates:
            return _any(p.possible(known) for p in self.predicates)
        return functools.reduce(Column.__and__, [p.possible(known) for p in self.predicates]) if self.reduce is all and self.predicates else F.lit(True)

    def mask(self, kinds: Mapping[str, T.DataType]) -> Mask | None:
        inner, func = [p.mask(kinds) for p in self.predicates], self.reduce
        if not inner or any(m is None for m in inner):
            return None
        if func in (all, any):
            join = np.logical_and if func is all else np.logical_or
            return lambda table: join.reduce([m(table) for m in inner])
        return lambda table: np.array([bool(func([bool(x) for x in r])) for r in zip(*(m(table) for m in inner), strict=True)], dtype=bool)


class Split(Predicate):
    """One of several disjoint parts of the rows, by the hash of a field; stable, without a seed."""

    def __init__(self, fractions: Sequence[float], index: int, field: str) -> None:
        self.fractions, self.index, self.field = list(fractions), index, field
        self.bounds = split_bounds(self.fractions, index)

    def fields(self) -> set[str]:
        return {self.field}

    def column(self, negated: bool = False) -> Column:
        low, high = (F.lit(str(b)).cast("decimal(20,0)") for b in self.bounds)
        b = bucket(_col(self.field))
        return (b < low) | (b >= high) if negated else (b >= low) & (b < high)


OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(list(v)), "not in": lambda c, v: ~c.isin(list(v)),
}


def dnf(filters: Sequence[Any] | None) -> Column:
    """(column, operator, value) clauses: a list is their conjunction, a list of lists the disjunction of conjunctions."""
    if not filters:
        return F.lit(True)
    groups = [filters] if isinstance(filters[0], tuple) else filters
    return functools.reduce(Column.__or__, [functools.reduce(Column.__and__, [OPERATORS[op](_col(name), value) for name, op, value in g]) for g in groups])


#: Of a clause, whether rows may fit. NaN is greater than any number, and bounds leave it out.
POSSIBLE: dict[str, Callable[[Bounds, Any], Column]] = {
    "<": lambda b, v: b.low < F.lit(v), "<=": lambda b, v: b.low <= F.lit(v), ">": lambda b, v: b.high > F.lit(v), ">=": lambda b, v: b.high >= F.lit(v),
    "=": _within, "==": _within, "!=": lambda b, v: (b.low != F.lit(v)) | (b.high != F.lit(v)), "in": lambda b, v: _any(_within(b, x) for x in v),
}


def dnf_possible(filters: Sequence[Any] | None, known: Mapping[str, Bounds]) -> Column:
    """Whether a row group may have rows that `dnf` keeps."""
    if not filters:
        return F.lit(True)

    def clause(name: str, op: str, value: Any) -> Column:
        b = known.get(name)
        values = list(value) if op in ("in", "not in") else [value]
        if b is None or op not in POSSIBLE or not all(_fits(b.kind, v) for v in values) or op in (">", ">=", "!=") and isinstance(b.kind, (T.FloatType, T.DoubleType)):
            return F.lit(True)
        return _may(POSSIBLE[op](b, value))

    groups = [filters] if isinstance(filters[0], tuple) else filters
    return _any(functools.reduce(Column.__and__, [clause(*c) for c in g], F.lit(True)) for g in groups)


#: Of a clause, which rows fit; a null fits none.
COMPARED: dict[str, Callable[[pa.ChunkedArray, Any], pa.ChunkedArray]] = {
    "=": pc.equal, "==": pc.equal, "!=": pc.not_equal, "<": pc.less, "<=": pc.less_equal, ">": pc.greater, ">=": pc.greater_equal,
    "in": lambda c, v: pc.is_in(c, pa.array(v, c.type)), "not in": lambda c, v: pc.invert(pc.is_in(c, pa.array(v, c.type))),
}


def dnf_mask(filters: Sequence[Any], kinds: Mapping[str, T.DataType]) -> Mask | None:
    """`dnf` for a task or a process of one's own; None where a value isn't of its column's kind, or a column may have NaN."""
    groups = [filters] if isinstance(filters[0], tuple) else filters
    for name, op, value in (c for g in groups for c in g):
        if not isinstance(kinds[name], (*WHOLE, T.StringType)) or not all(_fits(kinds[name], v) for v in (list(value) if op in ("in", "not in") else [value])):
            return None

    def clause(table: pa.Table, name: str, op: str, value: Any) -> np.ndarray:
        c = table[name]
        c = c if isinstance(kinds[name], T.StringType) else c.cast(pa.int64())
        return pc.if_else(c.is_null(), False, COMPARED[op](c, list(value) if op in ("in", "not in") else value)).to_numpy()

    return lambda table: np.logical_or.reduce([np.logical_and.reduce([clause(table, *c) for c in g]) for g in groups])


def not_null(names: Iterable[str]) -> Column:
    return functools.reduce(Column.__and__, [_col(n).isNotNull() for n in names], F.lit(True))
