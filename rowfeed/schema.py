"""Declared schemas: fields with a numpy type, a tensor shape, a codec and nullability, kept in Spark column metadata.

The metadata survives Parquet, so a dataset carries its schema without pickles. A variable dimension is None in Python
and -1 in metadata (Spark's metadata arrays hold no nulls). Parquet reads come back nullable, so nullability is kept here too.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from rowfeed.functions.codecs import Codec, codec_of, default_codec

META = "rowfeed"
#: numpy scalar type -> Spark type (fixed values). Unsigned types go to the next larger signed one.
SPARK_TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "uint8": T.ShortType(), "int16": T.ShortType(), "uint16": T.IntegerType(), "int32": T.IntegerType(), "uint32": T.LongType(),
    "int64": T.LongType(), "uint64": T.DecimalType(20, 0), "float32": T.FloatType(), "float64": T.DoubleType(), "str": T.StringType(), "bytes": T.BinaryType(), "datetime64": T.TimestampType(),
}


def type_name(kind: Any) -> str:
    """One name for a numpy type, a Python type or a name."""
    if kind in (Decimal, "decimal"):
        return "decimal"
    if isinstance(kind, str) and kind in SPARK_TYPES:
        return kind
    name = np.dtype(kind)
    if name.kind in "US":
        return "str" if name.kind == "U" else "bytes"
    return "datetime64" if name.kind == "M" else name.name


@dataclass(frozen=True)
class Field:
    """A column. shape () is a scalar; None in a shape is a dimension of any size. Equality ignores the codec."""

    name: str
    dtype: Any
    shape: tuple[int | None, ...] = ()
    codec: Codec | None = field(default=None, compare=False)
    nullable: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "dtype", type_name(self.dtype))
        object.__setattr__(self, "shape", tuple(self.shape))

    @property
    def encoding(self) -> Codec:
        return self.codec or default_codec(self.dtype, self.shape)

    def spark(self) -> T.StructField:
        meta = {"dtype": self.dtype, "shape": [-1 if d is None else d for d in self.shape], "codec": self.encoding.name(), "nullable": self.nullable}
        kind = self.encoding.spark_type() or SPARK_TYPES.get(self.dtype)
        if kind is None:
            raise ValueError(f"{self.name}: {self.dtype} has no Spark type without a codec")
        return T.StructField(self.name, kind, True, {META: json.dumps(meta)})

    @classmethod
    def of(cls, f: T.StructField) -> Field | None:
        """From Spark's field: as declared in its metadata, else inferred; None for types without a numpy counterpart."""
        if META in (f.metadata or {}):
            m = json.loads(f.metadata[META])
            return cls(f.name, m["dtype"], tuple(None if d < 0 else d for d in m["shape"]), codec_of(m["codec"]), m["nullable"])
        kind, shape = f.dataType, ()
        if isinstance(kind, T.ArrayType):
            kind, shape = kind.elementType, (None,)
        names = {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64", T.BooleanType: "bool", T.StringType: "str", T.BinaryType: "bytes", T.DateType: "datetime64", T.TimestampType: "datetime64", T.TimestampNTZType: "datetime64", T.DecimalType: "decimal"}
        name = names.get(type(kind))
        return None if name is None else cls(f.name, name, shape, default_codec(name, shape, kind), f.nullable)


class Schema:
    """Fields in order, also as attributes."""

    def __init__(self, name: str, fields: Iterable[Field]) -> None:
        self.name = name
        self.fields = {f.name: f for f in fields}
        for n, f in self.fields.items():
            if hasattr(type(self), n) or n in ("name", "fields"):
                warnings.warn(f"field {n} can't be read as an attribute", stacklevel=2)
            else:
                setattr(self, n, f)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and list(self.fields.values()) == list(other.fields.values())

    def __hash__(self) -> int:
        return hash(tuple(self.fields.values()))

    def __repr__(self) -> str:
        rows = "".join(f"  {f.name}: {f.dtype} {f.shape} {f.encoding.name()}{' nullable' if f.nullable else ''}\n" for f in self.fields.values())
        return f"Schema {self.name}\n{rows}"

    def view(self, fields: Iterable[Field | str]) -> Schema:
        """The named fields, or those whose whole name matches a pattern, in this schema's order."""
        chosen = set()
        for f in fields:
            name = f.name if isinstance(f, Field) else f
            if isinstance(f, Field) and self.fields.get(name) != f:
                raise ValueError(f"field {name} is not in schema {self.name}")
            found = [name] if name in self.fields else [] if isinstance(f, Field) else match_names([name], self.fields)
            chosen |= set(found)
        return Schema(f"{self.name}_view", [f for n, f in self.fields.items() if n in chosen])

    def struct(self) -> T.StructType:
        return T.StructType([f.spark() for f in self.fields.values()])

    @classmethod
    def of(cls, df: DataFrame, name: str = "inferred", strict: bool = False, first: Iterable[str] = ()) -> Schema:
        """From a DataFrame: declared fields as declared, others inferred; `first` (partition columns) go before the rest."""
        found = {}
        for f in df.schema:
            mine = Field.of(f)
            if mine is None:
                if strict:
                    raise ValueError(f"{f.name}: {f.dataType.simpleString()} has no numpy type")
                warnings.warn(f"{f.name} is left out: {f.dataType.simpleString()} has no numpy type", stacklevel=2)
            else:
                found[f.name] = mine
        lead = [n for n in first if n in found]
        return cls(name, [found[n] for n in [*lead, *(n for n in found if n not in lead)]])

    def encode(self, row: Mapping[str, Any]) -> Row:
        """A row for Spark: values checked and encoded. Missing nullable fields become null."""
        if extra := set(row) - set(self.fields):
            raise ValueError(f"fields {sorted(extra)} are not in schema {self.name}")
        out = {}
        for n, f in self.fields.items():
            if n not in row and not f.nullable:
                raise ValueError(f"field {n} is missing and not nullable")
            value = row.get(n)
            if value is None and not f.nullable:
                raise ValueError(f"field {n} is null and not nullable")
            out[n] = None if value is None else f.encoding.encode(f, value)
        return Row(**out)

    def frame(self, spark: SparkSession, rows: Iterable[Mapping[str, Any]]) -> DataFrame:
        return spark.createDataFrame([tuple(self.encode(r)) for r in rows], self.struct())

    def decode(self, row: Row) -> dict[str, Any]:
        """The row's values as numpy and Python values; errors name the field."""
        out = {}
        for n in row.__fields__:
            f, value = self.fields.get(n), row[n]
            try:
                out[n] = value if value is None or f is None else f.encoding.decode(f, value)
            except Exception as e:
                raise DecodeError(f"field {n}: {e}") from e
        return out


class DecodeError(RuntimeError):
    """A stored value doesn't fit its field."""


def match_names(patterns: Iterable[str] | None, names: Iterable[str]) -> list[str]:
    """Names that a pattern matches as a whole, in the names' order; all of them without patterns."""
    names = list(names)
    if not patterns:
        return names
    compiled = [re.compile(p) for p in patterns]
    for p in compiled:
        if any(p.match(n) and not p.fullmatch(n) for n in names):
            warnings.warn(f"pattern {p.pattern} matches the beginning of some name but not all of it; whole names are matched", stacklevel=2)
    return [n for n in names if any(p.fullmatch(n) for p in compiled)]
