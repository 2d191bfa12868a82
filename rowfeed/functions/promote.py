"""Types as training frameworks take them."""

from __future__ import annotations

from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

#: numpy types that a tensor of TensorFlow has (fixed values).
TF_TYPES = ("bool", "int8", "uint8", "int16", "int32", "int64", "uint16", "uint32", "float16", "float32", "float64", "str", "bytes", "decimal", "datetime64")
NANOS_A_DAY = 86_400_000_000_000


def tf_type(dtype: str) -> str:
    """The tensor type of a field's type: decimals and texts are strings, times int64 nanoseconds, unsigned types widened."""
    if dtype not in TF_TYPES:
        raise ValueError(f"{dtype} has no tensor type")
    return {"decimal": "string", "str": "string", "bytes": "string", "datetime64": "int64", "uint16": "int32", "uint32": "int64"}.get(dtype, dtype)


def tf_column(name: str, kind: T.DataType, strict: bool = True) -> Column:
    """The column as a tensor takes it; a null raises if strict."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.DecimalType):
        out = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif isinstance(kind, T.TimestampType):
        out = F.unix_micros(c) * 1000
    elif isinstance(kind, T.TimestampNTZType):
        # Wall-clock time counts as UTC, whatever the session's time zone.
        out = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c) * 1000
    elif isinstance(kind, T.DateType):
        out = F.unix_date(c).cast("bigint") * NANOS_A_DAY
    else:
        out = c
    if strict:
        out = F.when(c.isNull(), F.raise_error(F.lit(f"{name} is null; fill or filter nulls first"))).otherwise(out)
    return out.alias(name)


def to_tf(df: DataFrame, strict: bool = True) -> DataFrame:
    return df.select(*[tf_column(f.name, f.dataType, strict) for f in df.schema])


def to_torch(df: DataFrame, strict: bool = True) -> DataFrame:
    """Booleans become small integers; texts, times and decimals raise, as torch has no tensors of them."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.MapType, T.StructType)):
            raise TypeError(f"{f.name}: torch has no tensors of {f.dataType.simpleString()}")
        c = F.col(f"`{f.name}`")
        value = c.cast("smallint") if isinstance(f.dataType, T.BooleanType) else c
        if strict:
            value = F.when(c.isNull(), F.raise_error(F.lit(f"{f.name} is null"))).otherwise(value)
        out.append(value.alias(f.name))
    return df.select(*out)


def torch_array(name: str, value: Any) -> np.ndarray:
    """A numpy value as torch takes it: unsigned types widened, booleans as uint8."""
    if value is None:
        raise TypeError(f"{name} is null")
    value = np.asarray(value)
    if value.dtype.kind in "USOM":
        raise TypeError(f"{name}: torch has no tensors of {value.dtype}")
    wider = {"uint16": np.int32, "uint32": np.int64, "bool": np.uint8}.get(value.dtype.name)
    return value if wider is None else value.astype(wider)


def collate(rows: list[Any]) -> Any:
    """Rows to columns: numbers become arrays, decimals and texts stay lists; dicts and lists inside are collated too."""
    first = rows[0]
    if isinstance(first, dict):
        return {k: collate([r[k] for r in rows]) for k in first}
    if isinstance(first, tuple) and hasattr(first, "_fields"):
        return type(first)(*[collate([r[i] for r in rows]) for i in range(len(first))])
    if isinstance(first, (str, bytes, Decimal)):
        return rows
    if isinstance(first, (list, tuple)):
        return [collate([r[i] for r in rows]) for i in range(len(first))]
    return np.stack([np.asarray(r) for r in rows])
