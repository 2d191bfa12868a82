"""Generated rows of a schema, for tests and benchmarks: a seeded range with built-in expressions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowfeed.schema import Field, Schema

VARIABLE = 13
#: Least and largest integer of a type come from numpy; these are the other types' ranges.
FLOATS = {"float32", "float64"}


def value(f: Field, seed: int) -> Column:
    """A column of values spread over the field's range; a flat array if the field has a shape."""
    if f.shape:
        size = int(np.prod([VARIABLE if d is None else d for d in f.shape]))
        return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: _scalar(f, F.xxhash64(F.col("id"), i, F.lit(seed))))
    return _scalar(f, F.xxhash64(F.col("id"), F.lit(seed)))


def _scalar(f: Field, h: Column) -> Column:
    if f.dtype == "bool":
        return h % 2 == 0
    if f.dtype in FLOATS:
        return (F.pmod(h, F.lit(1 << 24)) / float(1 << 24)).cast("float" if f.dtype == "float32" else "double")
    if f.dtype in ("str", "bytes"):
        text = F.hex(h)
        return text if f.dtype == "str" else text.cast("binary")
    if f.dtype == "decimal":
        return (F.pmod(h, F.lit(25_500)) / 100).cast("decimal(10,2)")
    if f.dtype == "datetime64":
        return F.timestamp_seconds(F.pmod(h, F.lit(2_000_000_000)))
    info = np.iinfo(f.dtype)
    span = min(int(info.max) - int(info.min), 2**62)
    kind = f.spark().dataType.simpleString() if not f.shape else "bigint"
    return (F.pmod(h, F.lit(span)) + F.lit(max(int(info.min), -(2**61)))).cast(kind)


def frame(spark: SparkSession, schema: Schema, n: int, seed: int = 0) -> DataFrame:
    """n rows of the schema."""
    return spark.range(n).select(*[value(f, seed + i).alias(f.name) for i, f in enumerate(schema.fields.values())])


def point(schema: Schema, rng: np.random.Generator) -> dict[str, Any]:
    """One row of numpy values."""
    out: dict[str, Any] = {}
    for f in schema.fields.values():
        shape = tuple(VARIABLE if d is None else d for d in f.shape)
        if f.dtype in ("str", "bytes", "decimal", "datetime64"):
            make = {"str": lambda: f"v{rng.integers(1e9)}", "bytes": lambda: b"v%d" % rng.integers(1e9), "decimal": lambda: int(rng.integers(255)), "datetime64": lambda: np.datetime64(int(rng.integers(2e9)), "s")}[f.dtype]
            out[f.name] = make() if not shape else np.array([make() for _ in range(int(np.prod(shape)))]).reshape(shape)
        elif f.dtype == "bool":
            out[f.name] = rng.integers(0, 2, shape).astype(bool) if shape else bool(rng.integers(2))
        elif f.dtype in FLOATS:
            out[f.name] = rng.random(shape).astype(f.dtype) if shape else np.dtype(f.dtype).type(rng.random())
        else:
            info = np.iinfo(f.dtype)
            v = rng.integers(info.min, info.max, shape or None, dtype=f.dtype)
            out[f.name] = v
    return out


def endless(schema: Schema, seed: int = 0) -> Iterator[dict[str, Any]]:
    """Rows without end."""
    rng = np.random.default_rng(seed)
    while True:
        yield point(schema, rng)


def dummy_batches(batch: int, dim: int, seed: int = 0) -> Iterator[np.ndarray]:
    """Batches (batch, dim) of float32 without end, to measure what comes after a reader."""
    rng = np.random.default_rng(seed)
    while True:
        yield rng.random((batch, dim), dtype=np.float32)
