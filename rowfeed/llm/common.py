"""Helpers shared by the training-data operators: workers' path and caches, batches by bytes, keys of rows, word splitting."""

from __future__ import annotations

import gc
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowfeed.session import share_code
from rowfeed.staging import Workspace  # noqa: F401


#: Bytes that separate words when only ASCII letters, digits and non-ASCII characters count, as spaces; A-Z lower-cased.
ALNUM_LOWER = bytes(
    b if b in range(0x30, 0x3A) or b in range(0x61, 0x7B) or b >= 0x80 else b + 32 if b in range(0x41, 0x5B) else 0x20
    for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8; null has none."""
    return text.encode().translate(ALNUM_LOWER).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as UTF-8; null has none."""
    return text.encode().lower().split() if text else []


#: Settings of the C library's allocator for workers: blocks of a megabyte or more are mapped alone, so that arrays go back to the system
#: when they are freed, and few threads' heaps are kept. Arrow's batches come from it, too: its own pool keeps what they leave.
ALLOCATOR = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> None:
    share_code(spark)
    for name, value in ALLOCATOR.items():
        spark.sparkContext.environment.setdefault(name, value)


#: What a worker keeps from task to task (token states, hashes, vectors): owner -> how to forget it.
_KEPT: dict[str, Callable[[], object]] = {}
_owner = ""


def keep(owner: str, forget: Callable[[], object]) -> None:
    """Register a cache of the worker. Each is bounded in bytes by its owner."""
    _KEPT[owner] = forget


def keep_only(owner: str) -> None:
    """A worker has the caches of one operator at a time: those of others are forgotten."""
    global _owner
    if owner != _owner:
        for name, forget in _KEPT.items():
            if name != owner:
                forget()
        gc.collect()
        _owner = owner


class Kept(dict):
    """A dict that computes what is missing, and starts anew when it is full. Keys longer than LONGEST are not kept, so entries bound bytes."""

    LONGEST = 64

    def __init__(self, make: Callable, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.make(key)
        if isinstance(key, (str, bytes)) and len(key) > self.LONGEST:
            return value
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


def map_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` with this package in the workers' path."""
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return map_stream(df, run, schema)


def size_slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose strings (or binaries) of the column have at most so many bytes together; a longer one is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The key of a row by its id and text, a hash of 64 bits: the same wherever it is computed, spread for repeated and null ids."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def fresh(columns: Collection[str], *names: str) -> list[str]:
    """The names, with a mark where the columns have them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
