"""Rows and tables to the driver: tasks decode and pack them, the driver unpacks Arrow buffers.

A task packs its rows into Arrow streams of bounded size, each one binary value; the driver takes partitions in order, and
fetches the next ones meanwhile. So decoding runs in as many tasks, and the driver holds bounded bytes of each.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowfeed.functions.codecs import Image, Tensor
from rowfeed.schema import DecodeError, Schema
from rowfeed.session import share_code
from rowfeed.sources.rowgroups import created, opened
from rowfeed.staging import Workspace

PACK_BYTES = 8 << 20
TENSOR = pa.struct([("data", pa.binary()), ("shape", pa.list_(pa.int64()))])


def packs(batch: pa.RecordBatch, most: int = PACK_BYTES) -> Iterator[bytes]:
    """The batch as Arrow streams of about so many bytes."""
    rows = max(1, int(most * batch.num_rows / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch.slice(i, rows))
        yield sink.getvalue().to_pybytes()


def tensor_fields(schema: Schema | None, df: DataFrame) -> dict[str, Any]:
    """Fields whose stored bytes become arrays of numbers."""
    found = {n: f for n, f in schema.fields.items() if n in df.columns} if schema is not None else {}
    return {n: f for n, f in found.items() if isinstance(f.encoding, (Tensor, Image)) and f.dtype not in ("str", "bytes", "datetime64", "decimal")}


#: Partitions that are brought to the driver at a time, and the most bytes of one that come at once; the rest of a larger one waits in the shared folder.
AT_ONCE, INLINE_BYTES = 8, 64 << 20


def batches_to_driver(df: DataFrame, schema: Schema | None = None, at_once: int = AT_ONCE, inline_bytes: int = INLINE_BYTES, pack_bytes: int = PACK_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches in the order of partitions; tensors as structs of raw data and shape.

    Each partition is a job of its own, some of them ahead of the one that is given out. A task sends `inline_bytes` of it and writes what is more
    to a file in the job's folder, which the driver reads pack by pack. So the driver holds at most at_once * inline_bytes and a pack.
    """
    tensors = tensor_fields(schema, df)
    spark = share_code(df.sparkSession)
    work = Workspace(spark)
    folder = work.url()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, out, path = 0, None, f"{folder}/packs-{uuid.uuid4().hex}"
        for batch in batches:
            if batch.num_rows:
                for n, f in tensors.items():
                    at = batch.schema.get_field_index(n)
                    batch = batch.set_column(at, n, unpacked(f, batch.column(at)))
                for pack in packs(batch, pack_bytes):
                    if sent < inline_bytes:
                        sent += len(pack)
                        yield pa.RecordBatch.from_arrays([pa.array([pack], pa.binary())], ["pack"])
                    else:
                        out = out or created(path)
                        out.write(len(pack).to_bytes(8, "big") + pack)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([FILE_MARK + path.encode()], pa.binary())], ["pack"])

    rdd, sc = df.mapInArrow(run, "pack binary").rdd, spark.sparkContext
    n = rdd.getNumPartitions()
    waiting: deque[Future] = deque()
    with ThreadPoolExecutor(at_once) as pool:
        try:
            for p in range(n):
                waiting.append(pool.submit(sc.runJob, rdd, lambda rows: [bytes(r[0]) for r in rows], [p]))
                if len(waiting) >= at_once:
                    yield from unpack(waiting.popleft().result())
            while waiting:
                yield from unpack(waiting.popleft().result())
        finally:
            for future in waiting:
                future.cancel()
            work.close()


#: Marks the name of a file of packs; a pack, an Arrow stream, begins otherwise.
FILE_MARK = b"file of packs "


def unpack(found: list[bytes]) -> Iterator[pa.RecordBatch]:
    for pack in found:
        if pack.startswith(FILE_MARK):
            with opened(pack[len(FILE_MARK) :].decode()) as f:
                while head := f.read(8):
                    with pa.ipc.open_stream(f.read(int.from_bytes(head, "big"))) as stream:
                        yield from stream
        else:
            with pa.ipc.open_stream(pack) as stream:
                yield from stream


def unpacked(f: Any, column: pa.Array) -> pa.Array:
    """Stored tensors as raw data and shapes."""
    data, shapes = [], []
    for value in column.to_pylist():
        try:
            x = None if value is None else np.asarray(f.encoding.decode(f, value), f.dtype)
        except Exception as e:
            raise DecodeError(f"field {f.name}: {e}") from e
        data.append(None if x is None else np.ascontiguousarray(x).tobytes())
        shapes.append([] if x is None else list(x.shape))
    fields = [pa.array(data, pa.binary()), pa.array(shapes, pa.list_(pa.int64()))]
    return pa.StructArray.from_arrays(fields, fields=list(TENSOR), mask=pa.array([d is None for d in data]))


def decoded_rows(df: DataFrame, schema: Schema) -> Iterator[dict[str, Any]]:
    """Each row as a dict of numpy and Python values; errors name the field."""
    tensors = tensor_fields(schema, df)
    for batch in batches_to_driver(df, schema):
        columns = [arrays(tensors[n], c) if n in tensors else values(schema, n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)]
        for row in zip(*columns, strict=True):
            yield dict(zip(batch.schema.names, row, strict=True))


def decoded_table(table: pa.Table, schema: Schema) -> tuple[list[str], list[list[Any]]]:
    """The names of a table's columns, and each column's values decoded; errors name the field."""
    out = []
    for name, column in zip(table.column_names, table.columns, strict=True):
        f, whole = schema.fields.get(name), pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
        if f is not None and isinstance(f.encoding, (Tensor, Image)) and f.dtype not in ("str", "bytes", "datetime64", "decimal"):
            out.append(tensors_of(f, whole))
        else:
            out.append(values(schema, name, whole))
    return table.column_names, out


def tensors_of(f: Any, column: pa.Array) -> list[np.ndarray | None]:
    """Stored tensors as arrays that their holder may change."""
    out = []
    for value in column:
        try:
            x = None if not value.is_valid else np.asarray(f.encoding.decode(f, value.as_buffer() if pa.types.is_binary(column.type) else value.as_py()), f.dtype)
        except Exception as e:
            raise DecodeError(f"field {f.name}: {e}") from e
        out.append(x if x is None or x.flags.writeable and x.flags.owndata else x.copy())
    return out


def arrays(f: Any, column: pa.Array) -> list[np.ndarray | None]:
    data, shapes = column.field("data"), column.field("shape").to_pylist()
    return [np.frombuffer(data[i].as_buffer(), f.dtype).reshape(shapes[i]).copy() if ok else None for i, ok in enumerate(column.is_valid().to_pylist())]


def values(schema: Schema, name: str, column: pa.Array) -> list[Any]:
    f = schema.fields.get(name)
    raw = list(column.to_numpy(zero_copy_only=False)) if pa.types.is_timestamp(column.type) else column.to_pylist()
    try:
        return [v if v is None or f is None else f.encoding.decode(f, v) for v in raw]
    except Exception as e:
        raise DecodeError(f"field {name}: {e}") from e
