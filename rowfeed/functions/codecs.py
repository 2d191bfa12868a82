"""Codecs: how a field's value is stored. Scalars are stored as they are, tensors as .npy or .npz bytes, images as files."""

from __future__ import annotations

import functools
import io
import struct
import zlib
from abc import ABC, abstractmethod
from decimal import Decimal
from typing import TYPE_CHECKING, Any

import numpy as np
from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from rowfeed.schema import Field


class Codec(ABC):
    """Subclass and `register` for codecs of your own."""

    @abstractmethod
    def name(self) -> str: ...

    @abstractmethod
    def spark_type(self) -> T.DataType | None: ...

    @abstractmethod
    def encode(self, field: Field, value: Any) -> Any: ...

    @abstractmethod
    def decode(self, field: Field, value: Any) -> Any: ...


class Scalar(Codec):
    """A single value, cast to a Spark type (by default the one of the field's numpy type)."""

    def __init__(self, kind: T.DataType | None = None) -> None:
        self.kind = kind

    def name(self) -> str:
        return "scalar" if self.kind is None else f"scalar:{self.kind.simpleString()}"

    def spark_type(self) -> T.DataType | None:
        return self.kind

    def encode(self, field: Field, value: Any) -> Any:
        if field.shape:
            raise ValueError(f"{field.name} has shape {field.shape}; scalars have none")
        if isinstance(value, np.ndarray) and value.shape:
            raise TypeError(f"{field.name}: {type(value).__name__} is no scalar")
        if isinstance(value, (list, tuple, dict, set)):
            raise TypeError(f"{field.name}: {type(value).__name__} is no scalar")
        if isinstance(self.kind, T.DecimalType) or field.dtype == "decimal":
            return Decimal(value) if not isinstance(value, float) else Decimal(str(value))
        if isinstance(self.kind, T.StringType) or (self.kind is None and field.dtype == "str"):
            if not isinstance(value, str):
                raise ValueError(f"{field.name}: {type(value).__name__} is no string")
            return value
        if isinstance(value, np.generic):
            value = value.item()
        kind = self.kind
        if isinstance(kind, T.BooleanType) or field.dtype == "bool":
            return bool(value)
        if isinstance(kind, (T.FloatType, T.DoubleType)) or field.dtype.startswith("float"):
            return float(value)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or "int" in field.dtype:
            return Decimal(int(value)) if field.dtype == "uint64" and kind is None else int(value)
        return value

    def decode(self, field: Field, value: Any) -> Any:
        if field.dtype == "decimal":
            return Decimal(value)
        if field.dtype in ("str", "bytes"):
            return bytes(value) if isinstance(value, bytearray) else value
        if field.shape:
            return np.asarray(value, None if field.dtype in ("str", "datetime64") else field.dtype)
        return np.datetime64(value) if field.dtype == "datetime64" else np.dtype(field.dtype).type(value)


class Tensor(Codec):
    """numpy arrays as .npy bytes."""

    def name(self) -> str:
        return "ndarray"

    def spark_type(self) -> T.DataType:
        return T.BinaryType()

    def encode(self, field: Field, value: np.ndarray) -> bytearray:
        self.check(field, value)
        out = io.BytesIO()
        self.save(out, value)
        return bytearray(out.getvalue())

    def decode(self, field: Field, value: bytes) -> np.ndarray:
        return npy_array(value)

    def save(self, out: io.BytesIO, value: np.ndarray) -> None:
        np.save(out, value, allow_pickle=False)

    @staticmethod
    def check(field: Field, value: np.ndarray) -> None:
        if not isinstance(value, np.ndarray):
            raise ValueError(f"{field.name}: {type(value).__name__} is no array")
        kind = {"U": "str", "S": "bytes", "M": "datetime64"}.get(value.dtype.kind, value.dtype.name)
        if kind != field.dtype:
            raise ValueError(f"{field.name}: type {kind}, declared {field.dtype}")
        if not complies(value.shape, field.shape):
            raise ValueError(f"{field.name}: shape {value.shape}, declared {field.shape}")


class PackedTensor(Tensor):
    """numpy arrays as deflated .npz bytes."""

    def name(self) -> str:
        return "ndarray:deflate"

    def save(self, out: io.BytesIO, value: np.ndarray) -> None:
        np.savez_compressed(out, arr=value)

    def decode(self, field: Field, value: bytes) -> np.ndarray:
        return np.load(io.BytesIO(bytes(value)), allow_pickle=False)["arr"]


NPY_MARK = b"\x93NUMPY"


@functools.lru_cache(maxsize=1024)
def npy_header(head: bytes) -> tuple[tuple[int, ...], bool, np.dtype]:
    """(shape, whether columns come first, type) of a .npy header; those of a column are mostly equal."""
    f = io.BytesIO(head)
    version = np.lib.format.read_magic(f)
    return np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)


def npy_array(value: bytes) -> np.ndarray:
    """The array of .npy bytes, over the same memory."""
    view = memoryview(value)
    if bytes(view[:6]) != NPY_MARK:
        raise ValueError("not an array of numpy")
    long = view[6] > 1
    start = (12 if long else 10) + int.from_bytes(view[8 : 12 if long else 10], "little")
    shape, by_column, kind = npy_header(bytes(view[:start]))
    if kind.hasobject or view[6] > 2:
        return np.load(io.BytesIO(bytes(view)), allow_pickle=False)
    n = int(np.prod(shape, dtype=np.int64))
    return np.frombuffer(view, kind, n, start).reshape(shape, order="F" if by_column else "C") if n else np.zeros(shape, kind)


class Image(Codec):
    """Images (height, width) or (height, width, 3) of uint8 as png, or jpeg with a quality; jpeg needs Pillow, png takes it if it is there."""

    def __init__(self, kind: str = "png", quality: int = 80) -> None:
        if kind not in ("png", "jpeg"):
            raise ValueError(f"{kind}: png and jpeg are supported")
        self.kind, self.quality = kind, quality

    def name(self) -> str:
        return f"image:{self.kind}:{self.quality}"

    def spark_type(self) -> T.DataType:
        return T.BinaryType()

    def pillow(self) -> Any:
        try:
            from PIL import Image as Pil
        except ImportError:
            if self.kind == "jpeg":
                raise
            return None
        return Pil

    def encode(self, field: Field, value: np.ndarray) -> bytearray:
        Tensor.check(field, value)
        if value.dtype != np.uint8 or not (value.ndim == 2 or (value.ndim == 3 and value.shape[2] == 3)):
            raise ValueError(f"{field.name}: {value.dtype} {value.shape} is no image")
        if (pillow := self.pillow()) is None:
            return bytearray(png_bytes(value))
        out = io.BytesIO()
        pillow.fromarray(value).save(out, self.kind, **({"quality": self.quality} if self.kind == "jpeg" else {}))
        return bytearray(out.getvalue())

    def decode(self, field: Field, value: bytes) -> np.ndarray:
        pillow = self.pillow()
        return png_array(bytes(value)) if pillow is None else np.asarray(pillow.open(io.BytesIO(bytes(value))))


PNG_MARK = b"\x89PNG\r\n\x1a\n"


def png_bytes(image: np.ndarray) -> bytes:
    """An 8-bit grey or colour PNG; each line is stored as its difference from the one above."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = image.shape[:2]
    lines = np.ascontiguousarray(image).reshape(height, -1)
    up = np.diff(lines, axis=0, prepend=np.zeros((1, lines.shape[1]), np.uint8))
    raw = np.concatenate([np.full((height, 1), 2, np.uint8), up], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return PNG_MARK + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def png_array(data: bytes) -> np.ndarray:
    """The pixels of an 8-bit grey or colour PNG without interlacing."""
    if data[:8] != PNG_MARK:
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2) or head[6]:
        raise ValueError("only 8-bit grey and colour PNGs without interlacing are read without Pillow")
    width, height, step = head[0], head[1], 3 if head[3] == 2 else 1
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    if (raw[:, 0] == 2).all():
        return np.cumsum(raw[:, 1:], axis=0, dtype=np.uint8).reshape((height, width, 3) if step == 3 else (height, width))
    out = np.zeros((height + 1, width * step), np.uint8)
    for y in range(height):
        out[y + 1] = unfiltered(int(raw[y, 0]), raw[y, 1:], out[y], step)
    return out[1:].reshape((height, width, 3) if step == 3 else (height, width))


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of a PNG from its differences, by the five kinds that the format has."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    out, up = [0] * step + line.tolist(), [0] * step + above.tolist()
    for i in range(step, len(out)):
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out[step:], np.uint8)


def complies(shape: tuple[int, ...], declared: tuple[int | None, ...]) -> bool:
    """Equal rank, and equal sizes where the declared one isn't variable."""
    return len(shape) == len(declared) and all(d in (None, 0) or s in (None, 0) or s == d for s, d in zip(shape, declared, strict=True))


REGISTRY: dict[str, Any] = {
    "scalar": lambda *a: Scalar(T._parse_datatype_string(":".join(a)) if a else None),
    "ndarray": lambda *a: PackedTensor() if a else Tensor(),
    "image": lambda kind="png", quality="80": Image(kind, int(quality)),
}


def register(name: str, make: Any) -> None:
    """Let a codec of your own be found by the first word of its name."""
    REGISTRY[name] = make


def codec_of(name: str) -> Codec:
    head, *args = name.split(":")
    return REGISTRY[head](*args)


def default_codec(dtype: str, shape: tuple, kind: T.DataType | None = None) -> Codec:
    """Scalars as they are; arrays read from Parquet stay arrays; other tensors are .npy bytes."""
    if kind is not None and shape:
        return Scalar(T.ArrayType(kind))
    if dtype == "decimal":
        return Scalar(kind if isinstance(kind, T.DecimalType) else T.DecimalType(38, 18))
    return Tensor() if shape else Scalar(kind)


def to_matrix(column: Column, rows: int, name: str = "column") -> Column:
    """A flat array as `rows` rows of equal length; arrays that don't divide raise."""
    size = F.size(column)
    fits = size % rows == 0
    each = (size / rows).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(column, i * each + 1, each))
    return F.when(fits, parts).otherwise(F.raise_error(F.lit(f"{name} doesn't divide into {rows} rows")))


def uniform_length(column: Column) -> Column:
    """Whether all arrays of a group have one length (an aggregate)."""
    return F.min(F.size(column)) == F.max(F.size(column))
