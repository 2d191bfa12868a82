"""A DataFrame kept as Parquet for training: equal plans share one copy; numbers in one precision; vectors as arrays."""

from __future__ import annotations

import atexit
import os
import threading
import uuid
import warnings
from collections.abc import Callable, Iterator, Mapping
from contextlib import closing
from dataclasses import dataclass
from statistics import median
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from rowfeed.operators.batching import numpy_batches, prefetched, shuffled_batches
from rowfeed.sinks.writer import delete
from rowfeed.sources.loading import ReadPlan
from rowfeed.sources.scan import Scan

CODECS = ("none", "uncompressed", "snappy", "gzip", "lz4", "lz4_raw", "brotli", "zstd")
SMALL_FILE = 50 * 1024 * 1024
_LOCK = threading.Lock()
_KEPT: list[tuple[tuple, DataFrame, "Converter"]] = []
_ON_DELETE: list[Callable[[str], None]] = []


def in_precision(df: DataFrame, dtype: str | None = "float32") -> DataFrame:
    """Doubles, alone and in arrays, as floats, or the other way round; integers stay."""
    if dtype is None:
        return df
    if dtype not in ("float32", "float64"):
        raise ValueError(f"{dtype}: float32 and float64 are supported")
    old, new = (T.DoubleType(), T.FloatType()) if dtype == "float32" else (T.FloatType(), T.DoubleType())
    swap = {old: new, T.ArrayType(old): T.ArrayType(new)}
    return df.select(*[F.col(f"`{f.name}`").cast(swap[k]).alias(f.name) if (k := T.ArrayType(f.dataType.elementType) if isinstance(f.dataType, T.ArrayType) else f.dataType) in swap else F.col(f"`{f.name}`") for f in df.schema])


def vectors_to_arrays(df: DataFrame, dtype: str | None = "float32") -> DataFrame:
    """ML vectors, old and new, as arrays."""
    names = [f.name for f in df.schema if type(f.dataType).__name__ == "VectorUDT"]
    if not names:
        return df
    from pyspark.ml.functions import vector_to_array

    return df.withColumns({n: vector_to_array(F.col(f"`{n}`"), dtype or "float64") for n in names})


@dataclass(frozen=True)
class Converter:
    """A kept copy; small, so it can be sent to other processes."""

    path: str
    files: tuple[str, ...]
    n_rows: int

    def __len__(self) -> int:
        return self.n_rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def batches(self, spark: SparkSession, size: int = 32, num_epochs: int | None = 1, shuffle_capacity: int = 0, seed: int | None = None, ahead: int = 2) -> Iterator[dict[str, np.ndarray]]:
        """Numpy batches, epoch after epoch (None: without end), drawn from a shuffle buffer if it has a capacity, made ahead by a thread.

        This process reads the row groups, where Arrow reaches the files; for several processes see `plans`.
        """
        plan = Scan(self.path, seed=seed).plan(spark)

        def epochs() -> Iterator[dict[str, np.ndarray]]:
            if plan is not None:
                yield from plan.batches(size, num_epochs, shuffle_capacity=shuffle_capacity)
                return
            epoch = 0
            while num_epochs is None or epoch < num_epochs:
                found = numpy_batches(self.frame(spark), size)
                yield from shuffled_batches(found, size, shuffle_capacity, None if seed is None else seed + epoch) if shuffle_capacity else found
                epoch += 1

        return prefetched(epochs(), ahead) if ahead else epochs()

    def plans(self, spark: SparkSession, count: int, seed: int | None = None) -> list[ReadPlan]:
        """What each of `count` training processes needs to read its own row groups, without Spark."""
        return Scan(self.path, seed=seed).plans(spark, count)

    def torch_loader(self, spark: SparkSession, size: int = 32, num_epochs: int | None = 1, tensor: Callable[[np.ndarray], Any] | None = None, **options: Any) -> Iterator[Mapping[str, Any]]:
        """Batches as tensors; `tensor` makes one of an array (by default torch's). options: as of `batches`."""
        if tensor is None:
            import torch

            tensor = torch.as_tensor
        with closing(self.batches(spark, size, num_epochs, **options)) as found:
            for b in found:
                yield {k: tensor(v) for k, v in b.items()}

    def tf_dataset(self, spark: SparkSession, size: int = 32, num_epochs: int | None = 1, **options: Any) -> Any:
        import tensorflow as tf

        with closing(self.batches(spark, size, ahead=0)) as found:
            first = next(found)
        spec = {k: tf.TensorSpec((None, *v.shape[1:]), v.dtype) for k, v in first.items()}
        return tf.data.Dataset.from_generator(lambda: self.batches(spark, size, num_epochs, **options), output_signature=spec)

    def delete(self, spark: SparkSession | None = None) -> None:
        forget(self, spark)


def convert(df: DataFrame, parent: str, row_group_bytes: int = 32 * 1024 * 1024, codec: str | None = None, dtype: str | None = "float32") -> Converter:
    """The kept copy of the DataFrame under `parent`; made once for equal plans and options."""
    if codec is not None and codec.lower() not in CODECS:
        raise ValueError(f"codec {codec}: Parquet has {CODECS}")
    spark, key = df.sparkSession, (parent.rstrip("/"), row_group_bytes, codec, dtype)
    with _LOCK:
        for k, kept, made in _KEPT:
            if k == key and kept.sparkSession is spark and kept.sameSemantics(df):
                return made
        path = f"{key[0]}/rowfeed-{uuid.uuid4().hex}"
        out = in_precision(vectors_to_arrays(df, dtype), dtype).write.option("parquet.block.size", row_group_bytes)
        (out.option("compression", codec) if codec else out).parquet(path)
        back = spark.read.parquet(path)
        made = Converter(path, tuple(back.inputFiles()), back.count())
        warn_small(spark, path)
        _KEPT.append((key, df, made))
        return made


def warn_small(spark: SparkSession, path: str) -> None:
    """One listing of the folder, on whatever filesystem it is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    sizes = [f.getLen() for f in listed if f.getPath().getName().endswith(".parquet")]
    if len(sizes) > 1 and median(sizes) < SMALL_FILE:
        warnings.warn(f"the median of {len(sizes)} files is {median(sizes)} bytes; coalesce before converting", stacklevel=3)


def on_delete(handler: Callable[[str], None]) -> None:
    """Delete kept copies with a function of your own."""
    _ON_DELETE[:] = [handler]


def forget(made: Converter, spark: SparkSession | None = None) -> None:
    with _LOCK:
        _KEPT[:] = [x for x in _KEPT if x[2] != made]
    if _ON_DELETE:
        _ON_DELETE[0](made.path)
    elif spark := spark or SparkSession.getActiveSession():
        delete(spark, made.path)


@atexit.register
def _forget_all() -> None:
    for _, df, made in list(_KEPT):
        if _ON_DELETE or df.sparkSession.sparkContext._jsc is not None:  # a stopped session deletes nothing
            forget(made, df.sparkSession)


def check_ranks(shard_index: int | None, shard_count: int | None, env: Mapping[str, str] | None = None) -> bool:
    """Whether the shard agrees with the launcher's rank and size; warns if not. (names of variables: fixed values)"""
    env = os.environ if env is None else env
    for rank, size in (("HOROVOD_RANK", "HOROVOD_SIZE"), ("OMPI_COMM_WORLD_RANK", "OMPI_COMM_WORLD_SIZE"), ("PMI_RANK", "PMI_SIZE")):
        if rank in env and size in env:
            if (shard_index, shard_count) != (int(env[rank]), int(env[size])):
                warnings.warn(f"shard {shard_index} of {shard_count}, but {rank} is {env[rank]} and {size} {env[size]}", stacklevel=2)
                return False
            return True
    return True
