"""Row groups as a column: the unit of shards, indexes, seeded order and windows.

Physical groups are those of the Parquet files, found by their footers, numbered by (path, group). Logical groups are
runs of a dense integer key. Either way `rg` is an ordinary column, so Spark's own task splits never show in results.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowfeed.functions.predicates import Bounds, Mask, Predicate, dnf_possible
from rowfeed.session import share_code
from rowfeed.staging import Workspace

RG = "rg"
#: Most tasks of a read; bytes (before compression) of row groups that one task reads, if that makes LEAST_TASKS for each core; footers that it keeps.
MOST_TASKS, TASK_BYTES, LEAST_TASKS, FOOTERS = 20_000, 32 << 20, 4, 16
#: Rows of a partition for windows over row groups of a key.
GROUP_ROWS = 250_000
#: Ranges of a key in one filter. Spark walks a filter by recursion, and some hundreds of ranges overflow its stack.
MOST_RANGES = 64


def logical(df: DataFrame, key: str, size: int) -> DataFrame:
    """`rg` = key div size; needs no shuffle."""
    return df.withColumn(RG, F.expr(f"`{key}` div {int(size)}"))


def in_groups(df: DataFrame, key: str, size: int, numbers: Sequence[int]) -> DataFrame:
    """`logical`, of the groups with these numbers only: ranges of the key, which the reader of Parquet gets as filters.

    Beyond MOST_RANGES runs of numbers those with the least between them become one range, and the number then tells which rows stay.
    """
    runs: list[list[int]] = []
    for n in sorted(set(numbers)):
        if runs and n == runs[-1][1] + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    wide = joined_runs(runs, MOST_RANGES)
    c, keep = F.col(f"`{key}`"), F.lit(False)
    for first, last in wide:  # `div` cuts towards zero
        low = first * size if first > 0 else (first - 1) * size + 1
        high = (last + 1) * size - 1 if last >= 0 else last * size
        keep = keep | ((c >= low) & (c <= high))
    rows = logical(df.where(keep), key, size)
    return rows if len(wide) == len(runs) else rows.where(F.col(RG).isin(*sorted(set(numbers))))


def joined_runs(runs: Sequence[Sequence[int]], most: int) -> list[list[int]]:
    """At most `most` runs, made of sorted ones across the narrowest gaps."""
    gaps = sorted(range(1, len(runs)), key=lambda i: (runs[i - 1][1] - runs[i][0], i))[: most - 1]  # the widest stay
    cuts = [0, *sorted(gaps), len(runs)]
    return [[runs[a][0], runs[b - 1][1]] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def together(df: DataFrame, rows: int) -> DataFrame:
    """The frame with each row group in one partition, of about GROUP_ROWS rows if there are `rows` in all.

    Adaptive plans join partitions by their compressed bytes, of which runs of a key may have less than one a row: a task of windows over them would then
    get all rows, however many.
    """
    return df.repartition(max(1, min(MOST_TASKS, -(-rows // GROUP_ROWS))), RG)


def by_count(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """`rg` from the position in an order."""
    return numbered(df, order).withColumn(RG, F.expr(f"_pos div {int(size)}")).drop("_pos")


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "_pos") -> DataFrame:
    """Positions from 0 in a total order, without a one-partition window.

    The rows are sorted over range partitions once and written with their partition and place in it, to the shared folder: two
    evaluations could deal them differently. Positions are then places plus the sizes of the partitions before. Repeated
    rows each get a position.
    """
    part, at, before = unused(df.columns, "_part", "_at", "_before")
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id's upper bits are the partition's number, the lower 33 count its rows.
    laid = laid.withColumn(at, F.monotonically_increasing_id()).select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright(at, 33).alias(part), F.col(at).bitwiseAND((1 << 33) - 1).alias(at))
    laid = Workspace(df.sparkSession).save(laid, "numbered")
    sizes = laid.groupBy(part).agg(F.count("*").alias("n"))
    # One row a partition: the offsets fit in one task, and in a broadcast, at any size of the data.
    offsets = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    return laid.join(F.broadcast(offsets), part).select(*[F.col(f"`{c}`") for c in df.columns], (F.col(before) + F.col(at)).alias(name))


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names, with a mark where the columns have them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: The manifest's columns but for partitions and bounds.
MANIFEST = (RG, "path", "group", "low", "high", "bytes")
#: Kinds whose bounds in a footer mean what Spark's comparisons mean.
BOUNDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.DateType)
FILE_COLUMNS = ("path", "modificationTime", "length", "content")


def manifest(spark: SparkSession, *paths: str, bounds: Sequence[str] = ()) -> DataFrame:
    """(rg, path, group, low, high, bytes, parts, bounds): row groups of all files, with their row ranges in the file and sizes before compression. Footers are read by executors.

    The files are those that Spark's reader of Parquet takes for the same paths, whatever their names end in: both readers list alike, and pass over
    names that begin with a mark. parts: the values of the partition columns, as Spark infers them. bounds: for each of the columns named,
    the least and greatest value in the row group and its number of nulls, null where the footer doesn't tell. Paths are as Hadoop has
    them, so characters that URLs encode stay encoded.
    """
    listed = spark.read.format("binaryFile").load(list(paths)).where("length > 0")
    parts = [f for f in listed.schema if f.name not in FILE_COLUMNS]
    schema = spark.read.parquet(*paths).schema if bounds else T.StructType()
    known = [schema[n] for n in bounds if n in schema.names and n not in [f.name for f in parts] and isinstance(schema[n].dataType, BOUNDED)]
    wanted = T.StructType([T.StructField(f.name, T.StructType([T.StructField("low", f.dataType), T.StructField("high", f.dataType), T.StructField("nulls", T.LongType())])) for f in known])
    fields = [T.StructField("path", T.StringType()), T.StructField("group", T.IntegerType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("bytes", T.LongType())]
    kinds = to_arrow_schema(T.StructType([*fields, T.StructField("parts", T.StructType(parts)), T.StructField("bounds", wanted)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, row, told = [], [], {f.name: [] for f in known}
            for k, path in enumerate(batch.column(0).to_pylist()):
                with opened(path) as f:
                    meta, low = pq.read_metadata(f), 0
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    out.append((path, g, low, low + group.num_rows, group.total_byte_size))
                    row.append(k)
                    low += group.num_rows
                    if known:
                        at = {group.column(i).path_in_schema: i for i in range(group.num_columns)}
                        for name, values in told.items():
                            values.append(footer_bounds(group.column(at[name]).statistics if name in at else None))
            columns = [pa.array(c, t.type) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 5, kinds, strict=False)]
            columns.append(batch.column(1).take(pa.array(row, pa.int64())).cast(kinds.field("parts").type))
            if known:
                made = [pa.StructArray.from_arrays([typed(c, t.type) for c, t in zip(zip(*values, strict=True) if values else [[]] * 3, kinds.field("bounds").type.field(name).type, strict=True)], fields=list(kinds.field("bounds").type.field(name).type)) for name, values in told.items()]
                columns.append(pa.StructArray.from_arrays(made, fields=list(kinds.field("bounds").type)))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kinds][: len(columns)])

    out = [*fields, T.StructField("parts", T.StructType(parts)), *([T.StructField("bounds", wanted)] if known else [])]
    if not parts:  # Parquet has no structs without fields
        out[5] = T.StructField("parts", T.StructType([T.StructField("none", T.BooleanType())]))
        kinds = to_arrow_schema(T.StructType([*out[:6], T.StructField("bounds", wanted)]))
    struct = F.struct(*[F.col(f"`{f.name}`") for f in parts]) if parts else F.struct(F.lit(None).cast("boolean").alias("none"))
    # Only paths and partitions are asked for, so the files' contents aren't read; a footer is the end of a file.
    groups = share_code(spark) and listed.select("path", struct.alias("parts")).mapInArrow(run, T.StructType(out))
    # The manifest has a row for each row group, some millions at most, so a window over all of it fits in a task. It is kept, as it is read twice.
    numbers = groups.withColumn(RG, F.row_number().over(Window.orderBy("path", "group")).cast("bigint") - 1).select(*MANIFEST, *[f.name for f in out[5:]])
    return Workspace(spark).save(numbers, "manifest")


def footer_bounds(stats: pq.Statistics | None) -> tuple:
    """(least, greatest, nulls) as a footer tells them, null where it doesn't."""
    if stats is None:
        return None, None, None
    low, high = (stats.min, stats.max) if stats.has_min_max else (None, None)
    return low, high, stats.null_count if stats.has_null_count else None


def typed(values: Sequence[Any], kind: pa.DataType) -> pa.Array:
    """Bounds as the column's type; of values that aren't of it, nothing is known."""
    try:
        return pa.array(values, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):
        return pa.nulls(len(values), kind)


def partition_names(groups: DataFrame) -> list[str]:
    return [n for n in groups.schema["parts"].dataType.names if n != "none"]


def known_bounds(groups: DataFrame, schema: T.StructType) -> dict[str, Bounds]:
    """The bounds that a manifest has of columns: those asked for, and partitions, whose value is known."""
    out = {n: Bounds(F.col(f"parts.`{n}`"), F.col(f"parts.`{n}`"), F.col(f"parts.`{n}`").isNull().cast("long"), schema[n].dataType) for n in partition_names(groups)}
    for n in groups.schema["bounds"].dataType.names if "bounds" in groups.columns else ():
        out[n] = Bounds(*(F.col(f"bounds.`{n}`.{x}") for x in ("low", "high", "nulls")), schema[n].dataType)
    return out


def prune(groups: DataFrame, schema: T.StructType, predicates: Sequence[Predicate], filters: Sequence[Any] | None = None) -> tuple[DataFrame, list[Predicate]]:
    """The row groups of a manifest that may have rows to keep, and the predicates that rows still have to pass.

    Predicates on partition columns alone are decided here, of whatever kind they are; of others the bounds tell which groups can't have rows.
    """
    names, known = set(partition_names(groups)), known_bounds(groups, schema)
    decided = [p for p in predicates if p.fields() <= names]
    left = [p for p in predicates if not p.fields() <= names]
    for p in left:
        groups = groups.where(p.possible(known))
    if filters:
        groups = groups.where(dnf_possible(filters, known))
    if decided:
        all_of = unused([*names], "_group")[0]
        rows = groups.select(F.struct(*groups.columns).alias(all_of), *[F.col(f"parts.`{n}`").alias(n) for n in names])
        for p in decided:
            rows = p.filter(rows)
        groups = rows.select(f"{all_of}.*")
    return groups, left


def opened(path: str) -> pa.NativeFile:
    """A file by the path that Spark gives it, which is percent-encoded or, from the binary source, plain."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem().open_input_file("/" + (rest if os.path.exists("/" + rest.lstrip("/")) else unquote(rest)).lstrip("/"))
    files, place = pafs.FileSystem.from_uri(path)
    return files.open_input_file(place)


def created(path: str) -> pa.NativeFile:
    """A new file at a path of a folder that exists or can be made."""
    if path.startswith("file:"):
        place = "/" + path[5:].lstrip("/")
        os.makedirs(os.path.dirname(place), exist_ok=True)
        return pafs.LocalFileSystem().open_output_stream(place)
    files, place = pafs.FileSystem.from_uri(path)
    return files.open_output_stream(place)


def moved(source: str, target: str) -> None:
    """Rename a file; one of that name goes."""
    if source.startswith("file:"):
        os.replace("/" + source[5:].lstrip("/"), "/" + target[5:].lstrip("/"))
        return
    files, place = pafs.FileSystem.from_uri(target)
    if files.get_file_info(place).type != pafs.FileType.NotFound:
        files.delete_file(place)
    files.move(pafs.FileSystem.from_uri(source)[1], place)


@dataclass(frozen=True)
class GroupReader:
    """How a row group is read: the columns, those of them that partitions give, and which rows are kept, by which columns."""

    names: list[str]
    parts: list[str]
    types: pa.Schema
    first: list[str]
    keep: Mask | None
    shuffle: str | None

    @classmethod
    def of(cls, schema: T.StructType, parts: list[str], columns: Sequence[str] | None = None, first: Sequence[str] = (), keep: Mask | None = None, shuffle: str | None = None) -> GroupReader:
        names = [n for n in schema.names if columns is None or n in columns]
        first = [n for n in first if keep is not None]
        types = to_arrow_schema(T.StructType([T.StructField(n, schema[n].dataType) for n in [*names, *(n for n in first if n not in names)]]))
        return cls(names, parts, types, first, keep, shuffle)

    def read(self, rg: int, path: str, group: int, values: Mapping[str, pa.Array], footers: dict[str, pq.FileMetaData] | None = None) -> tuple[pa.Table | None, np.ndarray, int]:
        """The kept rows (None if no column is wanted), their places in the group, and the group's size. values: the partitions', an array of one each. footers: those of
        the last files, kept from one call to the next."""
        with opened(path) as f:
            file = pq.ParquetFile(f, metadata=footers.get(path) if footers is not None else None)
            if footers is not None and path not in footers:
                if len(footers) >= FOOTERS:
                    del footers[next(iter(footers))]
                footers[path] = file.metadata
            n, inside = file.metadata.row_group(group).num_rows, set(file.schema_arrow.names)

            def columns(which: Sequence[str]) -> dict[str, Any]:
                there = [c for c in which if c in inside and c not in self.parts]
                table = file.read_row_group(group, columns=there) if there else None
                return {c: conformed(table[c], self.types.field(c).type) if c in there else pa.repeat(values[c].cast(self.types.field(c).type)[0], n) if c in self.parts else pa.nulls(n, self.types.field(c).type) for c in which}

            got, at = {}, np.arange(n)
            if self.keep is not None:
                got = columns(self.first)
                at = np.flatnonzero(self.keep(pa.table(got)))
                if len(at) == 0:
                    return None, at, n
            got |= columns([c for c in self.names if c not in got])
        if self.shuffle is not None:
            seed = int.from_bytes(hashlib.md5(f"{self.shuffle}:{rg}".encode()).digest(), "big")
            at = at[np.random.default_rng(seed).permutation(len(at))]
        table = pa.table([got[c] for c in self.names], names=self.names) if self.names else None
        if table is not None and (len(at) < n or self.shuffle is not None):
            table = table.take(pa.array(at))
        return table, at, n


def physical(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None, groups: DataFrame | None = None, place: tuple[str, str] | None = None, first: Sequence[str] = (), keep: Mask | None = None, order: str | None = None, shuffle: bool = False) -> DataFrame:
    """The rows of Parquet files with `rg`, and, in columns of the names in `place`, each one's place in its group and the group's size.

    Tasks read row groups by the manifest, the wanted columns of each, and nothing else: with `groups` (rows of a
    manifest) the others are not touched. There is no join and no shuffle of rows. A row group must fit in a task's memory.
    keep: of a row group the columns `first` are read, then, if it keeps any row, the others. order: a text by which row groups are
    ordered anew, by its hash with their numbers; they are then read in that order, and with `shuffle` the rows of each are
    permuted by the same hash. Only the manifest is sorted.
    """
    schema = spark.read.parquet(*paths).schema
    chosen = manifest(spark, *paths) if groups is None else groups
    reader = GroupReader.of(schema, partition_names(chosen), columns, first, keep, order if shuffle else None)
    fields = [T.StructField(RG, T.LongType()), *(T.StructField(n, T.LongType()) for n in place or ()), *(schema[n] for n in reader.names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        footers: dict[str, pq.FileMetaData] = {}
        for batch in batches:
            values = {n: batch.column(3).field(n) for n in reader.parts}
            for k, (rg, path, group) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
                table, at, n = reader.read(rg, path, group, {c: v.slice(k, 1) for c, v in values.items()}, footers)
                if len(at):
                    lead = [pa.array(np.full(len(at), rg)), *([pa.array(at), pa.array(np.full(len(at), n))] if place else [])]
                    yield from pa.table([*lead, *(table.columns if table is not None else [])], names=[f.name for f in fields]).to_batches(max_chunksize=10_000)

    # A task has one row group, or neighbours up to TASK_BYTES, of the same files where they can be.
    all_of = chosen.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    tasks = max(1, min(all_of.n, MOST_TASKS, max(LEAST_TASKS * spark.sparkContext.defaultParallelism, -(-(all_of.bytes or 0) // TASK_BYTES))))
    given = chosen.select(RG, "path", "group", "parts", *([F.md5(F.concat(F.lit(f"{order}:"), F.col(RG).cast("string")).cast("binary")).alias("_order")] if order is not None else []))
    laid = given.repartitionByRange(tasks, RG).sortWithinPartitions(RG) if order is None else given.repartitionByRange(tasks, "_order", RG).sortWithinPartitions("_order", RG).drop("_order")
    return laid.mapInArrow(run, T.StructType(fields))


def conformed(column: pa.ChunkedArray, kind: pa.DataType) -> pa.ChunkedArray:
    """A column as Spark has it: unsigned types in wider ones, times in microseconds."""
    if column.type == kind:
        return column
    if pa.types.is_timestamp(kind) and pa.types.is_timestamp(column.type) and kind.tz != column.type.tz:
        column = column.cast(pa.timestamp("us", column.type.tz), safe=False)
    return column.cast(kind, safe=False)


def summary(df: DataFrame, key: str, rg: str = RG) -> DataFrame:
    """A line for each row group: first and last key, rows."""
    return df.groupBy(rg).agg(F.min(key).alias("first_id"), F.max(key).alias("last_id"), F.count("*").alias("n_rows"))
