"""Writing datasets: per-write options, a schema in column metadata, a manifest beside the data. No session setting is changed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import Any
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowfeed.functions.predicates import not_null
from rowfeed.operators.index import IndexSpec, build_indexes, compact, stats
from rowfeed.schema import Schema, match_names
from rowfeed.session import share_code
from rowfeed.sources.rowgroups import created, manifest, moved, physical
from rowfeed.staging import qualified

#: Names that Spark's readers pass over.
SIDE, INDEXES = "_rowfeed", "_rowfeed_index"
#: Row groups of a file: a reader parses a footer of all of them, whichever it reads.
GROUPS_A_FILE = 256


def write(df: DataFrame, path: str, schema: Schema | None = None, row_group_mb: float | None = None, codec: str | None = None, partition_by: Sequence[str] = (), files: int | None = None, mode: str = "error", checked: bool = True) -> DataFrame:
    """Write and return the data read back. With a schema the columns get its metadata, and it is read back once to check it."""
    if schema is not None:
        df = df.select(*[F.col(f"`{n}`").alias(n, metadata=f.spark().metadata) for n, f in schema.fields.items()])
    out = (df.repartition(files) if files else df).write.mode(mode)
    if row_group_mb is not None:
        out = out.option("parquet.block.size", int(row_group_mb * 1024 * 1024))
    if codec is not None:
        out = out.option("compression", codec)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    back = df.sparkSession.read.parquet(path)
    if schema is not None:
        put_side(df.sparkSession, path, {"schema": schema_json(schema)})
        if checked and set(back.columns) != set(schema.fields):
            raise RuntimeError(f"columns {back.columns} were written, declared are {list(schema.fields)}")
    return back


def write_groups(df: DataFrame, path: str, by: str, order: Sequence[str] = (), partition_by: str | None = None) -> DataFrame:
    """Write with a row group of its own for each value of `by`, its rows in `order`, and return the data read back. `by` and `partition_by` aren't in the files.

    Row groups lie in files, and files by name, in the order of `by`; with `partition_by` they do so in each folder. A file has up to GROUPS_A_FILE row groups, so there
    are as many files as row groups over that number, and one more for each task and folder. A row group is held in a task's memory. A task writes under a name that readers
    pass over and renames the whole file, so an attempt that is made again replaces its files.
    """
    home = qualified(df.sparkSession, path)
    keys = [*([partition_by] if partition_by is not None else []), by]
    inside = [c for c in df.columns if c not in keys]
    laid = df.repartitionByRange(*[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in (*keys, *order)])
    laid = laid.select(*[F.col(f"`{c}`") for c in inside], *[F.col(f"`{k}`").cast("string").alias(f"_key{i}") for i, k in enumerate(keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, rows = TaskContext.get().partitionId(), 0, 0
        for folder, groups in _files(_groups(batches, len(inside))):
            place = f"{home}/{folder}part-{part:05d}-{files:05d}.parquet"
            hidden = f"{home}/{folder}_{uuid.uuid4().hex}"
            with created(hidden) as f:
                writer = None
                for table in groups:
                    writer = writer or pq.ParquetWriter(f, table.schema)
                    writer.write_table(table, row_group_size=len(table))
                    rows += len(table)
                writer.close()
            moved(hidden, place)
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64()), pa.array([rows], pa.int64())], names=["files", "rows"])

    def _groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[str, pa.Table]]:
        """(folder, the rows of a value of `by`)"""
        now, held = None, []
        for batch in batches:
            keys_of = list(zip(*(batch.column(i).to_pylist() for i in range(n, batch.num_columns)), strict=True))
            cuts = [0, *(k for k in range(1, len(keys_of)) if keys_of[k] != keys_of[k - 1]), len(keys_of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and keys_of[a] != now:
                    yield folder_of(now), pa.Table.from_batches(held).combine_chunks()
                    held = []
                now = keys_of[a]
                held.append(batch.slice(a, b - a).select(range(n)))
        if held:
            yield folder_of(now), pa.Table.from_batches(held).combine_chunks()

    def folder_of(key: tuple) -> str:
        return f"{partition_by}={quote(key[0], safe='') if key[0] is not None else '__HIVE_DEFAULT_PARTITION__'}/" if partition_by is not None else ""

    share_code(df.sparkSession)
    if not laid.mapInArrow(run, "files bigint, rows bigint").agg(F.sum("rows")).first()[0]:
        laid.select(*[F.col(f"`{c}`") for c in inside]).write.mode("append").parquet(path)  # a file that has the schema
    return df.sparkSession.read.parquet(path)


def _files(groups: Iterator[tuple[str, pa.Table]]) -> Iterator[tuple[str, Iterator[pa.Table]]]:
    """(folder, tables of up to GROUPS_A_FILE row groups of it), which have to be taken in turn."""
    ahead = next(groups, None)

    def of_file(folder: str) -> Iterator[pa.Table]:
        nonlocal ahead
        for _ in range(GROUPS_A_FILE):
            if ahead is None or ahead[0] != folder:
                return
            yield ahead[1]
            ahead = next(groups, None)

    while ahead is not None:
        yield ahead[0], of_file(ahead[0])


def write_rows(spark: SparkSession, path: str, schema: Schema, rows: Iterable[Mapping[str, Any]], **options: Any) -> DataFrame:
    """Validate, encode and write rows from the driver."""
    return write(schema.frame(spark, rows), path, schema, **options)


def schema_json(schema: Schema) -> list[dict[str, Any]]:
    return [{"name": f.name, "dtype": f.dtype, "shape": [-1 if d is None else d for d in f.shape], "codec": f.encoding.name(), "nullable": f.nullable} for f in schema.fields.values()]


def schema_from(name: str, fields: Sequence[Mapping[str, Any]]) -> Schema:
    from rowfeed.functions.codecs import codec_of
    from rowfeed.schema import Field

    return Schema(name, [Field(f["name"], f["dtype"], tuple(None if d < 0 else d for d in f["shape"]), codec_of(f["codec"]), f["nullable"]) for f in fields])


def put_side(spark: SparkSession, path: str, entries: Mapping[str, Any]) -> None:
    """Add or replace entries of the JSON beside the data; others stay."""
    known = get_side(spark, path) | dict(entries)
    text = spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1)
    text.write.mode("overwrite").text(f"{path}/{SIDE}")


def get_side(spark: SparkSession, path: str) -> dict[str, Any]:
    if not exists(spark, f"{path}/{SIDE}"):
        return {}
    # The folder's name hides it from a read of the dataset, so its files are named.
    rows = spark.read.format("text").load(f"{path}/{SIDE}/part-*").collect()
    return json.loads(rows[0].value) if rows else {}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def delete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))


def attach(spark: SparkSession, path: str, schema: Schema) -> None:
    """Declare the schema of Parquet that is there already; other entries stay."""
    put_side(spark, path, {"schema": schema_json(schema)})


def stored_schema(spark: SparkSession, path: str) -> Schema:
    """As declared beside the data or in the columns, else inferred."""
    side = get_side(spark, path)
    return schema_from("stored", side["schema"]) if "schema" in side else Schema.of(spark.read.parquet(path))


def copy(spark: SparkSession, source: str, target: str, fields: Sequence[str] | None = None, not_null_fields: Sequence[str] = (), overwrite: bool = False, files: int | None = None, row_group_mb: float | None = None) -> DataFrame:
    """Copy columns by pattern and rows without nulls."""
    df = spark.read.parquet(source)
    names = match_names(fields, df.columns)
    if not names:
        raise ValueError(f"no field matches {fields}")
    if not_null_fields:
        df = df.where(not_null(not_null_fields))
    return write(df.select(*[f"`{n}`" for n in names]), target, row_group_mb=row_group_mb, codec="none", files=files, mode="overwrite" if overwrite else "error")


def store_indexes(spark: SparkSession, path: str, specs: Sequence[IndexSpec]) -> None:
    """Build indexes over the files' row groups and keep them beside the data."""
    for name, entries in build_indexes(physical(spark, path), specs).items():
        compact(entries).write.mode("overwrite").parquet(f"{path}/{INDEXES}/{name}")
    put_side(spark, path, {"indexes": sorted({*get_side(spark, path).get("indexes", []), *(s.name for s in specs)}), "row_groups": manifest(spark, path).count()})


def load_indexes(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """(value, rg) of each stored index."""
    return {n: spark.read.parquet(f"{path}/{INDEXES}/{n}").select("value", F.explode("rgs").alias("rg")) for n in get_side(spark, path).get("indexes", [])}


def describe(spark: SparkSession, path: str, schema: bool = True, index: bool = True, values: bool = False) -> str:
    """The stored schema and, of each index, how many values and row groups it has."""
    out = [repr(stored_schema(spark, path))] if schema else []
    for name, entries in load_indexes(spark, path).items() if index else ():
        one = entries.agg(F.countDistinct("value").alias("v"), F.countDistinct("rg").alias("g")).first()
        out.append(f"Index {name}: {one.v} values in {one.g} row groups")
        if values:
            out += [f"  {r.value}: {r.n_rg}" for r in stats(entries).orderBy("value").toLocalIterator()]
    return "\n".join(out)
