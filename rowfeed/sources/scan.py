"""Scan: one immutable description of a read, turned into one DataFrame expression.

Order of application: filters of the dataset, row groups (selector, shard), sub-split, predicate, transform, windows. Everything
up to a Python function the user passes stays with Catalyst, so columns and filters reach the Parquet reader. Where row groups
are those of the files, tasks read the chosen groups and columns only; a scan that needs no row groups prunes by partitions
and statistics.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowfeed.functions.predicates import Mask, Predicate, dnf, dnf_mask
from rowfeed.operators.batching import exact_tables
from rowfeed.operators.index import Selector
from rowfeed.operators.ngram import NGram
from rowfeed.operators.sampling import check_shard, epochs, in_read_order, part_of, shard, with_rows_after
from rowfeed.operators.transform import Transform
from rowfeed.schema import Field, Schema, match_names
from rowfeed.sources.decoding import batches_to_driver, decoded_rows
from rowfeed.sources.loading import ReadPlan, reachable
from rowfeed.sources.rowgroups import RG, GroupReader, in_groups, logical, manifest, partition_names, physical, prune, together, unused
from rowfeed.sources.urls import checked
from rowfeed.staging import qualified

#: Selected groups of a key that are read by ranges; more of them are joined.
MOST_GROUPS = 1000


@dataclass(frozen=True)
class Scan:
    """urls: a dataset or files. key, group_size: an integer key whose runs of that size are row groups; without them the
    files' own row groups are used where something needs them. fields: names, patterns or Field objects."""

    urls: str | Sequence[str]
    fields: Sequence[str | Field] | None = None
    key: str | None = None
    group_size: int | None = None
    predicate: Predicate | None = None
    filters: Sequence[Any] | None = None
    selector: Selector | None = None
    indexes: Mapping[str, DataFrame] = field(default_factory=dict)
    shard_index: int | None = None
    shard_count: int | None = None
    drop_parts: int = 1
    drop_part: int | None = None
    transform: Transform | None = None
    ngram: NGram | None = None
    seed: int | None = None
    shuffle_rows: bool = False
    num_epochs: int | None = 1

    def __post_init__(self) -> None:
        if (self.shard_index is None) != (self.shard_count is None):
            raise ValueError("a shard needs an index and a count")
        if self.num_epochs is not None and (not isinstance(self.num_epochs, int) or self.num_epochs < 1):
            raise ValueError("the number of epochs must be a positive integer, or None for endless ones")
        if self.ngram is not None and not self.ngram.overlap and self.drop_parts > 1:
            raise NotImplementedError("windows that don't overlap can't be combined with sub-splits")

    def where(self, **changes: Any) -> Scan:
        return replace(self, **changes)

    def schema(self, spark: SparkSession) -> Schema:
        return Schema.of(spark.read.parquet(*checked(self.urls)))

    def names(self, columns: Sequence[str]) -> list[str]:
        """What is read, in the dataset's order."""
        columns = [c for c in columns if c != RG]
        if self.fields is None:
            return columns
        plain = [f.name if isinstance(f, Field) else f for f in self.fields]
        unknown = [f.name for f in self.fields if isinstance(f, Field) and f.name not in columns]
        if unknown:
            raise ValueError(f"unknown fields {unknown}")
        chosen = {n for n in plain if n in columns} | set(match_names([p for p in plain if p not in columns], columns) if any(p not in columns for p in plain) else [])
        if not chosen:
            raise RuntimeError("no field is selected")
        return [c for c in columns if c in chosen]

    @property
    def keyed(self) -> bool:
        """Whether row groups are runs of a key, not those of the files."""
        return bool(self.key and self.group_size)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The scan as a DataFrame (without order; see `ordered`)."""
        df, names, _ = self._steps(spark)
        return df.select(*[f"`{n}`" for n in names])

    def ordered(self, spark: SparkSession, epoch: int = 0) -> DataFrame:
        """In the order in which a reader gives rows: by seed and epoch, else as they are. A transform or windows keep the order of row groups.

        Row groups of files are read in the seed's order, without a shuffle of rows; row groups of a key are sorted.
        """
        df, names, row = self._steps(spark, epoch)
        if self.seed is not None and RG in df.columns and self.keyed:
            df = in_read_order(df, row if row in df.columns else RG, self.seed, self.shuffle_rows, epoch)
        return df.select(*[f"`{n}`" for n in names])

    def _steps(self, spark: SparkSession, epoch: int | None = None) -> tuple[DataFrame, list[str], str]:
        """The rows with what their order needs, the names to give out, and the column that orders rows in a row group."""
        columns = spark.read.parquet(*checked(self.urls)).columns
        names = self.names(columns)
        if self.ngram is not None and self.transform is None:
            spec = self.ngram.resolve(columns)
            names = [c for c in columns if c == spec.ts or any(c in v for v in spec.fields.values())]
        used = {*names, *(self.predicate.fields() if self.predicate is not None else ()), *clause_fields(self.filters)}
        if self.predicate is not None:
            self.predicate.check(columns)
        df, row, place, left = self._rows(spark, columns, used, epoch)
        if self.drop_parts > 1:
            i, n = place
            more = self.ngram.length - 1 if self.ngram is not None else 0
            df = with_rows_after(df, i, n, self.drop_parts, more) if more else df.withColumn("part", part_of(i, n, self.drop_parts))
            df = df if self.drop_part is None else df.where(F.col("part") == self.drop_part)
        for p in left:
            df = p.filter(df)
        # Columns that go past the transform, under names of their own.
        row_at, rg_at, part_at = unused([*columns, *(self.transform.names(names) if self.transform is not None else ())], "_row", RG, "_part")
        beside = {row_at: row, rg_at: RG, part_at: "part" if self.drop_parts > 1 else None}
        beside = {to: c for to, c in beside.items() if c is not None and c in df.columns}
        df = df.select(*[f"`{n}`" for n in names], *[F.col(f"`{c}`").alias(to) for to, c in beside.items()])
        if self.transform is not None:
            df = self.transform.apply(df, list(beside) if self.ngram is not None or self.seed is not None else [])
            names = [n for n in df.columns if n not in beside]
        if self.ngram is not None:
            by = [RG, *(["part"] if self.drop_parts > 1 else [])]
            df = df.withColumnsRenamed({rg_at: RG, part_at: "part"})
            df = self.ngram.windows(df, by, [row_at]) if self.keyed else self.ngram.windows_as_read(df, by, [row_at])
            return df, [c for c in df.columns if c != "part"], RG
        return df, names, row_at

    def _rows(self, spark: SparkSession, columns: list[str], used: set[str], epoch: int | None) -> tuple[DataFrame, str | None, tuple[Column, Column] | None, list[Predicate]]:
        """Rows of the chosen row groups, the column that orders them in a group, each one's place in the group with the group's size, and the predicates that are left to apply.

        Of the files' row groups those are opened that the partitions and footers don't rule out; predicates that a task can run are run there,
        on their own columns first.
        """
        urls, window = checked(self.urls), Window.partitionBy(RG)
        left = self.predicate.conjuncts() if self.predicate is not None else []
        needs_rg = self.selector or self.shard_count or self.ngram or self.drop_parts > 1 or self.seed is not None
        if self.keyed:
            df = spark.read.parquet(*urls)
            df = df.where(dnf(self.filters)) if self.filters else df
            numbers = self.selector.numbers(self.indexes, MOST_GROUPS) if self.selector is not None else self._shard_numbers(spark) if self.shard_count is not None else None
            if numbers is not None:
                df = in_groups(df, self.key, self.group_size, numbers)
            else:
                df = logical(df, self.key, self.group_size)
                df = self.selector.rows(df, self.indexes) if self.selector is not None else df
            if self.shard_count is not None:
                df = shard(df, self.shard_index, self.shard_count)
            if self.drop_parts > 1 or self.ngram is not None:  # windows by row group: their columns are cut to what is used before rows move
                df = together(df.select(*[f"`{c}`" for c in columns if c in {*used, self.key}], *([RG] if RG not in columns else [])), spark.read.parquet(*urls).count())
            if self.drop_parts == 1:
                return df, self.key, None, left
            at, size = unused(columns, "_at", "_size")
            df = df.withColumns({at: F.row_number().over(window.orderBy(self.key)) - 1, size: F.count(F.lit(1)).over(window)})
            return df, self.key, (F.col(at), F.col(size)), left
        if not needs_rg:
            df = spark.read.parquet(*urls)
            return (df.where(dnf(self.filters)) if self.filters else df), self.key, None, left
        groups, left, schema = self._groups(spark, left)
        at, size = unused(columns, "_at", "_size")
        kinds = {f.name: f.dataType for f in schema}
        masks = [(p, p.mask(kinds)) for p in left]
        first, keep = sorted({n for p, m in masks if m is not None for n in p.fields()}), both([m for _, m in masks if m is not None])
        left = [p for p, m in masks if m is None]
        used = {*self.names(columns), *clause_fields(self.filters), *(n for p in left for n in p.fields())} if self.ngram is None else used
        df = physical(
            spark, *urls, columns=[c for c in columns if c in used], groups=groups, place=(at, size), first=first, keep=keep,
            order=None if self.seed is None or epoch is None else f"{self.seed}:{epoch}", shuffle=self.shuffle_rows and self.seed is not None and epoch is not None,
        )
        return (df.where(dnf(self.filters)) if self.filters else df), at, (F.col(at), F.col(size)), left

    def _shard_numbers(self, spark: SparkSession) -> list[int] | None:
        """The numbers of a key's row groups in the shard, by the footers' bounds of the key; None if there are too many, or footers don't tell."""
        if not all(reachable(qualified(spark, u)) for u in checked(self.urls)):
            return None
        found = manifest(spark, *checked(self.urls), bounds=[self.key])
        if "bounds" not in found.columns:
            return None
        low, high = F.col(f"bounds.`{self.key}`.low"), F.col(f"bounds.`{self.key}`.high")
        one = found.agg(F.min(low).alias("low"), F.max(high).alias("high"), F.sum((low.isNull() | high.isNull()).cast("int")).alias("unknown")).first()
        if one.low is None or one.unknown:
            return None
        # `div` cuts towards zero.
        first, last = (abs(x) // self.group_size * (1 if x >= 0 else -1) for x in (one.low, one.high))
        check_shard(self.shard_index, self.shard_count)  # of a key's runs some shards may be empty: their number is the caller's choice
        if (last - first) // self.shard_count > MOST_GROUPS:
            return None
        return [n for n in range(first, last + 1) if n % self.shard_count == self.shard_index]

    def _groups(self, spark: SparkSession, predicates: list[Predicate]) -> tuple[DataFrame, list[Predicate], T.StructType]:
        """The files' row groups that are to be read, the predicates that rows still have to pass, and the schema."""
        urls = checked(self.urls)
        asked = {*clause_fields(self.filters), *(n for p in predicates for n in p.fields())}
        schema, groups = spark.read.parquet(*urls).schema, manifest(spark, *urls, bounds=sorted(asked))
        total = groups.count() if self.shard_count is not None else None
        groups, left = prune(groups, schema, predicates, self.filters)
        if self.selector is not None:
            groups = self.selector.rows(groups, self.indexes)
        if self.shard_count is not None:
            groups = shard(groups, self.shard_index, self.shard_count, groups=total)
        return groups, left, schema

    def plan(self, spark: SparkSession) -> ReadPlan | None:
        """What a process needs to read the scan's row groups itself; None if only Spark can read it.

        That is so with a transform, windows, sub-splits, row groups of a key, predicates of columns, or files that Arrow's file systems don't reach.
        """
        if self.transform is not None or self.ngram is not None or self.drop_parts > 1 or self.keyed:
            return None
        schema = spark.read.parquet(*checked(self.urls)).schema
        kinds, predicates = {f.name: f.dataType for f in schema}, self.predicate.conjuncts() if self.predicate is not None else []
        if self.predicate is not None:
            self.predicate.check(schema.names)
        if not all(reachable(qualified(spark, u)) for u in checked(self.urls)) or self.filters and dnf_mask(self.filters, kinds) is None:
            return None
        groups, left, schema = self._groups(spark, predicates)
        masks = [p.mask(kinds) for p in left]
        if any(m is None for m in masks):
            return None
        first = {n for p in left for n in p.fields()}
        if self.filters:
            masks, first = [*masks, dnf_mask(self.filters, kinds)], first | clause_fields(self.filters)
        parts = partition_names(groups)
        reader = GroupReader.of(schema, parts, self.names(schema.names), sorted(first), both(masks), None)
        rows = groups.select(RG, "path", "group", "bytes", *[F.col(f"parts.`{n}`").alias(f"part{k}") for k, n in enumerate(parts)]).toArrow().sort_by(RG)
        return ReadPlan(reader, rows, self.seed, self.shuffle_rows)

    def plans(self, spark: SparkSession, count: int) -> list[ReadPlan]:
        """A plan for each of `count` processes: shards, which have no row group in common. They can be sent there (`ReadPlan.dumps`)."""
        found = [self.where(shard_index=i, shard_count=count).plan(spark) for i in range(count)]
        if any(p is None for p in found):
            raise NotImplementedError("only Spark can read this scan")
        return found

    def with_epochs(self, spark: SparkSession) -> DataFrame:
        if self.num_epochs is None:
            raise ValueError("endless epochs are no DataFrame; iterate instead")
        return epochs(self.frame(spark), self.num_epochs)

    def _epochs(self, read: Callable[[int], Iterator[Any]]) -> Iterator[Any]:
        """What `read` gives for each epoch; ends with a warning if the first gives nothing."""
        epoch, some = 0, False
        while self.num_epochs is None or epoch < self.num_epochs:
            for item in read(epoch):
                some = True
                yield item
            if not some:
                warnings.warn("the scan gave no rows", stacklevel=2)
                return
            epoch += 1

    def rows(self, spark: SparkSession) -> Iterator[Row]:
        """Rows to the driver as Spark has them, one partition at a time, epoch after epoch."""
        yield from self._epochs(lambda epoch: self.ordered(spark, epoch).toLocalIterator(prefetchPartitions=True))

    def decoded(self, spark: SparkSession, schema: Schema) -> Iterator[dict[str, Any]]:
        """Rows as dicts of numpy and Python values. This process reads the row groups if it can (`plan`); else tasks read and decode them."""
        plan = self.plan(spark)
        yield from self._epochs(lambda epoch: plan.rows(schema, epoch) if plan is not None else decoded_rows(self.ordered(spark, epoch), schema))

    def tables(self, spark: SparkSession, size: int = 10_000) -> Iterator[pa.Table]:
        """Arrow tables, read here if this process can, else brought to it by Spark."""
        plan = self.plan(spark)
        yield from self._epochs(lambda epoch: exact_tables((pa.Table.from_batches([b]) for b in batches_to_driver(self.ordered(spark, epoch))) if plan is None else plan.tables(epoch), size))


def both(masks: list[Mask]) -> Mask | None:
    """Rows that all masks keep."""
    return (lambda table: np.logical_and.reduce([m(table) for m in masks])) if masks else None


def clause_fields(filters: Sequence[Any] | None) -> set[str]:
    """The columns of (column, operator, value) clauses."""
    groups = [filters] if filters and isinstance(filters[0], tuple) else filters or []
    return {name for g in groups for name, _, _ in g}


class Reader:
    """Iterates a scan as decoded rows; a context manager; `reset` starts again once all rows are read."""

    def __init__(self, spark: SparkSession, scan: Scan, decode: bool) -> None:
        self.spark, self.scan, self.decode = spark, scan, decode
        self.schema = scan.schema(spark)
        self.last_row_consumed = False
        self._rows = self._start()

    def _start(self) -> Iterator[Any]:
        return self.scan.decoded(self.spark, self.schema) if self.decode else self.scan.rows(self.spark)

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *error: object) -> None:
        self.stop()

    def __iter__(self) -> Reader:
        return self

    def __next__(self) -> Any:
        try:
            return next(self._rows)
        except StopIteration:
            self.last_row_consumed = True
            raise

    def reset(self) -> None:
        if not self.last_row_consumed:
            raise NotImplementedError("a reader can only start again after its last row")
        self._rows, self.last_row_consumed = self._start(), False

    def stop(self) -> None:
        self._rows.close()

    def diagnostics(self) -> dict[str, Any]:
        return {"plan": self.scan.frame(self.spark)._jdf.queryExecution().simpleString()}


def read_rows(spark: SparkSession, url: str, **options: Any) -> Reader:
    """Decoded rows of a dataset with a declared schema."""
    reader = Reader(spark, Scan(url, **options), decode=True)
    if not any("rowfeed" in (f.metadata or {}) for f in spark.read.parquet(*checked(url)).schema):
        warnings.warn("the dataset declares no schema; read_batches reads plain Parquet", stacklevel=2)
    return reader


def read_batches(spark: SparkSession, urls: str | Sequence[str], size: int = 10_000, **options: Any) -> Iterator[pa.Table]:
    """Arrow tables of plain Parquet. Windows of rows aren't batches."""
    if options.get("ngram") is not None:
        raise NotImplementedError("windows are given as rows, not as batches")
    return Scan(urls, **options).tables(spark, size)


def dataset_rdd(spark: SparkSession, url: str, fields: Sequence[str] | None = None):  # noqa: ANN201
    """Decoded rows as an RDD of dicts, for code that needs one."""
    df = Scan(url, fields).frame(spark)
    schema = Schema.of(df)
    return df.rdd.map(schema.decode)
