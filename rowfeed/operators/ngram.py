"""Windows of consecutive rows by time: every gap at most a threshold, sliding or not overlapping, within a partition."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rowfeed.operators.prefix import MOST_ROWS, alike, hottest, in_blocks
from rowfeed.schema import match_names
from rowfeed.session import share_code
from rowfeed.sources.rowgroups import RG, unused


@dataclass(frozen=True)
class NGram:
    """fields: step -> names or patterns. Steps without an entry between the least and the largest still take a row.

    threshold: the largest gap between neighbours, in the units of `ts`. The window's rows lie in one partition (a row
    group, or any key) in order of ts; `tie` orders rows of equal time. overlap=False takes windows from left to right, each
    beginning after the end of the last.
    """

    fields: Mapping[int, Sequence[str]]
    threshold: int | float
    ts: str
    overlap: bool = True

    def __post_init__(self) -> None:
        if not self.fields or not all(isinstance(k, int) and not isinstance(k, bool) for k in self.fields):
            raise ValueError("fields must map integers to lists of names")
        if not all(isinstance(v, (list, tuple)) for v in self.fields.values()):
            raise ValueError("each step needs a list of names")
        if self.threshold is None or isinstance(self.threshold, bool) or not isinstance(self.threshold, (int, float)):
            raise ValueError("the threshold must be a number")

    @property
    def length(self) -> int:
        return max(self.fields) - min(self.fields) + 1

    def resolve(self, names: Sequence[str]) -> NGram:
        """With patterns replaced by the names they match."""
        def find(pattern: str) -> list[str]:
            return [pattern] if pattern in names else match_names([pattern], names)

        ts = find(self.ts)
        if len(ts) != 1:
            raise ValueError(f"{self.ts} must match one field, not {ts}")
        fields = {}
        for step, patterns in self.fields.items():
            if missing := [p for p in patterns if not find(p)]:
                raise ValueError(f"no field matches {missing}")
            found = {n for p in patterns for n in find(p)}
            fields[step] = [n for n in names if n in found]
        return NGram(fields, self.threshold, ts[0], self.overlap)

    def windows(self, df: DataFrame, by: str | Sequence[str] = RG, tie: Sequence[str] = ()) -> DataFrame:
        """`by` columns, `start_ts`, `end_ts` and a struct `t_<k>` (`t_m<k>` for negative steps) for each step with fields.

        Rows without a time come first, and their gaps don't count; a window may begin with some if windows overlap, but not end with one.
        """
        spec, by = self.resolve(df.columns), [by] if isinstance(by, str) else list(by)
        w = Window.partitionBy(*by).orderBy(spec.ts, *tie)
        ts, last, base = F.col(f"`{spec.ts}`"), spec.length - 1, min(spec.fields)
        gap = F.lead(ts).over(w) - ts
        inner = w.rowsBetween(0, last - 1)
        steps = [F.lead(F.struct(*[f"`{n}`" for n in spec.fields[k]]), k - base).over(w).alias(step_name(k)) for k in sorted(spec.fields) if spec.fields[k]]
        end = F.lead(ts, last).over(w)
        out = df.withColumn("_gap", gap)
        fits = F.lit(True) if last == 0 else F.max("_gap").over(inner) <= F.lit(spec.threshold)
        kept = out.select(*by, ts.alias("start_ts"), end.alias("end_ts"), *[F.col(t) for t in tie if t not in by], *steps, fits.alias("_fits"))
        kept = kept.where(F.col("_fits") & F.col("end_ts").isNotNull()).drop("_fits")
        if not spec.overlap and last >= 0:
            kept = greedy(kept.where(F.col("start_ts").isNotNull()), by, tie)
        return kept.select(*by, "start_ts", "end_ts", *[s for s in kept.columns if s.startswith("t_")])

    def windows_spread(self, df: DataFrame, by: str | Sequence[str], tie: Sequence[str] = (), size: int | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
        """`windows` of keys that may hold any share of the rows: overlapping ones, of rows in blocks by (key, time), whoever's they are.

        A block gets copies of the next length - 1 rows, so that windows which begin in it can end. Without a block's size, and with no key of more than
        `most_rows` rows, these are Spark's own windows.
        """
        spec, by = self.resolve(df.columns), [by] if isinstance(by, str) else list(by)
        if not spec.overlap:
            raise NotImplementedError("windows that don't overlap are taken one after the other within a key")
        if size is None and hottest(df, by) <= most_rows:
            return self.windows(df, by, tie)
        last, base = spec.length - 1, min(spec.fields)
        b = in_blocks(df, [*by, spec.ts, *tie], after=last, size=size)
        w = Window.partitionBy(b.block).orderBy(b.pos)
        ts, gap = F.col(f"`{spec.ts}`"), unused(b.rows.columns, "_gap")[0]
        rows = b.rows.withColumn(gap, F.lead(ts).over(w) - ts)
        fits = F.lit(True) if last == 0 else (F.max(gap).over(w.rowsBetween(0, last - 1)) <= F.lit(spec.threshold)) & alike([F.lead(F.col(f"`{n}`"), last).over(w) for n in by], [F.col(f"`{n}`") for n in by])
        steps = [F.lead(F.struct(*[f"`{n}`" for n in spec.fields[k]]), k - base).over(w).alias(step_name(k)) for k in sorted(spec.fields) if spec.fields[k]]
        kept = rows.select(*by, ts.alias("start_ts"), F.lead(ts, last).over(w).alias("end_ts"), *steps, (F.col(b.own) & fits).alias(gap))
        return kept.where(F.col(gap) & F.col("end_ts").isNotNull()).drop(gap)

    def windows_as_read(self, df: DataFrame, by: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
        """`windows` of rows that lie together by `by[0]`, as tasks read row groups: each task makes those of its own, without a shuffle.

        A row group of that number has to be in one partition, one row after the other; it is held in memory, as it was when it was read.
        """
        spec, by = self.resolve(df.columns), list(by)
        schema = spec.windows(df, by, tie).schema
        kinds = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                numbers = batch.column(by[0]).to_numpy()
                cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if held and held[0].column(by[0])[0].as_py() != numbers[a]:
                        yield from spec.of_group(pa.Table.from_batches(held), by, tie, kinds)
                        held = []
                    held.append(batch.slice(a, b - a))
            if held:
                yield from spec.of_group(pa.Table.from_batches(held), by, tie, kinds)

        share_code(df.sparkSession)
        return df.mapInArrow(run, schema)

    def of_group(self, rows: pa.Table, by: Sequence[str], tie: Sequence[str], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Windows of a group's rows, for each value of the further columns in `by` apart."""
        rows = rows.combine_chunks()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in [*by, self.ts, *tie]], null_placement="at_start"))
        part = np.zeros(len(rows), dtype=bool)
        for c in by[1:]:
            v = rows[c].to_numpy()
            part[1:] |= v[1:] != v[:-1]
        ts, last = rows[self.ts], self.length - 1
        known = ts.is_valid().to_numpy()
        x = pc.fill_null(ts, 0).to_numpy() if not known.all() else ts.to_numpy()
        both = known[1:] & known[:-1]
        cut = part[1:] | (both & (x[1:] - x[:-1] > self.threshold))
        before = np.concatenate([[0], np.cumsum(cut)])
        told = np.concatenate([[0], np.cumsum(both)])
        starts = np.arange(max(0, len(rows) - last))
        fits = (before[starts + last] == before[starts]) & known[starts + last]
        if last:
            fits &= told[starts + last] > told[starts]
        starts = starts[fits]
        if not self.overlap:
            taken, end, now = [], None, None
            group, starts = np.cumsum(part), starts[known[starts]]
            for s in starts.tolist():
                if group[s] != now or end is None or x[s] > end:
                    taken.append(s)
                    now, end = group[s], x[s + last]
            starts = np.array(taken, dtype=np.int64)
        if len(starts) == 0:
            return
        base, out = min(self.fields), []
        for f in kinds:
            if f.name in by:
                out.append(rows[f.name].take(pa.array(starts)).combine_chunks())
            elif f.name in ("start_ts", "end_ts"):
                out.append(ts.take(pa.array(starts + (last if f.name == "end_ts" else 0))).combine_chunks())
            else:
                k = next(k for k in self.fields if step_name(k) == f.name)
                at = rows.take(pa.array(starts + k - base)).combine_chunks()
                out.append(pa.StructArray.from_arrays([one(at[n]) for n in self.fields[k]], fields=list(f.type)))
        yield from pa.Table.from_arrays([one(c).cast(f.type) for c, f in zip(out, kinds, strict=True)], schema=kinds).to_batches(max_chunksize=10_000)

    def flatten(self, windows: DataFrame) -> DataFrame:
        """Columns `<field>_<i>`, i the place of the step among the sorted steps."""
        out = []
        for i, k in enumerate(sorted(self.fields)):
            name = step_name(k)
            if name in windows.columns:
                out += [F.col(f"{name}.`{f.name}`").alias(f"{f.name}_{i}") for f in windows.schema[name].dataType]
        return windows.select(*out)


def one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def step_name(k: int) -> str:
    return f"t_m{-k}" if k < 0 else f"t_{k}"


def greedy(candidates: DataFrame, by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Of windows in order, those that start after the end of the last one taken.

    Candidates are sorted within the partitioning they have from the windows before, and a task takes them as a stream with one
    partition's last end in memory, so a partition of any size is linear.
    """
    order, by = ["start_ts", *[t for t in tie if t not in by]], list(by)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in by), strict=True)) if by else [()] * batch.num_rows
            taken = []
            for i, (key, a, b) in enumerate(zip(keys, batch.column("start_ts").to_pylist(), batch.column("end_ts").to_pylist(), strict=True)):
                if key != now or end is None or a > end:
                    taken.append(i)
                    now, end = key, b
            if taken:
                yield batch.take(pa.array(taken))

    share_code(candidates.sparkSession)
    return candidates.sortWithinPartitions(*by, *order).mapInArrow(take, candidates.schema)
