"""Scans, filters, time windows and n-grams over files that keep arriving."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rowfeed.functions.predicates import Predicate, dnf
from rowfeed.operators.transform import Transform


def stream(spark: SparkSession, path: str, fields: Sequence[str] | None = None, predicate: Predicate | None = None, filters: Sequence[Any] | None = None, transform: Transform | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files as a stream, with the same pruning, predicates and transforms as a scan."""
    schema = spark.read.parquet(path).schema
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    if filters:
        df = df.where(dnf(filters))
    if predicate is not None:
        df = predicate.filter(df)
    if fields is not None:
        df = df.select(*[f"`{n}`" for n in fields])
    return transform.apply(df) if transform is not None else df


def unique(df: DataFrame, keys: Sequence[str], ts: str, lateness: str) -> DataFrame:
    """The first row of each key; keys are forgotten when the watermark has passed."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


def tumbling(df: DataFrame, ts: str, size: str, lateness: str, by: Sequence[str], value: str) -> DataFrame:
    """Count and sum by window; a window is given once, when it can get no more rows."""
    return df.withWatermark(ts, lateness).groupBy(F.window(ts, size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sliding(df: DataFrame, ts: str, size: str, step: str, lateness: str, by: Sequence[str], value: str) -> DataFrame:
    return df.withWatermark(ts, lateness).groupBy(F.window(ts, size, step), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(df: DataFrame, ts: str, gap: str, lateness: str, by: Sequence[str]) -> DataFrame:
    return df.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))


#: The store that timers need; set it as spark.sql.streaming.stateStore.providerClass before the query starts.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Pairs(StatefulProcessor):
    """Of a key: rows the watermark hasn't passed, in no order, and the last row it has passed."""

    def __init__(self, threshold_ms: int, kind: str) -> None:
        self.threshold, self.kind = threshold_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", f"at bigint, item {self.kind}")
        self.last = handle.getValueState("last", f"at bigint, item {self.kind}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        taken = []
        for frame in rows:
            taken += list(zip(frame["ms"].tolist(), frame["item"].tolist(), strict=True))
        if taken:
            self.open.appendList(taken)
            self._wake(min(t for t, _ in taken), timerValues.getCurrentWatermarkInMs())
        return iter(())  # a frame for each key, even an empty one, costs more than the rows

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.open.get())
        done, wait = [r for r in rows if r[0] < now], [r for r in rows if r[0] >= now]
        known = self.last.get()
        last, out = known, []
        for at, item in done:
            if last is not None and at - last[0] <= self.threshold:
                out.append((key[0], last[1], item, at - last[0]))
            last = (at, item)
        if wait:
            self.open.put(wait)
            self._wake(wait[0][0], now)
        else:
            self.open.clear()
        if last is not None and last[0] + self.threshold >= now:
            self.last.update(tuple(last))
            self._wake(last[0] + self.threshold, now)
        elif known is not None:  # no row to come can be near enough
            self.last.clear()
        return iter([pd.DataFrame(out, columns=["key", "first", "second", "gap_ms"])] if out else [])

    def _wake(self, at: int, now: int) -> None:
        """A timer for when the watermark has passed a time."""
        self.handle.registerTimer(max(at, now) + 1)

    def close(self) -> None:
        pass


def pairs(df: DataFrame, key: str, ts: str, item: str, threshold_ms: int, lateness: str) -> DataFrame:
    """(key, first, second, gap_ms): neighbours in time of a key no further apart than the threshold, across micro-batches.

    Rows may come in any order until the watermark passes them: they wait in the state, and are put in order of (time, item) when a
    timer fires. A row that comes later than that is dropped, as by any operator with a watermark. A key is forgotten when the watermark has
    passed its last row by more than the threshold. Times count in milliseconds. Rows that no later row's watermark passes wait for it.
    """
    if df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise RuntimeError(f"timers need spark.sql.streaming.stateStore.providerClass={ROCKSDB}")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    # Milliseconds as watermarks count them, whatever the session's time zone.
    rows = df.withWatermark(ts, lateness).select(F.col(key).alias("key"), F.col(ts).alias("at"), F.unix_millis(ts).alias("ms"), F.col(item).alias("item"))
    made = _Pairs(threshold_ms, kinds[item])
    return rows.groupBy("key").transformWithStateInPandas(made, f"key {kinds[key]}, first {kinds[item]}, second {kinds[item]}, gap_ms bigint", "Append", "EventTime")


def near_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, before: str, after: str, left_lateness: str, right_lateness: str, how: str = "inner") -> DataFrame:
    """Pairs of rows of two streams with equal keys, the right one's time from `before` before the left one's to `after` after it.

    Both sides wait in the state until the watermark, the lesser of both sides', has passed all times that could match, and are forgotten then; an outer join
    gives rows without a match at that point. Rows behind the watermark are dropped, on either side. Columns that both sides have are the
    left's, and the right's with `_right`.
    """
    names = {c: c if c not in left.columns else f"{c}_right" for c in right.columns}
    other = right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    a, b = left.withWatermark(left_ts, left_lateness), other.withWatermark(names[right_ts], right_lateness)
    met = F.col(f"`{names[right_ts]}`").between(F.col(f"`{left_ts}`") - F.expr(f"INTERVAL {before}"), F.col(f"`{left_ts}`") + F.expr(f"INTERVAL {after}"))
    for k in keys:
        met = met & (F.col(f"`{k}`") == F.col(f"`{names[k]}`"))
    return a.join(b, met, how)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all files that are there, to Parquet, and read it; a further call takes up the new ones only."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(path)
