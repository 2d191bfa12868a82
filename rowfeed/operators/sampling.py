"""Shards, sub-splits, seeded order, epochs, bounded shuffles and weighted mixes.

Order comes from hashes of (seed, epoch, key), not from a generator's state, so results don't depend on how rows lie in
partitions. Seed 0 is a seed like any other.
"""

from __future__ import annotations

import bisect
import itertools
from collections import deque
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowfeed.functions.hashing import order_key, uniform
from rowfeed.sources.rowgroups import RG, numbered


class NoDataError(RuntimeError):
    """A shard would have no row group."""


def shard(df: DataFrame, index: int, count: int, rg: str = RG, groups: int | None = None) -> DataFrame:
    """Row groups whose number is `index` modulo `count`: a filter on a column, without a shuffle."""
    check_shard(index, count, groups)
    return df.where(F.pmod(F.col(rg), F.lit(count)) == index)


def check_shard(index: int, count: int, groups: int | None = None) -> None:
    """Whether there is such a shard; of more shards than row groups some would be empty."""
    for v in (index, count):
        if not isinstance(v, int) or isinstance(v, bool):
            raise ValueError("shard index and count must be integers")
    if count < 1 or not 0 <= index < count:
        raise ValueError(f"shard {index} of {count}")
    if groups is not None and count > groups:
        raise NoDataError(f"{count} shards of {groups} row groups")


def part_of(i: Column, n: Column, parts: int) -> Column:
    """The part of row i of a row group of n: floor(i / (n / min(n, parts))), computed in doubles."""
    n = n.cast("double")
    return F.floor(i.cast("double") / (n / F.least(n, F.lit(float(parts))))).cast("bigint")


def row_drop(df: DataFrame, parts: int, order: Sequence[str], rg: str = RG) -> DataFrame:
    """`part` of each row, rows numbered in the order within their row group."""
    if parts < 1:
        raise ValueError("parts must be positive")
    w = Window.partitionBy(rg)
    return df.withColumn("part", part_of(F.row_number().over(w.orderBy(*order)) - 1, F.count(F.lit(1)).over(w), parts))


def with_rows_after(df: DataFrame, i: Column, n: Column, parts: int, more: int) -> DataFrame:
    """`part` of each row, and a copy of each part's next `more` rows in that part, so that windows which begin in a part can end."""
    own = part_of(i, n, parts)

    def begins(part: Column) -> Column:
        """The first row of a part: about part * n / min(n, parts), put right where doubles round."""
        guess = F.ceil(part * (n.cast("double") / F.least(n, F.lit(parts)))).cast("bigint")
        return F.when((guess > 0) & (part_of(guess - 1, n, parts) >= part), guess - 1).when(part_of(guess, n, parts) < part, guess + 1).otherwise(guess)

    copies = F.filter(F.sequence(F.greatest(F.lit(0).cast("bigint"), own - more), own), lambda q: (q == own) | (i < begins(q + 1) + more))
    return df.withColumn("part", F.explode(copies))


def rank_rowgroups(df: DataFrame, seed: int, epoch: int = 0, rg: str = RG) -> DataFrame:
    """(rg, rg_rank): the order in which row groups are read."""
    groups = df.select(rg).distinct()
    return groups.withColumn("rg_rank", F.row_number().over(Window.orderBy(order_key(f"{seed}:{epoch}", F.col(rg)))).cast("bigint"))


def rank_rows(df: DataFrame, seed: int, key: str, epoch: int = 0, rg: str = RG) -> DataFrame:
    """`row_rank`: the order of rows inside their row group."""
    w = Window.partitionBy(rg).orderBy(order_key(f"{seed}:{epoch}", F.col(key)), key)
    return df.withColumn("row_rank", F.row_number().over(w).cast("bigint"))


def in_read_order(df: DataFrame, key: str, seed: int | None = None, shuffle_rows: bool = False, epoch: int = 0, rg: str = RG) -> DataFrame:
    """Rows sorted as a reader gives them: natural order without a seed, else row groups (and rows in them) by hash."""
    if seed is None:
        return df.orderBy(rg, key)
    row = order_key(f"{seed}:{epoch}", F.col(key)) if shuffle_rows else F.col(key)
    return df.orderBy(order_key(f"{seed}:{epoch}", F.col(rg)), F.col(rg), row, F.col(key))


def bounded_shuffle(df: DataFrame, capacity: int, seed: int, key: str, order: Sequence[str] | None = None) -> DataFrame:
    """`pos` and `shuffled_pos`: a row moves by less than `capacity` places, as through a buffer of that size."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    placed = numbered(df, list(order or [key]), "pos")
    placed = placed.withColumn("_to", F.col("pos") + F.floor(uniform(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))) * capacity).cast("bigint"))
    return numbered(placed, ["_to", "pos"], "shuffled_pos").drop("_to")


def epochs(df: DataFrame, n: int) -> DataFrame:
    """`epoch` 0 .. n - 1, each with all rows; the rows are copied where they are, without a shuffle."""
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError("the number of epochs must be a positive integer; iterate for endless ones")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))


def inmem_epochs(df: DataFrame, capacity: int, n: int, seed: int, key: str) -> DataFrame:
    """The first `capacity` rows by key, in an order of its own in each of n epochs (`epoch_rank`)."""
    held = df.orderBy(key).limit(capacity)
    w = Window.partitionBy("epoch").orderBy(F.md5(F.concat_ws(":", (F.lit(seed) + F.col("epoch")).cast("string"), F.col(key).cast("string")).cast("binary")), key)
    return epochs(held, n).withColumn("epoch_rank", F.row_number().over(w).cast("bigint"))


def weighted_mix(frames: Sequence[DataFrame], weights: Sequence[float], seed: int, keys: Sequence[str]) -> DataFrame:
    """`slot`, `source` and the sources' columns (which must agree): slot n takes the next row of a source drawn by weight.

    The mix ends at the first slot whose source has no row left. Slots are drawn by hash, so the plan is a range, a
    number within each source, and a join; `keys` orders each source.
    """
    if len(frames) < 2 or len(frames) != len(weights):
        raise ValueError("two or more sources, with a weight each")
    if len({tuple(f.columns) for f in frames}) > 1:
        raise ValueError("sources must have the same columns")
    total = float(sum(weights))
    bounds = [w / total for w in itertools.accumulate(weights)]
    rows = None
    for i, (frame, key) in enumerate(zip(frames, keys, strict=True)):
        part = numbered(frame, [key], "_k").withColumn("source", F.lit(i).cast("bigint"))
        rows = part if rows is None else rows.unionByName(part)
    sizes = {r.source: r.n for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}  # a row a source
    spark = frames[0].sparkSession
    # A source of share p is empty after about n / p slots; the end is among the first of these, within a margin.
    shares = [b - a for a, b in zip([0.0, *bounds], bounds, strict=False)]
    most = min((sizes.get(i, 0) + 1 + 8 * (sizes.get(i, 0) + 1) ** 0.5) / s for i, s in enumerate(shares) if s > 0)
    u = uniform(F.concat(F.lit(f"{seed}:"), F.col("slot").cast("string")))
    pick = F.lit(len(bounds) - 1)
    for i in reversed(range(len(bounds) - 1)):
        pick = F.when(u < F.lit(bounds[i]), F.lit(i)).otherwise(pick)
    while True:
        slots = spark.range(int(most) + 1).select(F.col("id").alias("slot")).withColumn("source", pick.cast("bigint"))
        slots = _numbered_in_source(slots)
        over = slots.where(" OR ".join(f"(source = {i} AND _k >= {sizes.get(i, 0)})" for i in range(len(frames))))
        end = over.agg(F.min("slot")).first()[0]
        if end is not None:
            break
        most *= 2
    return slots.where(F.col("slot") < end).join(rows, ["source", "_k"]).drop("_k")


def _numbered_in_source(slots: DataFrame, block: int = 1 << 16) -> DataFrame:
    """`_k`: how many slots before this one have its source; counted by block, then within blocks."""
    slots = slots.withColumn("_block", F.expr(f"slot div {block}"))
    inside = slots.withColumn("_in", F.row_number().over(Window.partitionBy("_block", "source").orderBy("slot")).cast("bigint") - 1)
    sizes = slots.groupBy("_block", "source").agg(F.count("*").alias("_n"))
    before = sizes.select("_block", "source", (F.sum("_n").over(Window.partitionBy("source").orderBy("_block")) - F.col("_n")).alias("_before"))
    return inside.join(before, ["_block", "source"]).withColumn("_k", F.col("_before") + F.col("_in")).drop("_block", "_in", "_before")


def displacement(df: DataFrame) -> DataFrame:
    """How much of the order is left: the absolute correlation of pos and shuffled_pos."""
    return df.agg(F.abs(F.corr(F.col("pos").cast("double"), F.col("shuffled_pos").cast("double"))).alias("abs_corr"))


class FifoBuffer:
    """A local buffer for iterators without an order of its own: first in, first out."""

    def __init__(self) -> None:
        self.items: deque = deque()
        self.done = False

    def put(self, items: Iterable) -> None:
        if self.done:
            raise RuntimeError("nothing can be added after finish")
        self.items.extend(items)

    def ready(self) -> bool:
        return bool(self.items)

    def get(self):  # noqa: ANN201
        if not self.ready():
            raise RuntimeError("nothing to get")
        return self.items.popleft()

    def finish(self) -> None:
        self.done = True


class ShuffleBuffer:
    """A local buffer for iterators: items go in up to `capacity`, come out in random order while more than `least` are in."""

    def __init__(self, capacity: int, least: int = 0, seed: int | None = None) -> None:
        import random

        if not 0 <= least < capacity:
            raise ValueError("0 <= least < capacity")
        self.capacity, self.least, self.random, self.items, self.done = capacity, least, random.Random(seed), [], False

    def put(self, items: list) -> None:
        if self.done:
            raise RuntimeError("nothing can be added after finish")
        if len(self.items) + len(items) > self.capacity:
            raise RuntimeError("the buffer is full")
        self.items += items

    def ready(self) -> bool:
        return len(self.items) > (0 if self.done else self.least)

    def get(self):  # noqa: ANN201
        if not self.ready():
            raise RuntimeError("nothing to get")
        i = self.random.randrange(len(self.items))
        self.items[i], self.items[-1] = self.items[-1], self.items[i]
        return self.items.pop()

    def finish(self) -> None:
        self.done = True


def pick_source(bounds: Sequence[float], u: float) -> int:
    """The source of a uniform number, as `weighted_mix` draws it."""
    return min(bisect.bisect_right(bounds, u), len(bounds) - 1)
