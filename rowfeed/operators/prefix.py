"""Running values, ranks and as-of joins where a key may hold any share of the rows.

`Window.partitionBy(key)` puts a key's rows into one task. Here rows are numbered in the total order of (keys, order), which sorts
range partitions, and cut into blocks of equally many rows, whoever's they are. A block's running values begin anew; what a block's first key
had at the end of the blocks before is carried on to it: a row a block, at most BLOCKS * shuffle partitions of them, whose running values are
a small window of the same kind. So a key of half of the rows is half of the blocks.

Where no key has more than MOST_ROWS rows, which a count by key tells, Spark's own window is as good and moves rows once; results are the same.

Nulls are keys like any other, and come first in an order, as in Spark. Rows that agree in keys, order and tie come in any order; a
run of such rows is one range of the sort, so `tie` should tell rows apart where many have the same order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowfeed.sources.rowgroups import numbered, unused
from rowfeed.staging import Workspace

#: Blocks for each shuffle partition, so that hashing blocks to tasks evens out, and the fewest rows of a block.
BLOCKS, LEAST = 32, 256
#: Rows of a key that a task of a window may have.
MOST_ROWS = 1_000_000


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def sorting(name: str) -> Column:
    """A column to sort by; a dash before its name means descending."""
    return named(name[1:]).desc() if name.startswith("-") else named(name).asc()


def plain(order: Sequence[str]) -> list[str]:
    return [n.removeprefix("-") for n in order]


def alike(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether the values agree; nulls do."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & x.eqNullSafe(y)
    return out


def hottest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the key that has most."""
    return (df.groupBy(*[named(k) for k in keys]).count().agg(F.max("count")).first()[0] if keys else df.count()) or 0


@dataclass(frozen=True)
class Blocks:
    """rows: the frame with `pos` (place in the order), `block`, and `own`: false for copies of neighbours that blocks get beside their own rows."""

    rows: DataFrame
    size: int
    pos: str
    block: str
    own: str


def in_blocks(df: DataFrame, order: Sequence[str], before: int = 0, after: int = 0, size: int | None = None) -> Blocks:
    """Rows in blocks of `size` by the order, each with copies of so many rows before and after it. Each block is in one partition."""
    pos, block, own = unused(df.columns, "_pos", "_block", "_own")
    placed = numbered(df, [sorting(n) for n in order], pos)
    if size is None:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        size = max(LEAST, -(-placed.count() // (BLOCKS * tasks)))
    size = max(size, before, after, 1)
    at, number = F.col(pos) % size, F.expr(f"`{pos}` div {size}")
    there = F.array(number)
    if after:
        there = F.concat(there, F.when((at < after) & (number > 0), F.array(number - 1)).otherwise(F.array().cast("array<bigint>")))
    if before:
        there = F.concat(there, F.when(at >= size - before, F.array(number + 1)).otherwise(F.array().cast("array<bigint>")))
    rows = placed.withColumn(block, F.explode(there) if before or after else number).withColumn(own, F.col(block) == number)
    return Blocks(rows.repartition(block), size, pos, block, own)


@dataclass(frozen=True)
class Running:
    """What to run over the rows of a key up to each row: row_number, rank, dense_rank; count, sum, min, max or last (that isn't null) of a field."""

    kind: str
    field: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("row_number", "rank", "dense_rank", "count", "sum", "min", "max", "last"):
            raise ValueError(f"no running {self.kind}")
        if (self.field is None) != (self.kind in ("row_number", "rank", "dense_rank")):
            raise ValueError(f"{self.kind} of {self.field}")


#: How values of earlier blocks and of this one become one: name -> (over rows of a key, of two values).
JOIN = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, Running], tie: Sequence[str] = (), size: int | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """The frame with a column for each running value.

    order: names, with a dash before those that descend; ranks are by it. tie: further names, which only order rows. Rows of a key up to
    and with a row count, in that order, for all but ranks, which are equal where the order is. size: rows of a block; if it is given, there are blocks
    whatever keys have.
    """
    if size is None and hottest(df, keys) <= most_rows:
        return _by_window(df, keys, order, columns, tie)
    ranks = any(r.kind in ("rank", "dense_rank") for r in columns.values())
    b = in_blocks(df, [*keys, *order, *tie], before=int(ranks), size=size)
    rows, pos, block = b.rows, F.col(b.pos), b.block
    fresh = unused([*rows.columns, *columns], "_fresh")[0]
    if ranks:  # a row begins a run where keys or order differ from the row before, which may be another block's
        w = Window.partitionBy(block).orderBy(b.pos)
        same = alike([named(n) for n in (*keys, *plain(order))], [F.lag(named(n)).over(w) for n in (*keys, *plain(order))])
        rows = rows.withColumn(fresh, (F.col(b.pos) == 0) | ~same).where(b.own)
    parts: dict[str, tuple[str, Column]] = {}
    for r in columns.values():
        if r.kind == "row_number":
            parts["n"] = "sum", F.lit(1).cast("bigint")
        elif r.kind == "rank":
            parts |= {"begin": ("min", pos), "run": ("last", F.when(F.col(fresh), pos))}
        elif r.kind == "dense_rank":
            parts["runs"] = "sum", F.col(fresh).cast("bigint")
        elif r.kind == "count":
            parts[f"count {r.field}"] = "sum", named(r.field).isNotNull().cast("bigint")
        else:
            parts[f"{r.kind} {r.field}"] = r.kind, named(r.field)
    local = dict(zip(parts, unused([*rows.columns, *columns], *(f"_v{k}" for k in range(len(parts)))), strict=True))
    w = Window.partitionBy(block, *[named(k) for k in keys]).orderBy(b.pos).rowsBetween(Window.unboundedPreceding, 0)
    done = rows.select(*[named(c) for c in df.columns], b.pos, block, *[JOIN[how][0](c).over(w).alias(local[p]) for p, (how, c) in parts.items()])
    done = Workspace(df.sparkSession).save(done, "running")
    carried = _carried(done, b, keys, {local[p]: how for p, (how, _) in parts.items()})
    mine = unused([*done.columns, *columns], *(f"_k{k}" for k in range(len(keys))))
    carried = carried.select(block, *[named(k).alias(m) for k, m in zip(keys, mine, strict=True)], *[F.col(c).alias(f"{c}c") for c in local.values()], F.lit(True).alias("_has"))
    joined = done.join(F.broadcast(carried), block, "left")
    goes_on = F.coalesce(F.col("_has"), F.lit(False)) & alike([named(k) for k in keys], [F.col(m) for m in mine])
    value = {p: F.when(goes_on, JOIN[how][1](F.col(f"{local[p]}c"), F.col(local[p]))).otherwise(F.col(local[p])) for p, (how, _) in parts.items()}
    out = {}
    for name, r in columns.items():
        if r.kind == "rank":
            out[name] = value["run"] - value["begin"] + 1
        else:
            out[name] = value[{"row_number": "n", "dense_rank": "runs"}.get(r.kind, f"{r.kind} {r.field}")]
    return joined.select(*[named(c) for c in df.columns], *[c.alias(n) for n, c in out.items()])


def _by_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, Running], tie: Sequence[str]) -> DataFrame:
    """The same with a task for a key."""
    by = Window.partitionBy(*[named(k) for k in keys])
    peers, rows = by.orderBy(*[sorting(n) for n in order]), by.orderBy(*[sorting(n) for n in (*order, *tie)]).rowsBetween(Window.unboundedPreceding, 0)

    def value(r: Running) -> Column:
        if r.kind in ("rank", "dense_rank"):
            return (F.rank() if r.kind == "rank" else F.dense_rank()).over(peers).cast("bigint")
        if r.kind in ("row_number", "count"):
            return F.count(F.lit(1) if r.field is None else named(r.field)).over(rows)
        return JOIN[r.kind][0](named(r.field)).over(rows)

    return df.select(*[named(c) for c in df.columns], *[value(r).alias(n) for n, r in columns.items()])


def _carried(done: DataFrame, b: Blocks, keys: Sequence[str], states: Mapping[str, str]) -> DataFrame:
    """For each block's first key, what it had at the end of the blocks before: from the last rows of blocks, by a window over a row or two a block."""
    at = F.col(b.pos) % b.size
    heads = done.where(at == 0).select(b.block, *[named(k) for k in keys], F.lit(0).alias("_end"), *[F.lit(None).cast(done.schema[c].dataType).alias(c) for c in states])
    tails = done.where(at == b.size - 1).select(b.block, *[named(k) for k in keys], F.lit(1).alias("_end"), *states)
    w = Window.partitionBy(*[named(k) for k in keys]).orderBy(b.block, "_end").rowsBetween(Window.unboundedPreceding, -1)
    return heads.unionByName(tails).select(b.block, *[named(k) for k in keys], "_end", *[JOIN[how][0](F.col(c)).over(w).alias(c) for c, how in states.items()]).where("_end = 0")


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, columns: Sequence[str], exact: bool = True, tolerance: Column | None = None, tie: Sequence[str] = (), size: int | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """Each left row with `columns` of the last right row of its keys that isn't later (exact=False: that is earlier), null if there is none.

    Both sides lie in one order, in which right rows are carried on, so there are no pairs to be made and a key may have any share of them. Of right
    rows at one time the greatest by `tie` counts. Rows without a time match nothing. tolerance: the greatest difference of times. Columns that
    both sides have are taken from the left as they are, and from the right under their name with `_right`.
    """
    given, on, side = unused([*left.columns, *right.columns], "_given", "_on", "_side")
    names = [c if c not in left.columns else f"{c}_right" for c in columns]
    kept = F.struct(named(right_on).alias("on"), F.struct(*[named(c) for c in columns]).alias("of"))
    key = [f"_key{k}" for k in range(len(keys))]
    ties = [f"_tie{k}" for k in range(len(tie))]
    a = left.select(F.struct(*[named(c) for c in left.columns]).alias(given), named(left_on).alias(on), F.lit(1 if exact else 0).alias(side), *[named(k).alias(n) for k, n in zip(keys, key, strict=True)])
    b = right.where(named(right_on).isNotNull()).select(kept.alias("_right"), named(right_on).alias(on), F.lit(0 if exact else 1).alias(side), *[named(k).alias(n) for k, n in zip(keys, key, strict=True)], *[named(t).alias(n) for t, n in zip(tie, ties, strict=True)])
    both = a.unionByName(b, allowMissingColumns=True)
    done = running(both, key, [on], {"_found": Running("last", "_right")}, [side, *ties], size, most_rows).where(F.col(given).isNotNull())
    near = F.col(on).isNotNull()
    if tolerance is not None:
        near = near & (F.col(on) - F.col("_found.on") <= tolerance)
    return done.select(f"{given}.*", *[F.when(near, F.col(f"_found.of.`{c}`")).alias(n) for c, n in zip(columns, names, strict=True)])
