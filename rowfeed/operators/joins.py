"""Joins by overlap and by distance, as equality joins on bins: no cross join, and work that follows the sizes of input and result.

Skewed bins are split by AQE, as of any equality join; both joins give each pair once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowfeed.operators.prefix import named
from rowfeed.sources.rowgroups import unused

#: Starts and ends must be less than this in size, so that bins and lengths are exact.
FAR = 1 << 62


def _sides(left: DataFrame, right: DataFrame) -> tuple[list[Column], str, str]:
    """Columns of the result, and the names of the structs in which the sides' rows travel."""
    l, r = unused([*left.columns, *right.columns], "_left", "_right")
    out = [F.col(f"{l}.`{c}`").alias(c) for c in left.columns]
    return [*out, *[F.col(f"{r}.`{c}`").alias(c if c not in left.columns else f"{c}_right") for c in right.columns]], l, r


def _carried(df: DataFrame, name: str, keys: Sequence[str], *more: Column) -> DataFrame:
    return df.select(F.struct(*[named(c) for c in df.columns]).alias(name), *[named(k).alias(f"_key{i}") for i, k in enumerate(keys)], *more)


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: Sequence[str] = (), closed: bool = False) -> DataFrame:
    """Pairs of rows whose spans [start, end) of whole numbers overlap, and whose keys are equal (null keys aren't). closed: ends belong to spans.

    A span's level is the power of two that isn't less than its length, and at its own level or a higher one it lies in one or two bins
    of that size. A pair meets at the higher of its two levels: each side goes to its own level, and to the higher ones that
    the other side has; two spans that both are below a level don't meet there. Two bins may hold a pair; it is given in the later one of those in which
    its spans begin. So no span is cut into many bins, however long it is beside others. Spans with a null or an end
    before the start match nothing; an empty span matches none unless closed. A column that both sides have is the left's, and the
    right's with `_right`.
    """
    out, l, r = _sides(left, right)
    levels, rows = [], []
    for df, span, name in ((left, left_span, l), (right, right_span, r)):
        a, b = (named(c).cast("bigint") for c in span)
        b = b if closed else b - 1
        side = _carried(df, name, keys, a.alias("_a"), b.alias("_b")).where((F.col("_a") <= F.col("_b")) & (F.abs("_a") < FAR) & (F.abs("_b") < FAR))
        # Bits of the length less one: the level whose bins are at least as long.
        n = F.col("_b") - F.col("_a")
        side = side.withColumn("_level", F.when(n == 0, 0).otherwise(F.length(F.bin(n))))
        rows.append(side)
        levels.append(sorted(x[0] for x in side.select("_level").distinct().collect()))  # at most 63
    def binned(side: DataFrame, other: Sequence[int], own: Sequence[int], up: int) -> DataFrame:
        """A side's rows at the levels and bins where they meet others. `_meet` 0: the left span is at its own level; 1: it is at a higher one, and the right span at its own."""
        higher = F.filter(F.array(*[F.lit(x) for x in other]).cast("array<int>"), lambda x: x > F.col("_level"))
        at = F.concat(F.array(*[F.struct(F.col("_level").alias("level"), F.lit(m).alias("meet")) for m in own]), F.transform(higher, lambda x: F.struct(x.alias("level"), F.lit(up).alias("meet"))))
        side = side.withColumn("_at", F.explode(at)).withColumns({"_first": F.expr("shiftright(_a, _at.level)"), "_last": F.expr("shiftright(_b, _at.level)"), "_size": F.col("_at.level"), "_meet": F.col("_at.meet")})
        return side.withColumn("_bin", F.explode(F.when(F.col("_first") == F.col("_last"), F.array("_first")).otherwise(F.array("_first", "_last")))).drop("_at", "_level", "_last")

    same = ["_size", "_meet", "_bin", *[f"_key{i}" for i in range(len(keys))]]
    a = binned(rows[0], levels[1], [0], 1)
    b = binned(rows[1], levels[0], [0, 1], 0).withColumnsRenamed({"_a": "_c", "_b": "_d", "_first": "_begin"})
    return a.join(b, same).where("_a <= _d AND _c <= _b AND _bin = greatest(_first, _begin)").select(*out)


#: Ranges of the left side in a band join: for each shuffle partition, and at most.
RANGES, MOST_RANGES = 4, 1000


def band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows with |left - right| <= width as doubles (null, NaN and infinities match nothing), and equal keys if there are any.

    The left side's quantiles cut its values into ranges of like many rows; within a range, bins of the width separate what is too far
    apart. A left row is in one range and bin; a right row goes to each that has values within the width. Where values are dense,
    ranges are narrower than bins and divide the work; where they are sparse, bins do. Quantiles only divide: the result is exact
    whatever they are.
    """
    if not 0 <= width < float("inf"):
        raise ValueError("the width must be a number, not less than 0")
    out, l, r = _sides(left, right)
    a = _carried(left, l, keys, named(left_on).cast("double").alias("_x")).where("abs(_x) < double('inf')")
    b = _carried(right, r, keys, named(right_on).cast("double").alias("_y")).where("abs(_y) < double('inf')")
    key = [f"_key{i}" for i in range(len(keys))]
    if width == 0:
        return a.join(b.withColumn("_x", F.col("_y")), ["_x", *key]).select(*out)
    n = min(RANGES * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    inner = sorted({*a.approxQuantile("_x", [k / n for k in range(1, n)], 0.5 / n)}) or [0.0]
    edges = [-float("inf"), *inner, float("inf")]

    def range_of(df: DataFrame, value: str, name: str) -> DataFrame:
        """The number of the range that a value is in: a search among the edges, in the JVM."""
        return Bucketizer(splits=edges, inputCol=value, outputCol=name).transform(df).withColumn(name, F.col(name).cast("int"))

    def bin_of(value: Column) -> Column:
        """The value's bin. Quotients beyond 2^50 aren't whole numbers apart; ranges alone divide such values."""
        return F.floor(F.greatest(F.least(value / width, F.lit(2.0**50)), F.lit(-(2.0**50))))

    # Doubles are rounded: the right side looks a little further, and pairs are compared as they are.
    slack = F.lit(width * 1e-9) + F.abs("_y") * 4.5e-16
    b = b.withColumns({"_low": F.col("_y") - width - slack, "_high": F.col("_y") + width + slack})
    b = range_of(range_of(b, "_low", "_from"), "_high", "_to").withColumn("_range", F.explode(F.sequence("_from", "_to")))
    # Of a range, only the bins between the right row's bounds and the range's own edges.
    edge = F.array(*[F.lit(x) for x in edges])
    low, high = F.greatest("_low", F.element_at(edge, F.col("_range") + 1)), F.least("_high", F.element_at(edge, F.col("_range") + 2))
    b = b.withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    a = range_of(a, "_x", "_range").withColumn("_bin", bin_of(F.col("_x")))
    return a.join(b, ["_range", "_bin", *key]).where(F.abs(F.col("_x") - F.col("_y")) <= width).select(*out)
