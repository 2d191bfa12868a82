"""Aggregates of one's own, bitmap indexes and sketches."""

import random

import pytest
from pyspark.sql import functions as F

from rowfeed.operators import index
from rowfeed.operators.aggregate import Aggregate, RootMeanSquare, aggregate


class Longest(Aggregate):
    """The longest text, and how many there are."""

    state, result = "text string, n bigint", "string"

    def zero(self):
        return None, 0

    def update(self, state, values):
        for v in values.dropna():
            state = self.merge(state, (v, 1))
        return state

    def merge(self, a, b):
        best = min((x for x in (a[0], b[0]) if x is not None), key=lambda x: (-len(x), x), default=None)
        return best, a[1] + b[1]

    def finish(self, state):
        return None if state[0] is None else f"{state[0]} {state[1]}"


class Wide(Aggregate):
    """Rows of the largest task, and of how many: what the shuffle gets of a group."""

    state, result = "n bigint, states bigint", "struct<n: bigint, states: bigint>"

    def zero(self):
        return 0, 1

    def update(self, state, values):
        return state[0] + len(values), 1

    def merge(self, a, b):
        return max(a[0], b[0]), a[1] + b[1]

    def finish(self, state):
        return {"n": state[0], "states": state[1]}


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    nan = float("nan")
    data = [(r.choice(["a", "a", "a", None, *"bcdefg"]), r.choice([1.5, nan, None]), r.choice([None, r.random() * 10]), r.choice([None, "x", "yy", "zzz", "www"])) for _ in range(2000)]
    return data, spark.createDataFrame(data, "k string, x double, v double, t string").repartition(5)


def key(v):
    return "NaN" if isinstance(v, float) and v != v else v


@pytest.mark.parametrize("most", [50_000, 3])
def test_aggregate_equals_plain(rows, most):
    data, df = rows
    for keys in (["k"], ["k", "x"], []):
        got = {tuple(key(r[c]) for c in keys): (r.rms, r.longest) for r in aggregate(df, keys, {"rms": (RootMeanSquare(), ["v"]), "longest": (Longest(), ["t"])}, most).collect()}
        groups = {}
        for row in data:
            named = dict(zip("kxvt", row, strict=True))
            groups.setdefault(tuple(key(named[c]) for c in keys), []).append(row)
        assert got.keys() == groups.keys()
        for k, members in groups.items():
            v = [m[2] for m in members if m[2] is not None]
            t = [m[3] for m in members if m[3] is not None]
            assert got[k][0] == pytest.approx((sum(x * x for x in v) / len(v)) ** 0.5) and got[k][1] == f"{min(t, key=lambda x: (-len(x), x))} {len(t)}"


def test_a_hot_group_is_spread(spark):
    df = spark.range(0, 90_000, 1, 9).select(F.lit(1).alias("k"), "id")
    got = aggregate(df, ["k"], {"w": (Wide(), ["id"])}).collect()
    assert [(r.w.n, r.w.states) for r in got] == [(10_000, 9)]
    assert aggregate(df.limit(0), ["k"], {"w": (Wide(), ["id"])}).count() == 0


@pytest.fixture(scope="module")
def entries(spark):
    r = random.Random(5)
    found = sorted({(v, g) for v in range(6) for g in r.sample([*range(50), 32_767, 32_768, 40_000, 99_999], 9)})
    return {v: {g for w, g in found if w == v} for v in range(6)}, spark.createDataFrame(found, "value int, rg bigint")


@pytest.mark.parametrize("stored", [False, True])
def test_selectors_by_bits(spark, entries, stored):
    sets, df = entries
    indexes = {"i": index.bitmaps(df) if stored else df, "j": df.where("rg > 20")}
    rows = spark.range(0, 100_010).selectExpr("id", "id - 5 AS rg")
    for selector, want in [
        (index.Single("i", [1, 2]), sets[1] | sets[2]),
        (index.Single("i"), set().union(*sets.values())),
        (index.Single("i", [77]), set()),
        (index.Intersect([index.Single("i", [0, 1, 2]), index.Single("j", [2, 3, 4])]), (sets[0] | sets[1] | sets[2]) & {g for v in (2, 3, 4) for g in sets[v] if g > 20}),
        (index.Intersect([index.Single("i", [0]), index.Single("i", [77])]), set()),
        (index.Union([index.Single("i", [0]), index.Intersect([index.Single("i", [3]), index.Single("i", [4])])]), sets[0] | sets[3] & sets[4]),
    ]:
        assert {r.rg for r in selector.groups(indexes).collect()} == want
        assert selector.numbers(indexes, 1000) == sorted(want) and (len(want) < 2 or selector.numbers(indexes, 1) is None)
        picked = selector.rows(rows, indexes)
        assert {r.rg for r in picked.collect()} == want and picked.columns == rows.columns
        assert "Join" not in picked._jdf.queryExecution().toString() and "Join" not in selector.bits(indexes)._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        index.Single("none").groups(indexes)


def test_many_bitmaps_are_joined(spark, entries, monkeypatch):
    monkeypatch.setattr(index, "MOST_BITMAPS", 1)
    sets, df = entries
    picked = index.Single("i", [1]).rows(spark.range(100_000).selectExpr("id AS rg"), {"i": df})
    assert {r.rg for r in picked.collect()} == sets[1]


def test_sketches_of_selected_row_groups(spark):
    df = spark.range(60_000).selectExpr("id div 1000 AS rg", "(id * 7919) % 20011 AS x", "concat('s', id % 3000) AS s", "id * 0.5 AS y")
    found = index.sketches(df, ["x", "s", "y"]).cache()
    assert found.count() == 60
    for keep in ("rg < 60", "rg % 7 = 2", "rg = 5"):
        got, rows = index.merged(found.where(keep), [0.1, 0.5, 0.9]).first(), df.where(keep)
        n, xs, ss = rows.agg(F.count("*"), F.countDistinct("x"), F.countDistinct("s")).first()
        assert got.n == n and abs(got.x_distinct - xs) <= 0.06 * xs and abs(got.s_distinct - ss) <= 0.06 * ss
        assert "s_quantiles" not in found.columns
        for q, v in zip([0.1, 0.5, 0.9], got.y_quantiles, strict=True):
            rank = rows.where(F.col("y") <= v).count() / n
            assert abs(rank - q) <= 0.03
