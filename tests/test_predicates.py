import random

import pytest
from pyspark.sql import functions as F

from rowfeed.functions.hashing import split_bounds
from rowfeed.functions.predicates import InIntersection, InLambda, InSet, InVector, Negate, Reduce, Split, dnf


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if i % 5 == 0 else i % 7, None if i % 3 == 0 else "abc"[i % 3]) for i in range(60)]
    return spark.createDataFrame(data, "id int, a int, b string").cache()


def model(p, row):
    """Two-valued logic on Python values."""
    if isinstance(p, InSet):
        return (None in p.values or p.null) if row[p.field] is None else row[p.field] in p.values
    if isinstance(p, Negate):
        return not model(p.inner, row)
    return p.reduce([model(q, row) for q in p.predicates])


def make(r, depth=0):
    if depth > 2 or r.random() < 0.4:
        if r.random() < 0.5:
            return InSet(r.sample([0, 1, 2, 3, None], r.randint(0, 4)), "a")
        return InSet(r.sample(["a", "b", None], r.randint(0, 3)), "b")
    if r.random() < 0.4:
        return Negate(make(r, depth + 1))
    return Reduce([make(r, depth + 1) for _ in range(r.randint(1, 3))], r.choice([all, any]))


def test_two_valued_logic(rows):
    r = random.Random(3)
    preds = [make(r) for _ in range(40)]
    all_rows = rows.collect()
    flags = rows.select("id", *[F.coalesce(p.column(), F.lit(False)).alias(f"p{i}") for i, p in enumerate(preds)]).collect()
    for row, out in zip(all_rows, flags, strict=True):
        for i, p in enumerate(preds):
            assert out[f"p{i}"] == model(p, row), (row, i)


@pytest.mark.parametrize(("pred", "pushed"), [(InSet(["click"], "event_type"), "EqualTo(event_type,click)"), (Negate(InSet(["click", "view"], "event_type")), "IsNull(event_type)")])
def test_predicates_reach_the_scan(spark, sf, pred, pushed):
    plan = pred.filter(spark.read.parquet(f"{sf}/events.parquet"))._jdf.queryExecution().toString()
    assert pushed in plan


def test_intersection_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, [1, None]), (2, None), (3, []), (4, [5])], "id int, l array<int>")
    assert [r.id for r in InIntersection([5, 6], "l").filter(df).collect()] == [4]
    assert [r.id for r in Negate(InIntersection([5, 6], "l")).filter(df).orderBy("id").collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="l is null"):
        InIntersection([5], "l", strict=True).filter(df).collect()


def test_python_predicates(rows):
    assert InLambda(["a"], lambda a: a is None, python=True).filter(rows).count() == 12
    assert Negate(InLambda(["a"], lambda a: a == 1)).filter(rows).count() == 60 - rows.where("a = 1").count()
    assert InVector(["id"], lambda f: f.id > 50).filter(rows).count() == 9
    assert Reduce([InSet([1], "a"), InSet(["b"], "b")], lambda x: sum(x) == 2).filter(rows).count() == rows.where("a = 1 and b = 'b'").count()
    with pytest.raises(ValueError, match="list"):
        InLambda("a", lambda a: a)
    with pytest.raises(ValueError, match="unknown"):
        InSet([1], "zz").filter(rows)


def test_splits_are_disjoint_and_cover(spark):
    df = spark.range(3000).selectExpr("concat('guid_', id) as g")
    parts = [Split([0.3, 0.4, 0.1, 0.0, 0.2], i, "g").filter(df).count() for i in range(5)]
    assert sum(parts) == 3000 and parts[3] == 0
    assert abs(parts[0] / 3000 - 0.3) < 0.04
    with pytest.raises(ValueError, match="split 2 of 2"):
        split_bounds([0.5, 0.5], 2)


def test_split_is_the_hash_it_says(spark):
    import hashlib

    low, high = split_bounds([0.5, 0.5], 0)
    want = {i for i in range(500) if low <= int(hashlib.md5(str(i).encode()).hexdigest(), 16) % (2**63 - 1) < high}
    assert {r.id for r in Split([0.5, 0.5], 0, "id").filter(spark.range(500)).collect()} == want


def test_dnf(rows):
    assert rows.where(dnf([("a", ">=", 5), ("b", "in", ["b"])])).count() == rows.where("a >= 5 and b = 'b'").count()
    assert rows.where(dnf([[("a", "=", 1)], [("a", "not in", [1, 2])]])).count() == rows.where("a = 1 or a not in (1, 2)").count()
    assert rows.where(dnf(None)).count() == 60
