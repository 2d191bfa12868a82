import warnings

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowfeed import Field, Scan, read_batches, read_rows
from rowfeed.functions import promote
from rowfeed.functions.codecs import default_codec
from rowfeed.functions.predicates import InSet
from rowfeed.operators import batching, sampling
from rowfeed.operators.ngram import NGram
from rowfeed.operators.transform import Transform
from rowfeed.sinks import converter
from rowfeed.sources import rowgroups
from rowfeed.sources.urls import checked


def windows_model(rows, length, threshold, overlap):
    """Windows of a list of (ts, id), by the definition."""
    rows, out, end = sorted(rows), [], None
    for i in range(len(rows) - length + 1):
        part = rows[i : i + length]
        if all(b[0] - a[0] <= threshold for a, b in zip(part, part[1:], strict=False)) and (overlap or end is None or part[0][0] > end):
            out.append(tuple(x[1] for x in part))
            end = part[-1][0]
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=14), min_size=1, max_size=6), st.integers(1, 4), st.integers(0, 9), st.booleans())
def test_windows_match_their_definition(spark, groups, length, threshold, overlap):
    rows = [(g, t, g * 100 + i) for g, ts in enumerate(groups) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "rg int, ts int, id int")
    spec = NGram({i: ["id"] for i in range(length)}, threshold, "ts", overlap)
    got = sorted((r.rg, *(r[f"t_{i}"].id for i in range(length))) for r in spec.windows(df, "rg", ["id"]).collect())
    want = sorted((g, *w) for g in range(len(groups)) for w in windows_model([(t, i) for gg, t, i in rows if gg == g], length, threshold, overlap))
    assert got == want


def test_window_examples(spark):
    ids = [0, 3, 8, 10, 11, 20, 23]
    df = spark.createDataFrame([(i // 10, i) for i in ids], "rg int, id int")
    spec = NGram({0: ["id"], 1: ["id"]}, 4, "id")
    assert sorted((r.t_0.id, r.t_1.id) for r in spec.windows(df).collect()) == [(0, 3), (10, 11), (20, 23)]
    assert NGram({0: ["id"], 1: ["id"]}, 1, "id").windows(spark.createDataFrame([(0, i) for i in range(0, 100, 5)], "rg int, id int")).count() == 0
    flat = NGram({-1: ["id"], 1: ["i.*"]}, 9, "id")
    assert flat.flatten(flat.windows(df)).columns == ["id_0", "id_1"]


def test_window_arguments():
    for bad in ({}, {"a": ["x"]}, {0: "x"}):
        with pytest.raises(ValueError):
            NGram(bad, 1, "x")
    with pytest.raises(ValueError):
        NGram({0: ["x"]}, None, "x")
    with pytest.raises(ValueError, match="one field"):
        NGram({0: ["a"]}, 1, "a|b").resolve(["a", "b"])


@settings(max_examples=6, deadline=None)
@given(st.integers(1, 60), st.integers(1, 9))
def test_row_drop_is_the_double_formula(spark, n, k):
    df = spark.range(n).withColumn("rg", F.lit(0))
    got = [r.part for r in sampling.row_drop(df, k, ["id"]).orderBy("id").collect()]
    assert got == [int(i / (n / min(n, k))) for i in range(n)]


def test_shards(spark):
    df = rowgroups.logical(spark.range(100), "id", 10)
    parts = [{r.id for r in sampling.shard(df, i, 3).collect()} for i in range(3)]
    assert sum(map(len, parts)) == 100 and len(set.union(*parts)) == 100
    for bad in ((3, 3), (-1, 3), (0, 0), ("0", 3)):
        with pytest.raises(ValueError):
            sampling.shard(df, *bad)
    with pytest.raises(sampling.NoDataError):
        sampling.shard(df, 0, 11, groups=10)


def test_physical_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"id": list(range(100))}), tmp_path / "a.parquet", row_group_size=30)
    pq.write_table(pa.table({"id": list(range(100, 150))}), tmp_path / "b.parquet", row_group_size=30)
    df = rowgroups.physical(spark, f"file://{tmp_path}")
    assert [(r.rg, r.n_rows) for r in rowgroups.summary(df, "id").orderBy("rg").collect()] == [(0, 30), (1, 30), (2, 30), (3, 10), (4, 30), (5, 20)]
    scan = Scan(f"file://{tmp_path}", ngram=NGram({0: ["id"], 1: ["id"]}, 1, "id"))
    assert scan.frame(spark).count() == 150 - 6


def test_numbered_is_a_total_order(spark):
    got = rowgroups.numbered(spark.range(1000).repartition(7), ["id"]).collect()
    assert {(r.id, r._pos) for r in got} == {(i, i) for i in range(1000)}


def test_order(spark):
    df = rowgroups.logical(spark.range(60), "id", 10)
    ids = lambda **k: [r.id for r in sampling.in_read_order(df, "id", **k).collect()]
    assert ids() == list(range(60))
    assert ids(seed=1) == ids(seed=1) != ids(seed=2) and ids(seed=0) != list(range(60))
    assert ids(seed=1, epoch=1) != ids(seed=1)
    shuffled = ids(seed=1, shuffle_rows=True)
    assert sorted(shuffled) == list(range(60)) and len({i // 10 for i in shuffled[:10]}) == 1


def test_bounded_shuffle(spark):
    got = sampling.bounded_shuffle(spark.range(500), 20, 3, "id").collect()
    assert sorted(r.shuffled_pos for r in got) == list(range(500))
    assert max(abs(r.pos - r.shuffled_pos) for r in got) < 20


def test_weighted_mix(spark):
    a, b = spark.range(300), spark.range(1000, 1300)
    mix = sampling.weighted_mix([a, b], [1, 3], 5, ["id", "id"]).orderBy("slot").collect()
    assert [r.slot for r in mix] == list(range(len(mix)))
    for s, first in ((0, 0), (1, 1000)):
        mine = [r.id for r in mix if r.source == s]
        assert mine == list(range(first, first + len(mine)))
    assert abs(sum(r.source == 0 for r in mix) / len(mix) - 0.25) < 0.07
    assert max(sum(r.source == s for r in mix) for s in (0, 1)) == 300
    with pytest.raises(ValueError):
        sampling.weighted_mix([a], [1], 5, ["id"])


def test_epochs(spark):
    assert sampling.epochs(spark.range(4), 3).groupBy("id").count().where("count = 3").count() == 4
    for bad in (0, -1, 1.5, None):
        with pytest.raises(ValueError):
            sampling.epochs(spark.range(4), bad)


def test_batches(spark):
    assert batching.batches(spark.range(10), 4, ["id"], keep_partial=False).count() == 8
    t = list(batching.iter_tables(spark.range(10), 4))
    assert [x.num_rows for x in t] == [4, 4, 2] and len(list(batching.iter_tables(spark.range(10), 4, keep_partial=False))) == 2
    q = batching.Rebatcher(3)
    q.put(pa.table({"a": [1, 2]}))
    assert q.get() is None
    q.put(pa.table({"a": [3, 4]}))
    assert q.get()["a"].to_pylist() == [1, 2, 3] and q.rest()["a"].to_pylist() == [4]
    rows = [{"i": i, "s": str(i)} for i in range(7)]
    out = list(batching.row_batches(iter(rows), 3, shuffle_capacity=4, seed=1))
    assert sorted(int(s) for b in out for s in b["s"]) == list(range(7)) and len(out[-1]["s"]) == 1


def test_shuffle_buffer():
    b = sampling.ShuffleBuffer(4, 1, 0)
    b.put([1, 2])
    assert b.ready()
    with pytest.raises(RuntimeError):
        b.put([1, 2, 3])
    b.get()
    assert not b.ready()
    b.finish()
    assert b.ready() and b.get() in (1, 2) and not b.ready()
    with pytest.raises(RuntimeError):
        b.put([1])


def test_transforms(spark):
    df = spark.createDataFrame([(1, 2.0, "a")], "i int, x double, s string")
    assert Transform({"x": F.col("x") * 2}).apply(df).columns == ["i", "s", "x"]
    assert Transform(removed=["s"]).apply(df).columns == ["i", "x"]
    assert Transform(selected=["s", "i"]).apply(df).columns == ["s", "i"]
    with pytest.raises(ValueError):
        Transform(removed=["s"], selected=["i"])
    with pytest.warns(UserWarning, match="don't exist"):
        Transform(removed=["zz"]).apply(df)
    with pytest.raises(Exception, match="the transform gave columns"):
        Transform(func=lambda f: f.drop(columns=["i"])).apply(df).collect()
    flat = default_codec("float64", (2, 2), T.DoubleType())
    grid = Transform(func=lambda f: f.assign(m=[np.arange(4.0).reshape(2, 2)] * len(f)), edited=[Field("m", "float64", (2, 2), flat)])
    assert grid.apply(df).first().m == [0.0, 1.0, 2.0, 3.0]


def test_scan(spark, sf):
    url = f"{sf}/orders.parquet"
    scan = Scan(url, ["o_orderkey"], key="o_orderkey", group_size=100, predicate=InSet(["O"], "o_orderstatus"))
    df = scan.frame(spark)
    assert df.columns == ["o_orderkey"]
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,O)" in plan and "o_totalprice" not in plan.split("ReadSchema")[-1]
    assert scan.where(seed=3).ordered(spark).collect() == scan.where(seed=3).ordered(spark).collect() != scan.where(seed=4).ordered(spark).collect()
    with pytest.raises(ValueError):
        Scan(url, ["nothing_like_this", Field("zz", "int8")]).frame(spark)
    with pytest.raises(RuntimeError):
        Scan(url, []).frame(spark) if Scan(url, ["zz.*"]).frame(spark) else None
    for bad in ({"shard_index": 1}, {"num_epochs": 0}, {"ngram": NGram({0: ["a"]}, 1, "a", overlap=False), "drop_parts": 2}):
        with pytest.raises((ValueError, NotImplementedError)):
            Scan(url, **bad)


def test_readers(spark, sf):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        r = read_rows(spark, f"{sf}/region.parquet")
    with pytest.raises(NotImplementedError):
        r.reset()
    with r:
        assert len(list(r)) == 5
        r.reset()
        assert len(list(r)) == 5
    assert sum(t.num_rows for t in read_batches(spark, f"{sf}/nation.parquet", size=7, num_epochs=2)) == 50
    with pytest.raises(NotImplementedError):
        read_batches(spark, f"{sf}/nation.parquet", ngram=NGram({0: ["a"]}, 1, "a"))


def test_urls():
    assert checked("/a/b/") == ["file:///a/b"] and checked(["hdfs://n/a", "hdfs://n/b"]) == ["hdfs://n/a", "hdfs://n/b"]
    for bad in ([], "rel/path", ["file:///a", "hdfs://n/a"], None):
        with pytest.raises(ValueError):
            checked(bad)


def test_types_for_training(spark):
    df = spark.sql("SELECT 1.500 AS d, timestamp_ntz'1970-01-01 00:00:01' AS n, timestamp'1970-01-01 00:00:01' AS t, date'1970-01-02' AS day, 100 AS i")
    r = promote.to_tf(df).first()
    assert (r.d, r.n, r.t, r.day, r.i) == ("1.5", 10**9, 10**9, 86_400 * 10**9, 100)
    with pytest.raises(Exception, match="is null"):
        promote.to_tf(spark.sql("SELECT cast(null AS int) AS x")).collect()
    with pytest.raises(TypeError):
        promote.to_torch(spark.sql("SELECT 'a' AS x"))
    assert promote.torch_array("x", np.uint16([1])).dtype == np.int32 and promote.tf_type("uint32") == "int64"
    with pytest.raises(ValueError):
        promote.tf_type("uint64")


def test_converter(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    parent = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, 2.0, [1.0, 2.0]), (2, 3.0, [1.0, 2.0])], "id int, d double, a array<double>")
    made = converter.convert(df, parent)
    assert converter.convert(df, parent) is made and converter.convert(df, parent, dtype="float64") is not made
    assert dict(made.frame(spark).dtypes) == {"id": "int", "d": "float", "a": "array<float>"} and len(made) == 2
    assert sum(len(b["id"]) for b in made.batches(spark, 1, 2)) == 4
    made.delete(spark)
    assert converter.convert(df, parent) is not made
    with pytest.raises(ValueError):
        converter.convert(df, parent, codec="bzip2")
    with pytest.raises(ValueError):
        converter.in_precision(df, "int8")
    vec = spark.createDataFrame([(Vectors.dense(1.0, 2.0),)], ["v"])
    assert dict(converter.vectors_to_arrays(vec).dtypes) == {"v": "array<float>"} and converter.vectors_to_arrays(vec, None).count() == 1
    assert converter.check_ranks(0, 2, {"HOROVOD_RANK": "0", "HOROVOD_SIZE": "2"})
    with pytest.warns(UserWarning, match="HOROVOD_RANK"):
        assert not converter.check_ranks(1, 2, {"HOROVOD_RANK": "0", "HOROVOD_SIZE": "2"})
