"""Total orders at size, row groups by the manifest, order of application, decoding in tasks, loaders."""

import threading

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rowfeed import Field, Scan, Schema, read_batches, read_rows
from rowfeed.functions.codecs import Image, PackedTensor, Tensor, png_array, png_bytes
from rowfeed.functions.predicates import InLambda, InSet, Reduce
from rowfeed.operators import batching, sampling
from rowfeed.operators.index import Single, ValueIndex, build_indexes
from rowfeed.operators.ngram import NGram
from rowfeed.operators.transform import Transform
from rowfeed.schema import DecodeError
from rowfeed.sinks.converter import Converter
from rowfeed.sinks.writer import write_groups, write_rows
from rowfeed.sources import rowgroups


@pytest.mark.parametrize(("rows", "settings"), [(1_500_000, {}), (40_000, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.shuffle.partitions": "200"})])
def test_numbers_of_wide_rows(spark, rows, settings):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(rows).select(F.xxhash64("id").alias("h"), "id", F.repeat(F.lit("x"), 100).alias("wide"))
        got = rowgroups.numbered(df, ["id"])
        assert got.columns == ["h", "id", "wide", "_pos"]
        one = got.agg(F.count("*"), F.sum(F.when(F.col("id") == F.col("_pos"), 1)), F.sum(F.when(F.length("wide") == 100, 1))).first()
        assert tuple(one) == (rows,) * 3
        exact = batching.batches(df.select("id", "wide"), 64, ["id"], keep_partial=False)
        assert exact.count() == rows // 64 * 64 and exact.groupBy("batch_id").count().where("count != 64").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_numbers_with_ties_and_taken_names(spark):
    df = spark.createDataFrame([(1, "a", 7)] * 5 + [(0, "b", 8), (None, None, None)], "k int, _part string, _at int")
    got = rowgroups.numbered(df, ["k"]).orderBy("_pos").collect()
    assert [r["_pos"] for r in got] == list(range(7)) and [r.k for r in got] == [None, 0, 1, 1, 1, 1, 1] and got[1]["_part"] == "b"
    assert rowgroups.numbered(df.limit(0), ["k"]).count() == 0


@pytest.fixture
def parted(spark, tmp_path):
    """A dataset partitioned by values that paths must encode, with files of several row groups."""
    folder = tmp_path / "a b"
    for k, name in enumerate(("k=x y", "k=50%25", "k=__HIVE_DEFAULT_PARTITION__")):
        (folder / name).mkdir(parents=True)
        ids = list(range(100 * k, 100 * k + 100))
        pq.write_table(pa.table({"id": ids, "v": pa.array([i % 5 for i in ids], pa.int32()), "t": pa.array([i * 1000 for i in ids], pa.timestamp("us"))}), folder / name / "f 1.parquet", row_group_size=30)
    return f"file://{folder}"


def test_partitioned_datasets(spark, parted):
    plain = spark.read.parquet(parted)
    assert {r.k for r in plain.select("k").distinct().collect()} == {"x y", "50%", None}
    df = rowgroups.physical(spark, parted, place=("at", "size"))
    assert df.drop("rg", "at", "size").schema == plain.schema
    assert sorted(map(str, df.drop("rg", "at", "size").collect())) == sorted(map(str, plain.collect()))
    assert [r.n for r in df.groupBy("rg").agg(F.count("*").alias("n")).orderBy("rg").collect()] == [30, 30, 30, 10] * 3
    assert df.where("at >= size").count() == 0
    scan = Scan(parted, ["id"], predicate=InSet(["50%", None], "k"))
    assert sorted(r.id for r in scan.frame(spark).collect()) == list(range(100, 300))
    assert "PartitionFilters: [(isnull(k" in scan.frame(spark)._jdf.queryExecution().toString()


def touched(df):
    """Row groups that a read opened, by the plan's own rows."""
    return {r.rg for r in df.select("rg").distinct().collect()}


def test_shards_and_selectors_read_their_row_groups_only(spark, parted, monkeypatch):
    scan, n = Scan(parted, ["id"]), rowgroups.manifest(spark, parted).count()
    parts = [sorted(r.id for r in scan.where(shard_index=i, shard_count=5).frame(spark).collect()) for i in range(5)]
    assert sorted(x for p in parts for x in p) == list(range(300)) and len(parts[0]) < 100
    found = build_indexes(rowgroups.physical(spark, parted), [ValueIndex("id", "id")])
    picked = scan.where(selector=Single("id", [5, 250]), indexes=found).frame(spark)
    assert len(picked.collect()) == 60
    given = []
    real = rowgroups.physical
    monkeypatch.setattr("rowfeed.sources.scan.physical", lambda *a, **k: given.append(k["groups"].count()) or real(*a, **k))
    scan.where(shard_index=0, shard_count=5).frame(spark)
    scan.where(selector=Single("id", [5]), indexes=found).frame(spark)
    assert n == 12 and given == [3, 1]


def test_selected_groups_of_a_key_are_ranges(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    spark.range(-50, 50).write.parquet(path)
    found = build_indexes(rowgroups.logical(spark.read.parquet(path), "id", 10), [ValueIndex("id", "id")])
    df = Scan(path, key="id", group_size=10, selector=Single("id", [-35, 0, 12]), indexes=found).frame(spark)
    assert sorted(r.id for r in df.collect()) == [*range(-39, -29), *range(-9, 20)]
    assert "GreaterThanOrEqual(id,-39)" in df._jdf.queryExecution().toString()


def test_many_selected_groups_of_a_key(spark, tmp_path):
    """Hundreds of ranges in one filter overflowed the stack of the planner."""
    path = f"file://{tmp_path}/d"
    spark.range(-9000, 9000).write.parquet(path)
    found = build_indexes(rowgroups.logical(spark.read.parquet(path), "id", 10), [ValueIndex("id", "id")])
    scan = Scan(path, key="id", group_size=10)
    for n in (2, 5):
        got = [sorted(r.id for r in scan.where(shard_index=k, shard_count=n).frame(spark).collect()) for k in range(n)]
        assert got == [[i for i in range(-9000, 9000) if int(i / 10) % n == k] for k in range(n)]
    picked = [-8990, -3000, 5, *range(4000, 9000, 20)]
    df = scan.where(selector=Single("id", picked), indexes=found).frame(spark)
    assert sorted(r.id for r in df.collect()) == [i for i in range(-9000, 9000) if int(i / 10) in {int(p / 10) for p in picked}]
    assert rowgroups.joined_runs([[0, 1], [3, 3], [9, 9], [11, 12]], 2) == [[0, 3], [9, 12]]
    assert rowgroups.joined_runs([], 2) == []


def test_row_groups_of_values(spark, tmp_path, monkeypatch):
    """Many row groups lie in few files and are read by few tasks, whatever their number."""
    rows = spark.range(6000).selectExpr("id", "id div 10 AS g", "id % 3 AS v", "if(id % 20 = 3, null, id) AS x")
    back = write_groups(rows, f"file://{tmp_path}/a", "g", ["id"])
    files = sorted(tmp_path.glob("a/*.parquet"))
    assert back.columns == ["id", "v", "x"] and len(files) <= 3 + 4
    found = [g for f in files for g in (pq.ParquetFile(f).read_row_group(k)["id"].to_pylist() for k in range(pq.read_metadata(f).num_row_groups))]
    assert found == [list(range(k, k + 10)) for k in range(0, 6000, 10)]
    read = rowgroups.physical(spark, f"file://{tmp_path}/a")
    assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted((r.rg, r.id, r.v, r.x) for r in read.collect()) == [(i // 10, i, i % 3, None if i % 20 == 3 else i) for i in range(6000)]
    ordered = rowgroups.physical(spark, f"file://{tmp_path}/a", order="1:0")
    assert sorted(r.id for r in ordered.collect()) == list(range(6000))

    write_groups(rows.withColumns({"p": F.when(F.col("g") % 7 < 6, F.concat(F.lit("a/b "), F.col("g") % 7)), "by": F.col("g")}), f"file://{tmp_path}/b", "by", ["id"], "p")
    assert len(list(tmp_path.glob("b/*"))) == 7 and len(list(tmp_path.glob("b/*/*.parquet"))) <= 7 + 4
    scan = Scan(f"file://{tmp_path}/b", ["id"], predicate=Reduce([InSet(["a/b 3"], "p"), InSet([3, 10, 17], "g")], all), shard_index=0, shard_count=1)
    opened = []
    real = rowgroups.physical
    monkeypatch.setattr("rowfeed.sources.scan.physical", lambda *a, **k: opened.append(k["groups"].count()) or real(*a, **k))
    assert sorted(r.id for r in scan.frame(spark).collect()) == [*range(30, 40), *range(100, 110), *range(170, 180)]
    assert opened == [3]
    assert spark.read.parquet(f"file://{tmp_path}/b").where("p IS NULL").count() == sum(1 for g in range(600) if g % 7 == 6) * 10
    assert write_groups(rows.limit(0), f"file://{tmp_path}/c", "g").count() == 0


def test_windows_of_many_row_groups(spark, tmp_path):
    """Tasks that read many row groups each make windows of each one's rows only."""
    pq.write_table(pa.table({"id": list(range(5000))}), tmp_path / "a.parquet", row_group_size=10)
    df = Scan(f"file://{tmp_path}", ngram=NGram({0: ["id"], 2: ["id"]}, 2, "id")).frame(spark)
    assert df.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted((r.rg, r.t_0.id, r.t_2.id) for r in df.collect()) == [(i // 10, i, i + 2) for i in range(5000) if i % 10 < 8]


@pytest.mark.parametrize("parts", [1, 3])
def test_windows_of_a_key_are_spread_by_rows(spark, tmp_path, monkeypatch, parts):
    """Runs of a key pack so well that partitions joined by their bytes would put all rows in one task."""
    monkeypatch.setattr(rowgroups, "GROUP_ROWS", 5000, raising=False)
    spark.range(100_000).withColumn("rest", F.lit("x")).write.parquet(f"file://{tmp_path}/d")
    scan = Scan(f"file://{tmp_path}/d", ["id"], key="id", group_size=100, drop_parts=parts, drop_part=0 if parts > 1 else None, ngram=NGram({0: ["id"], 1: ["id"]}, 1, "id"))
    df = scan.frame(spark).select("rg", F.col("t_0.id").alias("a"), F.col("t_1.id").alias("b"), F.spark_partition_id().alias("at"))
    sizes = [r["count"] for r in df.groupBy("at").count().collect()]
    rows = 34 if parts > 1 else 99
    assert sum(sizes) == 1000 * rows and max(sizes) < 10_000
    assert sorted((r.rg, r.a, r.b) for r in df.where("rg < 20").collect()) == [(g, 100 * g + i, 100 * g + i + 1) for g in range(20) for i in range(rows)]


def drop_model(rows, parts, part, length, keep):
    """A part's rows and the next length - 1, then those to keep."""
    n = len(rows)
    of = [int(i / (n / min(n, parts))) for i in range(n)]
    after = [i for i in range(n) if of[i] > part][: length - 1]
    return [rows[i] for i in range(n) if (of[i] == part or i in after) and keep(rows[i])]


@pytest.mark.parametrize("keyed", [True, False])
def test_windows_of_sub_splits(spark, tmp_path, keyed):
    pq.write_table(pa.table({"id": list(range(47))}), tmp_path / "a.parquet", row_group_size=20)
    scan = Scan(f"file://{tmp_path}", **({"key": "id", "group_size": 20} if keyed else {}), drop_parts=6, ngram=NGram({0: ["id"], 2: ["id"]}, 2, "id"), predicate=InLambda(["id"], lambda c: c % 7 != 3))
    total = 0
    for part in range(6):
        got = sorted((r.t_0.id, r.t_2.id) for r in scan.where(drop_part=part).frame(spark).collect())
        want = []
        for g in range(3):
            rows = drop_model(list(range(20 * g, min(47, 20 * g + 20))), 6, part, 3, lambda i: i % 7 != 3)
            want += [(a, c) for a, b, c in zip(rows, rows[1:], rows[2:], strict=False) if b - a <= 2 and c - b <= 2]
        assert got == sorted(want)
        total += len(got)
    assert scan.frame(spark).count() == total
    assert scan.where(ngram=None, drop_part=1).frame(spark).count() == sum(len(drop_model(list(range(20 * g, min(47, 20 * g + 20))), 6, 1, 1, lambda i: i % 7 != 3)) for g in range(3))


def test_windows_of_transformed_rows(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    spark.range(30).selectExpr("id", "id * 1.5 AS x", "'s' AS s").repartition(1).write.parquet(path)
    spec = NGram({0: ["id", "y"], 1: ["y"]}, 1, "id")
    for edit in (Transform({"y": F.col("x") * 2}, removed=["x"]), Transform(func=lambda f: f.assign(y=f["x"].astype(float) * 2).drop(columns=["x"]), edited=[Field("y", "float64")], removed=["x"]), Transform(func=lambda r: {"id": r["id"], "s": r["s"], "y": float(r["x"]) * 2}, by_row=True, edited=[Field("y", "float64")], removed=["x"])):
        got = Scan(path, transform=edit, ngram=spec, key="id", group_size=10).frame(spark).orderBy("start_ts").collect()
        assert len(got) == 27 and all(float(r.t_0.y) == 3 * r.t_0.id and float(r.t_1.y) == 3 * r.t_0.id + 3 for r in got)
    with pytest.raises(Exception, match="must keep each"):
        Scan(path, transform=Transform(func=lambda f: f[f["id"] > 3]), ngram=NGram({0: ["id"]}, 1, "id")).frame(spark).collect()


def test_long_windows_without_overlap(spark):
    df = spark.range(200_000).selectExpr("0 AS rg", "id AS ts", "id")
    assert NGram({0: ["id"], 1: ["id"], 2: ["id"]}, 1, "ts", overlap=False).windows(df).count() == 66_666


TENSORS = Schema("t", [Field("id", np.int32), Field("m", np.float32, (3, None), PackedTensor()), Field("n", np.uint8, (4,), Tensor(), nullable=True), Field("s", str, (), nullable=True), Field("pic", np.uint8, (6, 5, 3), Image())])


def test_rows_are_decoded_in_tasks(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = [{"id": i, "m": r.random((3, i % 4)).astype(np.float32), "n": None if i % 3 else r.integers(0, 9, 4, dtype=np.uint8), "s": None if i % 2 else str(i), "pic": r.integers(0, 255, (6, 5, 3), dtype=np.uint8)} for i in range(60)]
    write_rows(spark, f"file://{tmp_path}/t", TENSORS, rows, files=7)
    with read_rows(spark, f"file://{tmp_path}/t") as reader:
        got = {x["id"]: x for x in reader}
    assert len(got) == 60
    for want in rows:
        x = got[want["id"]]
        assert x["m"].dtype == np.float32 and np.array_equal(x["m"], want["m"]) and np.array_equal(x["pic"], want["pic"]) and x["s"] == want["s"]
        assert (x["n"] is None) == (want["n"] is None) and (want["n"] is None or np.array_equal(x["n"], want["n"]))
        x["m"][:] = 0  # arrays are the reader's own
    bad = spark.read.parquet(f"file://{tmp_path}/t").withColumn("m", F.col("m").substr(1, 9))
    bad = bad.select(*[F.col(f.name).alias(f.name, metadata=f.metadata) for f in spark.read.parquet(f"file://{tmp_path}/t").schema])
    bad.write.parquet(f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="field m"), read_rows(spark, f"file://{tmp_path}/bad") as reader:
        list(reader)
    assert issubclass(DecodeError, RuntimeError)


def test_batches_with_columns_of_nulls(spark, tmp_path):
    df = spark.range(40, numPartitions=4).selectExpr("id", "if(id < 20, null, id * 0.5D) AS x", "cast(null AS string) AS y", "if(id % 2 = 0, null, array(id)) AS z", "cast('2020-01-01 00:00:00' AS timestamp) AS t")
    df.write.parquet(f"file://{tmp_path}/d")
    tables = list(read_batches(spark, f"file://{tmp_path}/d", size=7))
    assert [t.num_rows for t in tables] == [7] * 5 + [5] and len({str(t.schema) for t in tables}) == 1
    assert sorted(x for t in tables for x in t["id"].to_pylist()) == list(range(40))
    q = batching.Rebatcher(3)
    q.put(pa.table({"a": pa.nulls(2)}))
    q.put(pa.table({"a": [1.5, 2.5]}))
    assert q.get()["a"].to_pylist() == [None, None, 1.5] and q.rest()["a"].to_pylist() == [2.5]


def test_loaders(spark, tmp_path):
    spark.range(1000, numPartitions=5).selectExpr("id", "array(id * 1.0F, 2.0F) AS v").write.parquet(f"file://{tmp_path}/d")
    kept = Converter(f"file://{tmp_path}/d", (), 1000)
    plain = [b["id"] for b in kept.torch_loader(spark, 64, tensor=np.asarray)]
    assert [len(b) for b in plain] == [64] * 15 + [40]
    mixed = list(kept.torch_loader(spark, 64, num_epochs=2, tensor=np.asarray, shuffle_capacity=300, seed=1))
    ids = np.concatenate([b["id"] for b in mixed])
    assert sorted(ids.tolist()) == sorted([*range(1000)] * 2) and not np.array_equal(ids[:1000], np.sort(ids[:1000])) and not np.array_equal(ids[:1000], ids[1000:])
    assert all(b["v"].shape == (len(b["id"]), 2) and np.array_equal(b["v"][:, 0], b["id"].astype(np.float32)) for b in mixed)
    loader = kept.torch_loader(spark, 10, num_epochs=None, tensor=np.asarray)
    next(loader)
    n = threading.active_count()
    loader.close()
    assert threading.active_count() <= n
    with pytest.raises(ZeroDivisionError):
        list(batching.prefetched(1 / x for x in (1, 0)))
    with pytest.raises(ValueError):
        list(batching.shuffled_batches([], 4, 2))


def test_fifo_buffer():
    b = sampling.FifoBuffer()
    b.put([1, 2])
    b.put([3])
    assert [b.get(), b.get()] == [1, 2] and b.ready()
    b.finish()
    assert b.get() == 3 and not b.ready()
    for act in (b.get, lambda: b.put([1])):
        with pytest.raises(RuntimeError):
            act()


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (9, 4, 3)])
def test_png_without_pillow(shape):
    image = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert np.array_equal(png_array(png_bytes(image)), image)


def test_png_filters():
    import struct
    import zlib

    image = np.random.default_rng(2).integers(0, 256, (5, 4, 3), dtype=np.uint8)
    raw, above = b"", np.zeros(12, int)
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        line, out = image[y].ravel().astype(int), []
        for i in range(12):
            a, b, c = (line[i - 3] if i >= 3 else 0), above[i], (above[i - 3] if i >= 3 else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((line[i] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        raw, above = raw + bytes([kind, *out]), line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert np.array_equal(png_array(data), image)
    with pytest.raises(ValueError):
        png_array(b"no")
