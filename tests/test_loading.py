"""Plans that processes read by themselves, and partitions that come to the driver in bounded pieces."""

import pickle
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rowfeed import Field, Scan, Schema
from rowfeed.functions.codecs import Image, Tensor, npy_array
from rowfeed.functions.predicates import InLambda, InSet, Negate, Split
from rowfeed.operators.transform import Transform
from rowfeed.sinks.converter import Converter
from rowfeed.sinks.writer import write_rows
from rowfeed.sources import decoding, loading
from tests.conftest import ROOT


@pytest.fixture
def data(tmp_path):
    for k in range(3):
        (tmp_path / f"k={k}").mkdir()
        rows = range(100 * k, 100 * k + 100)
        pq.write_table(pa.table({"id": list(rows), "v": [i % 7 for i in rows], "x": [[i * 0.5, 1.0] for i in rows]}), tmp_path / f"k={k}" / "f", row_group_size=10)
    return f"file://{tmp_path}"


def test_two_processes_read_disjoint_row_groups(spark, data, tmp_path):
    """Each process gets its plan as bytes, and has no Spark."""
    scan = Scan(data, ["id", "k"], seed=3, predicate=InLambda(["v"], lambda v: v != 2, python=True), filters=[("id", "<", 250)])
    code = f"import sys, pickle; sys.path.insert(0, {ROOT!r}); plan = pickle.load(sys.stdin.buffer); rows = [(r, k) for t in plan.tables(1) for r, k in zip(t['id'].to_pylist(), t['k'].to_pylist())]; sys.stdout.buffer.write(pickle.dumps(rows))"
    plans = scan.plans(spark, 2)
    got = [pickle.loads(subprocess.run([sys.executable, "-c", code], input=p.dumps(), capture_output=True, check=True).stdout) for p in plans]
    want = [(i, i // 100) for i in range(250) if i % 7 != 2]
    assert all(got) and sorted(got[0] + got[1]) == want
    assert not {i // 10 for i, _ in got[0]} & {i // 10 for i, _ in got[1]}
    assert got[0] != sorted(got[0])


def test_plans_read_what_spark_reads(spark, data):
    for scan in (Scan(data), Scan(data, ["x", "k"]), Scan(data, predicate=InSet([1], "k")), Scan(data, predicate=Negate(InSet([3, 4], "v"))), Scan(data, seed=0, shuffle_rows=True), Scan(data, shard_index=1, shard_count=4)):
        plan = scan.plan(spark)
        rows = [tuple(r.values()) for t in plan.tables() for r in t.to_pylist()]
        want = [tuple(r) for r in scan.ordered(spark).select(*scan.names(spark.read.parquet(data).columns)).collect()]
        assert sorted(map(str, rows)) == sorted(map(str, want))
        assert scan.seed is None or rows == want
    two = [t.column("id").to_pylist() for t in Scan(data, seed=5).plan(spark).tables(0)], [t.column("id").to_pylist() for t in Scan(data, seed=5).plan(spark).tables(1)]
    assert two[0] != two[1] and sorted(map(tuple, two[0])) == sorted(map(tuple, two[1]))
    for scan in (Scan(data, transform=Transform({"y": F.col("id")})), Scan(data, predicate=Split([0.5, 0.5], 0, "id")), Scan(data, key="id", group_size=10, seed=1), Scan(data, filters=[("x", "=", 1)])):
        assert scan.plan(spark) is None
    with pytest.raises(NotImplementedError):
        Scan(data, predicate=Split([0.5, 0.5], 0, "id")).plans(spark, 2)


def test_what_is_held_ahead_is_bounded(spark, data, monkeypatch):
    """With a budget of three row groups, at most so many are being read or held, and one is given out."""
    plan = Scan(data, ["id", "x"]).plan(spark)
    largest = max(plan.groups["bytes"].to_pylist())
    begun, seen = [], []
    read = loading.GroupReader.read
    monkeypatch.setattr(loading.GroupReader, "read", lambda self, *a: begun.append(1) or read(self, *a))
    for k, _ in enumerate(plan.tables(ahead_bytes=3 * largest, threads=8)):
        seen.append(len(begun) - k)
    assert len(seen) == 30 and max(seen) <= 4
    begun.clear()
    assert len(list(plan.tables(ahead_bytes=1))) == 30
    slow = plan.tables()
    next(slow)
    slow.close()
    assert len(begun) < 60


def test_numpy_batches_of_plans(spark, data):
    plan = Scan(data, ["id", "x"], seed=1).plan(spark)
    batches = list(plan.batches(64, num_epochs=2))
    assert [len(b["id"]) for b in batches] == [64, 64, 64, 64, 44] * 2 and batches[0]["x"].shape == (64, 2)
    assert sorted(np.concatenate([b["id"] for b in batches]).tolist()) == sorted([*range(300)] * 2)
    mixed = list(plan.batches(50, shuffle_capacity=100))
    assert sorted(np.concatenate([b["id"] for b in mixed]).tolist()) == list(range(300))
    kept = Converter(data, (), 300)
    assert sorted(i for p in kept.plans(spark, 3) for b in p.batches(32) for i in b["id"].tolist()) == list(range(300))


def test_large_partitions_wait_in_files(spark, tmp_path):
    """What is beyond the bound of a partition comes by the shared folder, in order."""
    df = spark.range(0, 20_000, 1, 3).selectExpr("id", "repeat('x', 10) AS s")
    found = decoding.batches_to_driver(df, inline_bytes=20_000, pack_bytes=8_000)
    sizes, got = [], []
    for b in found:
        sizes.append(b.nbytes)
        got += b.column(0).to_pylist()
    assert got == list(range(20_000)) and max(sizes) < 20_000


def test_rows_are_decoded_here_or_there(spark, tmp_path):
    schema = Schema("t", [Field("id", np.int32), Field("m", np.float32, (2, None), Tensor(), nullable=True), Field("pic", np.uint8, (6, 5, 3), Image()), Field("s", str, (), nullable=True)])
    r = np.random.default_rng(0)
    rows = [{"id": i, "m": None if i % 4 == 0 else r.random((2, i % 5)).astype(np.float32), "pic": r.integers(0, 255, (6, 5, 3), dtype=np.uint8), "s": None if i % 3 else str(i)} for i in range(40)]
    write_rows(spark, f"file://{tmp_path}/t", schema, rows, files=4)
    scan = Scan(f"file://{tmp_path}/t")
    for found in (scan.plan(spark).rows(schema), decoding.decoded_rows(scan.frame(spark), schema)):
        got = {x["id"]: x for x in found}
        for want in rows:
            x = got[want["id"]]
            assert type(x["id"]) is np.int32 and np.array_equal(x["pic"], want["pic"]) and x["s"] == want["s"] and (x["m"] is None) == (want["m"] is None)
            assert want["m"] is None or (np.array_equal(x["m"], want["m"]) and x["m"].flags.writeable)


def test_npy_bytes():
    import io

    for a in (np.arange(6).reshape(2, 3), np.asfortranarray(np.arange(6.0).reshape(2, 3)), np.zeros((0, 4), np.int8), np.array(3.5), np.array(["a", "bc"])):
        out = io.BytesIO()
        np.save(out, a)
        b = npy_array(out.getvalue())
        assert b.dtype == a.dtype and np.array_equal(a, b)
    with pytest.raises(ValueError):
        npy_array(b"no array")
