"""Files and row groups that a scan opens: none is lost, none is read in vain. Parts that must not be read are overwritten, so that a read of them fails."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rowfeed import Scan
from rowfeed.functions.predicates import InLambda, InSet, InVector, Negate, Reduce
from rowfeed.operators.ngram import NGram
from rowfeed.operators.sampling import NoDataError
from rowfeed.sources import rowgroups


def spoil(path, keep):
    """Overwrite the column chunks of row groups that `keep(row group, column)` doesn't spare."""
    meta = pq.read_metadata(path)
    with open(path, "r+b") as f:
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                chunk = meta.row_group(g).column(c)
                if not keep(g, chunk.path_in_schema):
                    start = min(o for o in (chunk.dictionary_page_offset, chunk.data_page_offset) if o)
                    f.seek(start)
                    f.write(b"\xff" * chunk.total_compressed_size)


@pytest.fixture
def foreign(tmp_path):
    """A folder as other writers leave it: names without a suffix, mixed suffixes, hidden and empty files, a folder below."""
    for k, name in enumerate(("000000_0", "000001_0", "part.parquet", "x.parq", "y.snappy")):
        pq.write_table(pa.table({"id": list(range(20 * k, 20 * k + 20))}), tmp_path / name, row_group_size=8)
    for name in ("_hidden", ".other", "_SUCCESS"):
        (tmp_path / name).write_bytes(b"no parquet")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "below").mkdir()
    pq.write_table(pa.table({"id": [10_000]}), tmp_path / "below" / "000000_0")
    return f"file://{tmp_path}"


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_no_file_is_lost(spark, foreign):
    os.remove(foreign[7:] + "/empty")
    plain = ids(spark.read.parquet(foreign))
    assert plain == list(range(100))
    assert ids(rowgroups.physical(spark, foreign)) == plain
    scan = Scan(foreign, ["id"])
    assert sorted(x for i in range(4) for x in ids(scan.where(shard_index=i, shard_count=4).frame(spark))) == plain
    assert ids(scan.where(seed=3).ordered(spark)) == plain
    windows = scan.where(ngram=NGram({0: ["id"], 1: ["id"]}, 1, "id")).frame(spark).collect()
    assert len(windows) == 5 * (7 + 7 + 3)


def test_empty_files_have_no_groups(spark, foreign):
    assert rowgroups.manifest(spark, foreign).count() == 15


def test_more_shards_than_row_groups(spark, tmp_path):
    pq.write_table(pa.table({"id": list(range(100))}), tmp_path / "a", row_group_size=50)
    scan = Scan(f"file://{tmp_path}", ["id"], shard_index=0, shard_count=7)
    with pytest.raises(NoDataError):
        scan.frame(spark)
    assert len(ids(scan.where(shard_count=2).frame(spark))) == 50


@pytest.fixture
def parts(tmp_path):
    for k in range(4):
        (tmp_path / f"k={k}").mkdir()
        rows = range(100 * k, 100 * k + 100)
        pq.write_table(pa.table({"id": list(rows), "v": [i % 10 for i in rows], "s": [f"s{i:04d}" for i in rows], "x": [i * 0.5 for i in rows], "wide": ["w" * 50 + str(i) for i in rows]}), tmp_path / f"k={k}" / "f", row_group_size=25)
    return f"file://{tmp_path}"


def test_partitions_are_decided_before_the_read(spark, parts):
    for k in (0, 2, 3):
        spoil(f"{parts[7:]}/k={k}/f", lambda g, c: False)
    for keep in (InSet([1], "k"), InLambda(["k"], lambda k: k == 1), InLambda(["k"], lambda k: k == 1, python=True), Negate(InSet([0, 2, 3], "k")), InVector(["k"], lambda f: f.k == 1)):
        scan = Scan(parts, ["id"], predicate=keep)
        shards = [ids(scan.where(shard_index=i, shard_count=3).frame(spark)) for i in range(3)]
        assert sorted(x for s in shards for x in s) == list(range(100, 200)) and all(shards)
        assert ids(scan.where(seed=1).ordered(spark)) == list(range(100, 200))
    both = Reduce([InSet([1], "k"), InSet([3], "v")], all)
    assert ids(Scan(parts, ["id"], predicate=both, seed=1).frame(spark)) == list(range(103, 200, 10))
    with pytest.raises(Exception, match=r"."):
        Scan(parts, ["id"], seed=1).frame(spark).collect()


@pytest.mark.parametrize(
    ("filters", "predicate", "groups", "want"),
    [
        ([("id", "<", 30)], None, {(0, 0), (0, 1)}, range(30)),
        ([[("id", "<", 5)], [("k", "=", 3), ("id", ">=", 390)]], None, {(0, 0), (3, 3)}, [*range(5), *range(390, 400)]),
        ([("s", "=", "s0260")], None, {(2, 2)}, [260]),
        ([("x", "<=", 1.0)], None, {(0, 0)}, [0, 1, 2]),
        (None, InSet([7, 399], "id"), {(0, 0), (3, 3)}, [7, 399]),
        (None, Reduce([InSet([7], "id"), InSet(["s0300"], "s")], any), {(0, 0), (3, 0)}, [7, 300]),
    ],
)
def test_footers_rule_out_row_groups(spark, parts, filters, predicate, groups, want):
    for k in range(4):
        spoil(f"{parts[7:]}/k={k}/f", lambda g, c, k=k: (k, g) in groups)
    assert ids(Scan(parts, ["id"], filters=filters, predicate=predicate, seed=0).frame(spark)) == list(want)


@pytest.mark.parametrize("keep", [InLambda(["v", "id"], lambda v, i: v == 3 and 100 <= i < 125, python=True), InVector(["v", "id"], lambda f: (f.v == 3) & (f.id >= 100) & (f.id < 125)), Reduce([InSet([3], "v"), InLambda(["id"], lambda i: 100 <= i < 125, python=True)], all)])
def test_other_columns_are_read_where_rows_are_kept(spark, parts, keep):
    """Of row groups without a row to keep, only the predicate's columns are read."""
    for k in range(4):
        spoil(f"{parts[7:]}/k={k}/f", lambda g, c, k=k: c in ("v", "id") or (k, g) == (1, 0))
    got = Scan(parts, ["id", "wide", "k"], predicate=keep, seed=5).frame(spark).collect()
    assert sorted((r.id, r.wide, r.k) for r in got) == [(i, "w" * 50 + str(i), 1) for i in (103, 113, 123)]


def test_masks_equal_columns(spark, tmp_path):
    """In a task and in Spark, predicates keep the same rows, with nulls and numbers out of a column's range."""
    table = pa.table({"a": pa.array([1, None, 3, 127, -128] * 4, pa.int8()), "s": ["x", None, "", "y", "x"] * 4, "x": [0.5, None, float("nan"), 2.0, -1.0] * 4})
    pq.write_table(table, tmp_path / "f", row_group_size=7)
    url = f"file://{tmp_path}"
    tried = [InSet([1, 300], "a"), InSet([None, 3], "a"), InSet([], "a"), InSet(["x", None], "s"), InSet(["z"], "s"), InSet([0.5], "x"), InLambda(["a", "s"], lambda a, s: a is None or s == "x", python=True), InVector(["x"], lambda f: f.x > 0)]
    tried += [Negate(p) for p in tried] + [Reduce(tried[:3], any), Reduce([tried[1], Negate(tried[3])], lambda flags: sum(flags) == 1)]
    for p in tried:
        want = sorted(map(str, Scan(url, predicate=p).frame(spark).collect()))
        assert sorted(map(str, Scan(url, predicate=p, seed=2).frame(spark).collect())) == want
    clauses = [[("a", op, v)] for op, v in (("<", 3), ("<=", 1), (">", 3), (">=", 200), ("=", 3), ("!=", 3), ("in", [1, 300]), ("not in", [1, 3]))]
    clauses += [[("x", op, 0.5)] for op in ("<", ">", "=", "!=", ">=")] + [[("s", ">", "x")], [[("a", "=", 1)], [("x", ">", 1.0)]]]
    for c in clauses:
        want = sorted(map(str, Scan(url, filters=c).frame(spark).collect()))
        assert sorted(map(str, Scan(url, filters=c, seed=2).frame(spark).collect())) == want


def exchanged(df):
    """Whether rows are shuffled after they are read: an exchange above the task's read in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" in plan[: plan.rindex("MapInArrow")]


def test_seeded_reads_move_no_rows(spark, parts):
    scan = Scan(parts, ["id"], seed=7, shuffle_rows=True)
    orders = []
    for epoch in (0, 1):
        df = scan.ordered(spark, epoch)
        assert not exchanged(df)
        got = [r.id for r in df.collect()]
        assert got == [r.id for r in df.repartition(1).sortWithinPartitions(F.lit(1)).collect()] or sorted(got) == list(range(400))
        blocks = [sorted(got[i : i + 25]) for i in range(0, 400, 25)]
        assert all(b == list(range(b[0], b[0] + 25)) and b[0] % 25 == 0 for b in blocks)
        assert [b[0] for b in blocks] != sorted(b[0] for b in blocks) and got[:25] != blocks[0]
        orders.append(got)
    assert orders[0] != orders[1] and orders[0] == [r.id for r in scan.ordered(spark, 0).collect()]
    plain = [r.id for r in scan.where(shuffle_rows=False).ordered(spark).collect()]
    assert all(plain[i : i + 25] == sorted(plain[i : i + 25]) for i in range(0, 400, 25))


@pytest.mark.parametrize("overlap", [True, False])
def test_windows_as_read_equal_windows(spark, tmp_path, overlap):
    r = np.random.default_rng(1)
    for k in range(3):
        n = 40 + k
        ts = r.integers(0, 60, n)
        pq.write_table(pa.table({"t": pa.array([None if i % 17 == 3 else int(x) for i, x in enumerate(ts)], pa.int64()), "id": list(range(100 * k, 100 * k + n)), "y": [f"y{i}" for i in range(n)]}), tmp_path / f"{k}", row_group_size=19)
    for spec in (NGram({0: ["id", "t"], 1: ["y"]}, 3, "t", overlap), NGram({-1: ["id"], 2: ["id", "y"]}, 4, "t", overlap), NGram({0: ["id"]}, 0, "t", overlap)):
        got = Scan(f"file://{tmp_path}", ngram=spec).frame(spark)
        assert not exchanged(got)
        rows = rowgroups.physical(spark, f"file://{tmp_path}", place=("at", "size"))
        want = spec.windows(rows, ["rg"], ["at"])
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    short = NGram({0: ["id"], 100: ["id"]}, 1000, "t", overlap)
    assert Scan(f"file://{tmp_path}", ngram=short).frame(spark).count() == 0
