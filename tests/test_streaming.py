from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowfeed.functions.predicates import InSet
from rowfeed.streaming import stream as s


def test_stream_equals_batch(spark, sf, tmp_path):
    source = f"file://{tmp_path}/in"
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    events.where("event_id < 500").write.parquet(source)
    out = lambda: s.run_available(s.stream(spark, source, ["event_id"], InSet(["click"], "event_type")), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert out().count() == events.where("event_id < 500 and event_type = 'click'").count()
    events.where("event_id >= 500").write.mode("append").parquet(source)
    assert out().count() == events.where("event_type = 'click'").count()


@pytest.fixture
def timers(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, s.ROCKSDB)
    yield
    spark.conf.set(name, before)


def plain_pairs(rows, threshold):
    out = []
    for user in {u for u, _, _ in rows}:
        mine = sorted((t, i) for u, t, i in rows if u == user)
        out += [(user, a[1], b[1], 1000 * (b[0] - a[0])) for a, b in zip(mine, mine[1:]) if b[0] - a[0] <= threshold]
    return sorted(out)


def test_pairs_out_of_order_equal_the_batch(spark, timers, tmp_path):
    """Rows that come late, but before the watermark, are put in order; those behind it are dropped; what follows the last watermark waits."""
    source, schema = f"file://{tmp_path}/in", "user bigint, sec bigint, id bigint"
    batches = [
        [(1, 1000, 1), (1, 1010, 2), (2, 1003, 3), (3, 1000, 20)],
        [(1, 1005, 4), (2, 1001, 5), (1, 1020, 6)],  # earlier than rows before, within the lateness
        [(1, 1400, 7), (2, 1395, 8)],
        [(1, 1100, 9), (2, 1350, 10), (1, 1402, 11)],  # 9 is behind the watermark
        [(9, 9000, 12)],
        [(9, 9001, 13)],
    ]
    got = []
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("sec")).write.mode("append").parquet(source)
        made = s.pairs(s.stream(spark, source), "user", "ts", "id", 12_000, "1 minute")
        got = s.run_available(made, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    want = plain_pairs([r for b in batches for r in b if r[2] not in (9, 12, 13)], 12)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 4


def test_timers_need_their_store(spark, tmp_path):
    spark.range(1).select("id", F.timestamp_seconds("id").alias("ts")).write.parquet(f"file://{tmp_path}/in")
    with pytest.raises(RuntimeError):
        s.pairs(s.stream(spark, f"file://{tmp_path}/in"), "id", "ts", "id", 1, "1 minute")


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_streams_joined_equal_the_batch(spark, tmp_path, how):
    """Rows out of order on either side match; rows behind the watermark are dropped on either side."""
    sides = {"l": f"file://{tmp_path}/l", "r": f"file://{tmp_path}/r"}
    batches = [
        {"l": [(1, 1000, 1), (2, 1000, 2)], "r": [(1, 1005, 51), (2, 1300, 52)]},
        {"l": [(1, 1030, 3), (2, 990, 4)], "r": [(2, 985, 53), (1, 1025, 54)]},
        {"l": [(1, 2000, 5)], "r": [(1, 2005, 55)]},
        {"l": [(1, 1001, 6), (2, 1950, 7)], "r": [(1, 1002, 56), (2, 1960, 57)]},  # 6 and 56 are behind the watermark
        {"l": [(9, 9000, 8)], "r": [(9, 9100, 58)]},
        {"l": [(9, 9001, 9)], "r": [(9, 9101, 59)]},
    ]
    got = None
    for batch in batches:
        for side, rows in batch.items():
            spark.createDataFrame(rows, "k bigint, sec bigint, id bigint").withColumn("ts", F.timestamp_seconds("sec")).write.mode("append").parquet(sides[side])
        left, right = (s.stream(spark, sides[x]) for x in "lr")
        both = s.near_in_time(left, right, ["k"], "ts", "ts", "10 seconds", "20 seconds", "1 minute", "1 minute", how)
        got = s.run_available(both.select("id", "id_right"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    left, right = ([r for b in batches for r in b[x] if r[2] not in (6, 56)] for x in "lr")
    want = {(a[2], b[2]) for a in left for b in right if a[0] == b[0] and -10 <= b[1] - a[1] <= 20}
    if how == "left_outer":  # those of the last time wait for the watermark
        want |= {(a[2], None) for a in left if a[1] < 9000 and a[2] not in {x for x, _ in want}}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 4


def test_windows_and_unique(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    rows = spark.createDataFrame([(1, 10), (1, 10), (2, 70), (3, 4000)], "id int, sec int").select("id", F.timestamp_seconds("sec").alias("ts"), F.lit(1).alias("v"))
    rows.write.parquet(source)
    first = s.run_available(s.unique(s.stream(spark, source), ["id"], "ts", "1 minute"), f"file://{tmp_path}/u", f"file://{tmp_path}/cu")
    assert first.count() == 3
    for name, df in (("t", s.tumbling(s.stream(spark, source), "ts", "1 minute", "1 minute", ["id"], "v")), ("s", s.sessions(s.stream(spark, source), "ts", "1 minute", "1 minute", ["id"]))):
        got = s.run_available(df, f"file://{tmp_path}/{name}", f"file://{tmp_path}/c{name}")
        assert {r.id: r.n for r in got.collect()} == {1: 2, 2: 1}
    assert s.sliding(s.stream(spark, source), "ts", "2 minutes", "1 minute", "1 minute", ["id"], "v").isStreaming


def test_pairs_make_frames_for_pairs_only():
    """Keys without a pair give no frame, not an empty one."""

    class State:
        def __init__(self):
            self.kept = None

        def get(self):
            return self.kept

        def exists(self):
            return self.kept is not None

        def put(self, rows):
            self.kept = rows

        update = put

        def appendList(self, rows):  # noqa: N802
            self.kept = [*(self.kept or []), *rows]

        def clear(self):
            self.kept = None

    made = s._Pairs(10, "bigint")
    timers = []
    made.open, made.last, made.handle = State(), State(), SimpleNamespace(registerTimer=timers.append)
    at = lambda now: SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
    assert list(made.handleInputRows((7,), iter([pd.DataFrame({"ms": [30, 5], "item": [3, 1]})]), at(0))) == [] and timers == [6]
    assert list(made.handleExpiredTimer((7,), at(8), None)) == []
    assert made.open.get() == [(30, 3)] and made.last.get() == (5, 1) and timers[1:] == [31, 16]
    assert list(made.handleInputRows((7,), iter([pd.DataFrame({"ms": [12], "item": [2]})]), at(8))) == []
    [frame] = made.handleExpiredTimer((7,), at(20), None)
    assert frame.values.tolist() == [[7, 1, 2, 7]] and made.open.get() == [(30, 3)] and made.last.get() == (12, 2)
    assert list(made.handleExpiredTimer((7,), at(100), None)) == [] and made.open.get() is None and made.last.get() is None
