"""Whitening against the full covariance, computed with exact integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowfeed.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def exact(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    far = len(x) * x - x.sum(axis=0)
    centred = far / len(x)
    values, turn = np.linalg.eigh(centred.T @ centred / len(x))
    return [sum(int(v) ** 2 for v in row) for row in far], centred, values[::-1], turn[:, ::-1]


def compare(rows, vectors):
    deviation, centred, values, turn = exact(vectors)
    k = min(8, len(values))
    assert len(rows) == len(vectors) * k
    want = centred @ turn[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        got = {r.vec_id: r for r in rows if r.component == c + 1}
        assert [got[i].deviation for i in range(len(vectors))] == deviation
        mine = np.array([got[i].whitened for i in range(len(vectors))])
        assert min(np.abs(mine - want[:, c]).max(), np.abs(mine + want[:, c]).max()) < 1e-7
        assert all(abs(r.explained - values[c] / values.sum()) < 1e-9 and r.identity_error < 1e-9 and r.n == len(vectors) for r in got.values())


def test_table_equals_full_covariance(spark, sf):
    source = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id")
    vectors = [r.embedding for r in source.collect()]
    compare(whitening.whiten(source.withColumn("vec_id", F.col("vec_id") - source.agg(F.min("vec_id")).first()[0])).collect(), vectors)


def test_falling_spectrum_needs_no_full_dimension(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((300, 60)) * 10.0 ** -np.linspace(-1, 12, 60)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    c = whitening.find_components(frame, "embedding", 60)
    assert c.width == 16 and c.passes <= whitening.POWER_PASSES
    compare(whitening.whiten(frame).collect(), vectors)


def test_flat_spectrum_expands_to_full_dimension(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((500, 40)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(7)
    assert whitening.find_components(frame, "embedding", 40).width == 40
    compare(whitening.whiten(frame).collect(), vectors)


def test_rows_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], [3.0, -1.0]]
    rows = [(i, v) for i, v in enumerate(good)] + [(9, None), (10, [1.0, None]), (11, [nan, 1.0]), (12, [inf, 1.0]), (13, []), (14, [1.0]), (15, [1e30, 0.0]), (None, None)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", component int, v string")
    got = whitening.whiten(frame).collect()
    compare(got, good)
    assert whitening.whiten(frame.limit(0)).count() == 0 and whitening.whiten(frame.where("vec_id = 9")).count() == 0


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_no_variance(spark, vectors):
    got = whitening.whiten(spark.createDataFrame([(None, v) for v in vectors], SCHEMA)).collect()
    assert len(got) == 2 * len(vectors)
    assert all((r.deviation, r.whitened, r.explained, r.identity_error, r.vec_id) == (0, 0.0, 0.0, 0.0, None) for r in got)


def test_component_without_variance(spark):
    vectors = [[float(i), 1.0, float(-i)] for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA)).collect()
    assert {r.component: round(r.explained, 9) for r in got} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert all(r.identity_error < 1e-9 and (r.component == 1 or r.whitened == 0) for r in got)


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(2**38 * (i % 2)), 1.0]) for i in range(4)]
    assert all(r.deviation is None for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect())
