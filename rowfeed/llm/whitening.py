"""Whitening of embeddings: principal components by a randomised range finder, projected and scaled to unit variance.

An entry c becomes the integer floor(1024 * c) + 100000, so counts, sums and squared deviations are exact. Rows are centred before they
are multiplied: a pass over all rows gives V * Q, V their covariance (divisor n) and Q a block of directions, at first random and
OVERSAMPLING more than the components asked for. Power passes repeat this with the block made orthonormal; Rayleigh-Ritz in the block's span gives
eigenpairs, and the residual |V * u - e * u| of each says whether it is right to double precision. If after POWER_PASSES the residuals of
the components fail, the block is doubled, at last to the full dimension, where Rayleigh-Ritz is exact and one pass is enough.

A pass is a job: a task sums its rows' products, Spark adds them by position (a row a matrix entry and task, combined before and after
the shuffle), and the driver gets the block, at most dimension * dimension numbers. No rows come to the driver. The input is read once a pass.

Defined results: rows whose vector is null, or holds null, NaN, an infinity or an entry of 2^40 or more, are left out, as are those that
haven't the most frequent length (of equally frequent ones the longest); repeated rows and ids stay, each with its own result; a component
without variance (e at most 64 units of rounding of the greatest) has whitened and explained 0 and isn't counted in identity_error; deviation is
null where it exceeds a long; with fewer dimensions than 8 there are as many components; an empty table gives an empty result; further columns
are not read. The sign of a component makes its entry of greatest size positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowfeed.llm.common import map_stream

SCALE, SHIFT = 1024, 100_000
#: The greatest size of an entry, so that its integer and sums of 10^9 rows are exact.
LARGEST = float(1 << 40)
COMPONENTS, OVERSAMPLING, POWER_PASSES, SEED = 8, 8, 4, 12
#: A residual of at most this share of the greatest eigenvalue is rounding.
TOLERANCE = 1e-13
#: Rows that are multiplied at a time.
BLOCK = 4096


def _integers(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that remain, and their vectors as integers."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((lengths == dimension) & ~vectors.is_null().to_numpy(zero_copy_only=False))
    flat = vectors.take(pa.array(rows)).flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dimension)  # null becomes NaN
    good = (np.abs(values) < LARGEST).all(axis=1)
    return rows[good], np.floor(SCALE * values[good]).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part, *_integers(part.column(column), dimension)


def _added(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], kind: str) -> list:
    """Arrays of all tasks added by position: [(position, sum)]. Tasks without rows give None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fn(batches)
        if out is not None:
            flat = np.ascontiguousarray(out).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "value"])

    return map_stream(df, run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect()


def _array(rows: list, shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(int(np.prod(shape)), dtype=np.float64)
    for r in rows:
        out[r.at] = r.value
    return out.reshape(shape)


def dimension_of(vectors: DataFrame, column: Column) -> int:
    """The most frequent length of a vector without nulls in it; 0 if there is none."""
    sized = vectors.select(F.when(~F.exists(column, lambda c: c.isNull()), F.size(column)).alias("size")).where("size > 0")
    top = sized.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return top[0]["size"] if top else 0


@dataclass
class Components:
    """n, exact sums, components (a row each) with eigenvalues, the trace, and how they were found."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    width: int

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e), 0 for components without variance."""
        least = 64 * np.finfo(float).eps * (self.values[0] if len(self.values) else 0)
        return np.array([1 / np.sqrt(e) if e > least else 0.0 for e in self.values])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, with the difference taken in integers."""
    return (n * x - sums) / n


def find_components(vectors: DataFrame, column: str, dimension: int, components: int = COMPONENTS, oversampling: int = OVERSAMPLING) -> Components:
    source = vectors.select(F.col(f"`{column}`").alias("v"))

    def counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros(dimension + 1, dtype=np.int64)
        for _, rows, x in _blocks(batches, 0, dimension):
            total[0] += len(rows)
            total[1:] += x.sum(axis=0)
        return total if total[0] else None

    exact = {r.at: r.value for r in _added(source, counts, "bigint")}
    n, sums = exact.get(0, 0), np.array([exact.get(k + 1, 0) for k in range(dimension)], dtype=np.int64)
    if n == 0:
        return Components(0, sums, np.zeros((0, dimension)), np.zeros(0), 0.0, 0, 0)

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        """V * q and the trace of V."""

        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            total, trace, any_rows = np.zeros(q.shape), 0.0, False
            for _, rows, x in _blocks(batches, 0, dimension):
                c = _centred(x, n, sums)
                total += c.T @ (c @ q) / n
                trace += float((c * c).sum()) / n
                any_rows |= len(rows) > 0
            return np.append(total.reshape(-1), trace) if any_rows else None

        got = _array(_added(source, run, "double"), (q.size + 1,))
        return got[:-1].reshape(q.shape), float(got[-1])

    wanted, rng, passes = min(components, dimension), np.random.default_rng(SEED), 0
    width = min(components + oversampling, dimension)
    basis = rng.standard_normal((dimension, width))
    while True:
        full = width == dimension
        basis = np.eye(dimension) if full else np.linalg.qr(basis)[0]
        for _ in range(1 if full else POWER_PASSES):
            image, trace = product(basis)
            passes += 1
            small = basis.T @ image
            values, turn = np.linalg.eigh((small + small.T) / 2)
            order = np.argsort(-values, kind="stable")[:wanted]
            values, found = np.maximum(values[order], 0.0), basis @ turn[:, order]
            residuals = np.linalg.norm(image @ turn[:, order] - found * values, axis=0)
            right = bool((residuals <= TOLERANCE * max(values[0], 0.0)).all())
            if right or full:
                signs = np.sign(found[np.argmax(np.abs(found), axis=0), np.arange(wanted)])
                return Components(n, sums, (found * np.where(signs == 0, 1, signs)).T, values, trace, passes, width)
            basis = np.linalg.qr(image)[0]
        width = min(2 * width, dimension)
        basis = np.concatenate([basis, rng.standard_normal((dimension, width - basis.shape[1]))], axis=1)


def _identity_error(source: DataFrame, c: Components, dimension: int) -> float:
    """The largest entry of the whitened rows' covariance less the identity. Tasks give count, mean and centred products; these are joined about the mean of all."""
    k = len(c.values)
    n, sums, project = c.n, c.sums, c.vectors.T * c.scales

    def mean(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros(k)
        for _, _, x in _blocks(batches, 0, dimension):
            total += (_centred(x, n, sums) @ project).sum(axis=0)
        return total / n

    middle = _array(_added(source, mean, "double"), (k,))

    def covariance(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((k, k))
        for _, _, x in _blocks(batches, 0, dimension):
            z = _centred(x, n, sums) @ project - middle
            total += z.T @ z / n
        return total

    error = np.abs(_array(_added(source, covariance, "double"), (k, k)) - np.eye(k))
    has = c.scales > 0
    return float(error[has][:, has].max()) if has.any() else 0.0


WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    source = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{column}`").alias("v"))
    dimension = dimension_of(source, F.col("v"))
    if dimension == 0:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    c = find_components(source, "v", dimension, components)
    error = _identity_error(source.select("v"), c, dimension)
    n, sums, k = c.n, c.sums, len(c.values)
    project = c.vectors.T * c.scales
    explained = c.values * (c.scales > 0) / (c.trace or 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, x in _blocks(batches, 1, dimension):
            if len(rows) == 0:
                continue
            far = n * x - sums
            size = (far.astype(np.float64) ** 2).sum(axis=1)
            deviation = pa.array((far * far).sum(axis=1), mask=size > 9.2e18)
            each = np.repeat(np.arange(len(rows)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(each), n)),
                    deviation.take(pa.array(each)), pa.array((far / n @ project).reshape(-1)), pa.array(np.tile(explained, len(rows))), pa.array(np.full(len(each), error)),
                ],
                names=[f.split()[0] for f in WHITENED.split(", ")],
            )

    return map_stream(source, run, WHITENED)
