"""Whitening of embeddings: the principal components of whole-number vectors, scaled to unit variance and checked.

Each partition of the distinct vectors gives its count, local mean and centred scatter matrix; a tree of pairwise merges
(Chan's formula) brings them together. What reaches the driver is one such summary, of the size of a covariance matrix.
A second pass merges the covariance of the whitened vectors in the same way and holds it against the identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import materialize

COMPONENTS = 4
SCALE = 256
SLICE = 4096
_LONG = 1 << 63


@dataclass
class Moments:
    """Count, exact sums (of whole numbers), mean and centred scatter of some vectors."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    scatter: np.ndarray


def moments_of(x: np.ndarray, sums: list[int] | None = None) -> Moments:
    mean = x.mean(0, dtype=np.float64)
    centred = x - mean
    return Moments(len(x), sums, mean, centred.T @ centred)


def widen(m: Moments, width: int) -> Moments:
    """The same vectors filled with zeros to width."""
    more = width - len(m.mean)
    if not more:
        return m
    return Moments(m.n, m.sums and m.sums + [0] * more, np.pad(m.mean, (0, more)), np.pad(m.scatter, ((0, more), (0, more))))


def merge(a: Moments, b: Moments) -> Moments:
    """Chan's pairwise merge; either side may be empty or narrower."""
    if not a.n or not b.n:
        return b if not a.n else a
    width = max(len(a.mean), len(b.mean))
    a, b = widen(a, width), widen(b, width)
    n, step = a.n + b.n, b.mean - a.mean
    sums = None if a.sums is None else [x + y for x, y in zip(a.sums, b.sums, strict=True)]
    return Moments(n, sums, a.mean + step * (b.n / n), a.scatter + b.scatter + np.outer(step, step) * (a.n * (b.n / n)))


EMPTY = Moments(0, None, np.zeros(0), np.zeros((0, 0)))


def whole_numbers(vector: Column) -> Column:
    """floor(256 * c) of each component as a long (which it fills at its bounds), or null for a vector that is null or holds null or non-finite entries."""
    usable = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & usable, F.transform(vector, lambda v: F.floor(v * F.lit(float(SCALE)))))


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists of longs as a matrix; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(n), max(width, int(n.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def exact_sums(x: np.ndarray) -> list[int]:
    if len(x) * float(np.abs(x.astype(np.float64)).max(initial=0)) < 1 << 62:
        return [int(v) for v in x.sum(0)]
    return [sum(map(int, c)) for c in x.T]


def tree_merge(df: DataFrame, moments: Callable[[np.ndarray], Moments]) -> Moments:
    """Moments of all rows of df (x array<long>): slices are merged within each partition, partitions in a tree."""
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = EMPTY
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                total = merge(total, moments(matrix(batch.column("x").slice(i, SLICE))))
        if total.n:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["m"])

    parts = df.select("x").mapInArrow(partition, "m binary").rdd.map(lambda r: pickle.loads(r["m"]))
    return parts.union(df.sparkSession.sparkContext.parallelize([EMPTY], 1)).treeReduce(merge)


def principal(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, projection, share): the mean as sums / n; the unit eigenvectors of the covariance over the roots of their eigenvalues; eigenvalues over the trace.

    Components without variance, to double precision, can't be scaled and are left out.
    """
    if not m.n or not len(m.mean):
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    cov = m.scatter / m.n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1][:COMPONENTS], vectors[:, ::-1][:, :COMPONENTS]
    real = values > max(values[0], 0) * len(m.mean) * np.finfo(float).eps
    mean = np.array([s / m.n for s in m.sums])
    return mean, vectors[:, real] / np.sqrt(values[real]), values[real] / np.trace(cov)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of (n * x - sums) ** 2 of each row, exactly; None beyond a long."""
    if not len(x):
        return []
    most = max(float(np.abs(x.astype(np.float64)).max(initial=0)), 1.0)
    top = max(map(abs, sums), default=0)
    if (n * most + top) ** 2 * x.shape[1] < _LONG / 2:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    if most ** 2 * x.shape[1] < _LONG / 2 and most * top * x.shape[1] < _LONG / 2:
        own, cross, all_sums = (x ** 2).sum(1).tolist(), (x @ np.array(sums, np.int64)).tolist(), sum(s * s for s in sums)
        out = [n * n * a - 2 * n * b + all_sums for a, b in zip(own, cross, strict=True)]
    else:
        out = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    return [v if v < _LONG else None for v in out]


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row with a usable vector and each of the first four components.

    A vector that is null or holds null or non-finite entries is no usable one. Entries become floor(256 * c), which fills
    a long at its bounds. The fit list holds each distinct vector once, so copies weigh nothing; n is its length, and n and
    all sums are exact. deviation is null where it doesn't fit a long. A null or repeated id is a row like any other;
    shorter vectors are filled with zeros; components without variance are left out, so a table with fewer than two distinct
    vectors, or none, gives no rows. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col).cast("array<double>")).alias("x")).where("x IS NOT NULL")
    fit = materialize(rows.groupBy("x").agg(F.count("*").alias("copies")).select("x"), "fit")
    total = tree_merge(fit, lambda x: moments_of(x, exact_sums(x)))
    mean, projection, share = principal(total)
    width, k, n, sums = len(mean), projection.shape[1], total.n, total.sums

    def project(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ projection

    error = 0.0
    if k:
        again = tree_merge(fit, lambda x: moments_of(project(np.pad(x, ((0, 0), (0, width - x.shape[1]))))))
        error = float(np.abs(again.scatter / again.n - np.eye(k)).max())

    def components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows if k else 0, SLICE):
                part = batch.slice(i, SLICE)
                x = matrix(part.column("x"), width)
                m = len(x)
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                    pa.array(deviations(x, n, sums), pa.int64()).take(row), pa.array(project(x).reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    names=[c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(components, RESULT)
