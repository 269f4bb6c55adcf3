"""Whitening of embeddings: moments merged by Chan's formula, eigenvectors, and a second pass that verifies.

Every entry c of a vector becomes the whole number x = floor(64 * c) + 1000000, so that sums are exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
#: Steps of one unit of an entry, and what is added to make numbers positive.
STEPS, SHIFT = 64, 1_000_000
#: Rows worked on at once, which bounds a task's memory besides Arrow's batch.
ROWS = 4096
_LONG = (1 << 63) - 1


@dataclass
class Moments:
    """count; sums of whole numbers, exact (Python's) or of doubles; scatter about the mean."""

    count: int
    sums: np.ndarray
    scatter: np.ndarray

    def merge(self, other: Moments) -> Moments:
        """Chan's pairwise formula.  The difference of the two means comes from the exact sums, so that
        means of a million lose nothing."""
        if not self.count or not other.count:
            return self if self.count else other
        a, b = self.count, other.count
        apart = ((other.sums * a - self.sums * b) / (a * b)).astype(np.float64)
        return Moments(a + b, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (a * b / (a + b)))


def whole_moments(x: np.ndarray) -> Moments:
    """Moments of whole numbers, rows are vectors."""
    n, least = len(x), x.min(axis=0)
    y = x - least
    exact = y.astype(object) if int(y.max(initial=0)) > _LONG // n else y
    above = exact.sum(axis=0)
    d = y - above.astype(np.float64) / n
    return Moments(n, least.astype(object) * n + above.astype(object), d.T @ d)


def double_moments(z: np.ndarray) -> Moments:
    mean = z.mean(axis=0)
    d = z - mean
    return Moments(len(z), mean * len(z), d.T @ d)


@dataclass
class Whitening:
    """n, sums (exact) and scatter's eigenvalues and unit eigenvectors (columns), by falling eigenvalue.

    A component whose eigenvalue isn't above rounding, ``dims * 2**-52`` of the largest, has no
    direction of its own: its whitened values are null and it takes no part in ``identity_error``.
    """

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @staticmethod
    def of(m: Moments, components: int) -> Whitening:
        cov = m.scatter / m.count
        cov = (cov + cov.T) / 2
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        # the entry of greatest size is positive, so that a rerun has the same signs
        top = np.argmax(np.abs(vectors) > np.abs(vectors).max(axis=0) * (1 - 1e-9), axis=0)
        vectors = vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        return Whitening(m.count, m.sums, np.maximum(values, 0.0), vectors, float(np.trace(cov)))

    @property
    def proper(self) -> np.ndarray:
        return self.values > self.values.max(initial=0.0) * len(self.sums) * 2.0**-52

    @property
    def explained(self) -> np.ndarray:
        """Share of the trace; 0 where all vectors are equal."""
        return self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))

    def _times_n(self, x: np.ndarray) -> tuple[np.ndarray, bool]:
        """n*x - sums, exact, and whether it fits 64 bits (else Python's numbers)."""
        base = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s - self.n * int(b) for s, b in zip(self.sums, base, strict=True)], dtype=np.int64)
        away = x - base
        if (int(np.abs(away).max(initial=0)) + 1) * self.n <= _LONG:
            return away * self.n - rest, True
        return away.astype(object) * self.n - rest.astype(object), False

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values; NaN for components without a direction."""
        y = self._times_n(x)[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.proper, (y / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n*x - sums)^2; None beyond 64 bits."""
        y, small = self._times_n(x)
        if small and int(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) <= _LONG:
            return (y * y).sum(axis=1).tolist()
        return [v if v <= _LONG else None for v in (int(sum(int(e) ** 2 for e in row)) for row in y)]


def usable(vec: Column) -> Column:
    """Not null, not empty, and all entries finite numbers."""
    entry = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce((F.size(vec) > 0) & ~F.exists(vec, entry), F.lit(False))


def whole_entries(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the usable vectors.  Entries beyond 2**46 in size count as that, for x to be exact."""
    doubles = F.col(vec_col).cast("array<double>")
    most = float(1 << 46)
    rows = df.select(F.col(id_col).alias("id"), doubles.alias("v")).filter(usable(F.col("v")))
    return rows.select("id", F.transform("v", lambda c: F.floor(F.least(F.greatest(c, F.lit(-most)), F.lit(most)) * STEPS) + F.lit(SHIFT).cast("long")).alias("x"))


def _matrix(column: pa.Array, lo: int, hi: int) -> np.ndarray:
    part = column.slice(lo, hi - lo)
    return part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _summary(rows: DataFrame, of: Callable[[np.ndarray], Moments]) -> Moments:
    """Moments of all vectors, one at least: a summary of each partition, merged in a tree whose last few meet on the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                own = of(_matrix(b.column(0), lo, min(lo + ROWS, b.num_rows)))
                held = own if held is None else held.merge(own)
        if held is not None:
            yield pa.record_batch([pa.array([pickle.dumps(held)], pa.binary())], names=["held"])

    return rows.select("x").mapInArrow(local, "held binary").rdd.map(lambda r: pickle.loads(r[0])).treeReduce(Moments.merge)


def fit(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening learned from all usable vectors of the usual length; None if there are none.

    First pass: each partition's count, sums and centred scatter, merged pairwise in a tree; eigenvectors
    on the driver.  Second pass: the covariance of the whitened vectors themselves, again merged;
    ``identity_error`` is its largest distance from the identity.  A summary is dims * dims doubles, so
    the driver's share doesn't grow with the rows.  Vectors of another length than the most frequent
    (ties: the longest) can't share a covariance and are left out, here and in ``transform``.
    """
    rows = whole_entries(df, id_col, vec_col)
    sizes = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("dims").desc()).head()
    if sizes is None:
        return None
    dims = sizes["dims"]
    kept = rows.filter(F.size("x") == dims)
    model = Whitening.of(_summary(kept, whole_moments), min(components, dims))

    def whitened(x: np.ndarray) -> Moments:
        return double_moments(model.project(x)[:, model.proper])

    second = _summary(kept, whitened)
    off = second.scatter / second.count - np.eye(len(second.scatter))
    model.identity_error = float(np.abs(off).max(initial=0.0))
    return model


SCHEMA = "deviation long, whitened array<double>"


def transform(df: DataFrame, model: Whitening | None, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, deviation, whitened): a row for each usable vector of the model's length.

    Whitened values stand in the order of components; null where a component has no direction.
    deviation is the exact sum over dimensions of (n*x - sums)^2, null where 64 bits don't hold it.
    Null ids and repeated rows are rows like any other; null vectors and those with null or non-finite
    entries, and empty ones, go.  Other columns aren't read.  Without a model there are no rows.
    """
    rows = whole_entries(df, id_col, vec_col)
    kind = rows.schema["id"].dataType.simpleString()
    if model is None:
        return df.sparkSession.createDataFrame([], f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                hi = min(lo + ROWS, b.num_rows)
                x = _matrix(b.column(1), lo, hi)
                z = model.project(x)
                flat = pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel()))
                at = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(at, flat)], names=["id", "deviation", "whitened"])

    return rows.filter(F.size("x") == len(model.sums)).mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def whiten(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: id_col, component (from 1), n, deviation, whitened,
    explained (share of the trace) and identity_error, as ``fit`` and ``transform`` say."""
    model = fit(df, id_col=id_col, vec_col=vec_col, components=components)
    found = transform(df, model, id_col=id_col, vec_col=vec_col)
    shares = F.array(*(F.lit(float(s)) for s in model.explained)) if model else F.array().cast("array<double>")
    each = found.select(id_col, "deviation", F.posexplode("whitened").alias("__at", "whitened"))
    return each.select(
        id_col,
        (F.col("__at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("__at")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
