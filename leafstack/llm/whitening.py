"""Whitening of embeddings by spectrum slicing.

Each entry c becomes the integer floor(64 c) + 1000000; the fit list holds every distinct integer vector
once. Sums and covariance of the fit list are added up in the tasks and by an aggregate, so only one row
per dimension, or per pair of dimensions, reaches the driver. There the covariance V is sliced: the pivot
signs of an LDL' factorisation (Bunch and Kaufman) of V - s I count the eigenvalues above s, bisection by
counts isolates each leading eigenvalue, Rayleigh quotient iteration inside the isolating interval finds it
and its vector with cubic convergence, and two more counts certify its number. Eigenvalues that no slice
of rounding width separates are one cluster, found by block inverse iteration.

Bounds: the solve is by the number of dimensions d alone (d^2 numbers, d^3 steps), however many rows.

Defined cases: vectors that are null or hold null, NaN or infinite entries are dropped; vectors of
another length than most of the fit list (ties: the longest) are dropped; entries beyond 2^55 count as
2^55; a null vec_id stays null; repeated rows are whitened one by one but fitted once; directions
without variance (an eigenvalue within rounding of zero) are no components, so a fit list of one vector or
none gives no row; a deviation that no long holds is null; other columns are not read.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.llm.common import forget, stored

COMPONENTS = 16
#: Fixed by the contract: an entry's scale and offset as an integer.
STEPS, OFFSET = 64, 1_000_000
LARGEST = 2.0**61
_EPS = float(np.finfo(float).eps)
_SAFE = 2**62
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"


# --- spectrum slicing -------------------------------------------------------------------------------

def eigenvalues_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric `v` lie above `shift`: positive pivots of an LDL' factorisation."""
    a = v - shift * np.eye(len(v))
    above, alpha = 0, (1 + 17**0.5) / 8
    while len(a):
        below = np.abs(a[1:, 0])
        width = 1
        if len(below) and (most := below.max()) > 0 and abs(a[0, 0]) < alpha * most:
            r = 1 + int(below.argmax())
            line = np.abs(a[r])
            line[r] = 0
            if abs(a[0, 0]) * line.max() < alpha * most * most:
                to = 0 if abs(a[r, r]) >= alpha * line.max() else 1
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
                width = 1 + to
        head, side = a[:width, :width], a[width:, :width]
        if width == 2:
            above += 1          # such a pivot has one eigenvalue of either sign
            a = a[2:, 2:] - side @ np.linalg.solve(head, side.T)
        else:
            pivot = head[0, 0]
            above += pivot > 0
            a = a[1:, 1:] - np.outer(side[:, 0], side[:, 0] / pivot) if pivot else a[1:, 1:]
    return int(above)


class Slicer:
    """The leading eigenpairs of a symmetric matrix."""

    def __init__(self, v: np.ndarray):
        self.v, self.d = v, len(v)
        radius = np.abs(v).sum(axis=1) - np.abs(np.diag(v))
        self.low, self.high = float((np.diag(v) - radius).min()), float((np.diag(v) + radius).max())
        self.scale = max(abs(self.low), abs(self.high))
        self.rounding = 8 * self.d * _EPS * self.scale
        self.random = np.random.default_rng(1)
        self.found: list[tuple[float, np.ndarray]] = []

    def above(self, shift: float) -> int:
        return eigenvalues_above(self.v, shift)

    def leading(self, k: int) -> list[tuple[float, np.ndarray]]:
        """(eigenvalue, unit vector) of the k largest, falling."""
        self.found = []
        if self.scale > 0:
            # (low, high, eigenvalues above low, above high), the highest slice last
            slices = [(self.low - self.rounding, self.high + self.rounding, self.d, 0)]
            while slices and len(self.found) < k:
                low, high, n_low, n_high = slices.pop()
                if n_low - n_high > 1 and high - low > self.rounding:
                    mid = (low + high) / 2
                    n_mid = self.above(mid)
                    slices += [(low, mid, n_low, n_mid), (mid, high, n_mid, n_high)]
                elif n_low - n_high > 1:
                    self.found += self._cluster(low, high, n_low - n_high)
                elif n_low > n_high:
                    self.found.append(self._isolated(low, high, n_low))
        return self.found[:k]

    def _apart(self, x: np.ndarray) -> np.ndarray:
        """`x` without what lies along vectors found so far."""
        for _ in range(2):
            for _, u in self.found:
                x = x - np.outer(u, u @ x).reshape(x.shape)
        return x

    def _solved(self, shift: float, x: np.ndarray) -> np.ndarray:
        try:
            return np.linalg.solve(self.v - shift * np.eye(self.d), x)
        except np.linalg.LinAlgError:       # the shift is an eigenvalue to the last bit
            return np.linalg.solve(self.v - (shift + _EPS * self.scale) * np.eye(self.d), x)

    def _isolated(self, low: float, high: float, number: int) -> tuple[float, np.ndarray]:
        """The one eigenvalue of (low, high] by Rayleigh quotient iteration; a run that leaves it halves the slice by a count."""
        while high - low > self.rounding:
            mid = (low + high) / 2
            x = self._unit(self._solved(mid, self._apart(self.random.normal(size=self.d))))
            for _ in range(30):
                value = float(x @ self.v @ x)
                if not low < value <= high:
                    break
                if np.linalg.norm(self.v @ x - value * x) <= self.rounding / 4:
                    x = self._unit(self._apart(self._solved(value, x)))
                    return self._certified(x, number)
                x = self._unit(self._apart(self._solved(value, x)))
            if self.above(mid) >= number:
                low = mid
            else:
                high = mid
        return self._cluster(low, high, 1)[0]

    def _cluster(self, low: float, high: float, size: int) -> list[tuple[float, np.ndarray]]:
        """`size` eigenvalues within rounding of each other: any orthonormal vectors of their space."""
        first = len(self.found) + 1
        x = self.random.normal(size=(self.d, size))
        for _ in range(4):
            x = np.linalg.qr(self._apart(self._solved((low + high) / 2 + _EPS * self.scale, x)))[0]
        pairs = sorted(((float(u @ self.v @ u), u) for u in x.T), key=lambda p: -p[0])
        return [self._certified(u, first + i) for i, (_, u) in enumerate(pairs)]

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x)

    def _certified(self, x: np.ndarray, number: int) -> tuple[float, np.ndarray]:
        """The pair, if counts on both sides show that eigenvalue `number` lies where the residual says."""
        value = float(x @ self.v @ x)
        off = 2 * float(np.linalg.norm(self.v @ x - value * x)) + self.rounding
        if not self.above(value + off) < number <= self.above(value - off):
            raise ArithmeticError(f"eigenvalue {number} is not at {value}")
        return value, x


# --- sums in the tasks ------------------------------------------------------------------------------

def finite(vector: Column) -> Column:
    """The vector as doubles has no null, NaN or infinite entry (and is not null itself)."""
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= float(np.finfo(float).max))), F.lit(False))


def as_integers(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), STEPS * c))) + OFFSET)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _column_sums(x: DataFrame, d: int) -> list[int]:
    """Exact sums of x's dimensions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            m = _matrix(batch.column(0), d)
            if len(m):
                m = m if max(abs(int(m.max())), abs(int(m.min()))) < _SAFE // len(m) else m.astype(object)
                total = [a + int(b) for a, b in zip(total, m.sum(axis=0), strict=True)]
        yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array([decimal.Decimal(t) for t in total], pa.decimal128(38, 0))], ["at", "total"])

    rows = x.mapInArrow(run, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).collect()
    return [int(r.total) for r in sorted(rows, key=lambda r: r.at)]


def _product_sums(x: DataFrame, d: int, width: int, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of the products of made(rows of x), width columns, with themselves."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), d)
            for at in range(0, len(m), 4096):
                y = made(m[at:at + 4096])
                total += y.T @ y
        yield pa.record_batch([pa.array(range(len(upper[0])), pa.int32()), pa.array(total[upper])], ["at", "total"])

    rows = x.mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    out = np.zeros((width, width))
    out[upper] = [r.total for r in sorted(rows, key=lambda r: r.at)]
    return out + np.triu(out, 1).T


# --- the whitening ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: n vectors, their sums, leading eigenvalues and vectors (one a row), share of variance, error."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    def scaled(self, m: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: longs, or Python's integers where longs could overflow."""
        whole = [s // self.n for s in self.sums]
        rest = [s - w * self.n for s, w in zip(self.sums, whole, strict=True)]
        top = max(map(abs, whole))
        if top < _SAFE and len(m):
            near = m - np.array(whole, np.int64)
            if max(abs(int(near.max())), abs(int(near.min()))) < _SAFE // self.n - 1:
                return near * self.n - np.array(rest, np.int64)
        return m.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, m: np.ndarray) -> np.ndarray:
        return self.scaled(m).astype(float) / self.n

    def deviation(self, m: np.ndarray) -> list[int | None]:
        far = self.scaled(m)
        if far.dtype != object and len(far) and max(abs(int(far.max())), abs(int(far.min()))) < (_SAFE // far.shape[1])**0.5:
            return (far * far).sum(axis=1).tolist()
        return [t if t < 2**63 else None for t in (sum(int(e) ** 2 for e in row) for row in far)]

    def whitened(self, m: np.ndarray) -> np.ndarray:
        return self.centred(m) @ self.vectors.T / np.sqrt(self.values)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, int]:
    """The whitening of vectors(embedding), and their length; None without a component."""
    spark = vectors.sparkSession
    x = vectors.where(finite(F.col("embedding"))).select(as_integers(F.col("embedding")).alias("x")).distinct()
    x, path = stored(x, "fit-vectors")
    sizes = x.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).limit(1).collect()
    d = sizes[0].d if sizes else 0
    made = None
    if d:
        n, x = sizes[0]["count"], x.where(F.size("x") == d)
        bare = Whitening(n, tuple(_column_sums(x, d)), np.zeros(0), np.zeros((0, d)), np.zeros(0), 0.0)
        v = _product_sums(x, d, d, bare.centred) / n
        slicer = Slicer(v)
        pairs = [(e, u) for e, u in slicer.leading(min(components, d)) if e > slicer.rounding]
        if pairs:
            values, rows = np.array([e for e, _ in pairs]), np.array([u for _, u in pairs])
            made = Whitening(n, bare.sums, values, rows, values / np.trace(v), 0.0)
            # whitened rows are centred already: their mean is zero but for rounding
            error = float(np.abs(_product_sums(x, d, len(pairs), made.whitened) / n - np.eye(len(pairs))).max())
            made = Whitening(n, bare.sums, values, rows, made.explained, error)
    forget(spark, path)
    return made, d


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue."""
    made, d = fit(embeddings.select("embedding"), components)
    rows = embeddings.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), as_integers(F.col("embedding")).alias("x"))
    if made is None:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    k = len(made.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                m = _matrix(part.column(1), d)
                each = np.repeat(np.arange(len(m)), k)
                take = pa.array(each)
                tiled = lambda a: pa.array(np.tile(a, len(m)))  # noqa: B023, E731
                yield pa.record_batch([
                    part.column(0).take(take), tiled(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(len(each), made.n, np.int64)),
                    pa.array(made.deviation(m), pa.int64()).take(take), pa.array(made.whitened(m).ravel()), tiled(made.explained),
                    pa.array(np.full(len(each), made.identity_error)), tiled(made.values)], [f.split()[0] for f in RESULT.split(", ")])

    return rows.where(F.size("x") == d).mapInArrow(run, RESULT)
