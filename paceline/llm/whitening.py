"""Whitening of embeddings with eigenvectors refined in higher precision.

The covariance of all distinct vectors is summed exactly by the tasks over centred
vectors.  Its matrix (as wide as a vector is long, whatever the number of rows) is
decomposed in float32, and the eigenvectors are then corrected in extended precision by Ogita and
Aishima's iteration, which needs matrix products only and converges quadratically:
from X, take R = I - X'X, S = X'AX, the eigenvalues s_ii / (1 - r_ii), and add X E with
e_ij = (s_ij + l_j r_ij) / (l_j - l_i).  Where two eigenvalues lie closer together than
the error that X still has, that quotient means nothing: such eigenvalues form a
cluster, its columns only keep their orthogonality (e_ij = r_ij / 2), and the small
matrix of the cluster is decomposed for itself, less its own mean, and turns its columns.

Entries c become x = floor(64 c) + 1000000, a whole number, so means and deviations are
exact: with n vectors of sum S, n x - S is whole.

Defined cases: rows whose vector is null, empty or has a null or non-finite entry are
left out, and so are rows whose vector has not the commonest length (of equally common
ones the longest); entries beyond +-2**40 count as that; repeated rows and null or equal
ids are rows of their own, but a vector that repeats is fitted once; components whose
eigenvalue is 0 to rounding (1e-15 of the trace) can't be whitened and are left out, so
with one distinct vector there are none; a deviation past 64 bits is null; other columns
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: x = floor(SCALE * c) + SHIFT; |SCALE * c| counts as BOUND at most.
SCALE, SHIFT, BOUND = 64, 1_000_000, 2**46
#: Rows that a task multiplies at a time.
ROWS = 4096
#: Components whose share of the trace is less have an eigenvalue of 0 to rounding.
NOUGHT = 1e-15

_WIDE = np.longdouble


def whole_vectors(vectors: DataFrame, embedding: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The `keep` columns and x_ (array of long) of each row that is not left out."""
    v = F.col(embedding)
    entry = lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE), F.lit(-BOUND)), F.lit(BOUND)) + SHIFT
    sound = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(*keep, F.when(sound, F.transform(v, entry)).alias("x_")).where(F.col("x_").isNotNull())
    length = rows.groupBy(F.size("x_").alias("size_")).count().orderBy(F.desc("count"), F.desc("size_")).limit(1).collect()
    return rows.where(F.size("x_") == (length[0]["size_"] if length else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(parts: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part in parts:
        for k in range(0, part.num_rows, ROWS):
            cut = part.slice(k, ROWS)
            yield cut, _matrix(cut.column(place))


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x in _slices(parts, 0):
            own = [int(s) for s in (x >> 32).sum(0)], [int(s) for s in (x & 0xFFFFFFFF).sum(0)]  # halves can't overflow
            own = [(a << 32) + b for a, b in zip(*own, strict=True)]
            n, total = n + len(x), own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([str(s) for s in [n, *total]])], ["dim", "total"])

    rows = fit.select("x_").mapInArrow(add, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r.dim: int(r.total) for r in rows}
    return found.get(-1, 0), [found[k] for k in range(len(found) - 1)]


@dataclass(frozen=True)
class Centre:
    """n vectors of sum `total`."""

    n: int
    total: tuple[int, ...]

    def whole(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: 64-bit numbers where they suffice, else Python's."""
        base = np.array([s // self.n for s in self.total], np.int64)
        rest = [s - self.n * (s // self.n) for s in self.total]
        off = x - base
        most = max(int(abs(off).max(initial=0)) + 1, 1)
        if self.n * most < 2**62:
            return self.n * off - np.array(rest, np.int64)
        return self.n * off.astype(object) - np.array(rest, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in double."""
        base = np.array([s // self.n for s in self.total], np.int64)
        rest = np.array([(s - self.n * (s // self.n)) / self.n for s in self.total])
        return (x - base).astype(np.float64) - rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S) squared."""
        d = self.whole(x)
        if d.dtype == np.int64 and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2**62:
            return (d * d).sum(1).tolist()
        d = d.astype(object)
        out = (d * d).sum(1).tolist()
        return [v if v < 2**63 else None for v in out]


def exact_products(z: np.ndarray) -> np.ndarray:
    """z'z of whole numbers, exactly: in double while every sum stays below 2**53, else in Python's numbers."""
    if float(np.abs(z).max(initial=0)) ** 2 * len(z) < 2**53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    z = z.astype(object)
    return z.T @ z


def covariance(fit: DataFrame, centre: Centre) -> np.ndarray:
    """Covariance (divisor n) of the vectors, in extended precision.

    They are centred by the whole part of the mean before they are multiplied; so the
    products are whole numbers, their sums exact in any order, and what the fraction of
    the mean changes is taken off exactly.
    """
    base = np.array([s // centre.n for s in centre.total], np.int64)
    width = len(base)
    upper = np.triu_indices(width)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _slices(parts, 0):
            own = exact_products(x - base)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array([str(v) for v in total[upper]])], ["i", "j", "v"])

    got = fit.select("x_").mapInArrow(add, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    rest = [s - centre.n * (s // centre.n) for s in centre.total]
    out = np.zeros((width, width), _WIDE)
    for r in got:
        out[r.i, r.j] = out[r.j, r.i] = _WIDE(centre.n * int(r.v) - rest[r.i] * rest[r.j]) / _WIDE(centre.n) ** 2
    return out


def spread(fit: DataFrame, project, width: int, n: int) -> np.ndarray:
    """Covariance (divisor n) of the `width` columns of project(x)."""
    upper = np.triu_indices(width)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, plain, seen = np.zeros((width, width)), np.zeros(width), False
        for _, x in _slices(parts, 0):
            y = project(x)
            square += y.T @ y
            plain += y.sum(0)
            seen = True
        if seen:
            i, j = np.concatenate([upper[0], np.full(width, -1)]), np.concatenate([upper[1], np.arange(width)])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([square[upper], plain]))], ["i", "j", "v"])

    square, plain = np.zeros((width, width)), np.zeros(width)
    for r in fit.select("x_").mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r.i < 0:
            plain[r.j] = r.v / n
        else:
            square[r.i, r.j] = square[r.j, r.i] = r.v / n
    return square - np.outer(plain, plain)


def refine(a: np.ndarray, x: np.ndarray, most: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of a symmetric matrix from approximate ones, in extended precision."""
    a, x = a.astype(_WIDE), x.astype(_WIDE)
    one, size = np.eye(len(a), dtype=_WIDE), max(_norm(a), np.finfo(np.float64).tiny)
    values = np.diag(x.T @ a @ x)
    for _ in range(most):
        x, values, change, clusters = _correct(a, x, one, size)
        if clusters:
            x = _orthogonal(x, one)
            for own in clusters:
                x[:, own] = x[:, own] @ _sub_solve(a, x[:, own])
        elif change < 1e-16:
            break
    x = _orthogonal(x, one)
    values = np.diag(x.T @ a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def _norm(m: np.ndarray) -> float:
    """Largest row sum, a bound of the spectral norm of a symmetric matrix."""
    return float(np.abs(m).sum(1).max(initial=0))


def _correct(a: np.ndarray, x: np.ndarray, one: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, float, list[np.ndarray]]:
    """One step of the iteration; the size of its change; the clusters that it could not part."""
    r, s = one - x.T @ x, x.T @ a @ x
    values = np.diag(s) / (1 - np.diag(r))
    error = s - np.diag(values)
    close = 2 * (float(np.linalg.norm(error.astype(float), 2)) + size * float(np.linalg.norm(r.astype(float), 2)))
    close = max(close, float(np.finfo(_WIDE).eps) * size * len(a))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= close
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    order = np.argsort(-values, kind="stable")
    ranked = values[order]
    cuts = np.flatnonzero(ranked[:-1] - ranked[1:] > close) + 1
    clusters = [c for c in np.split(order, cuts) if len(c) > 1 and close > 64 * float(np.finfo(_WIDE).eps) * size * len(a)]
    return x + x @ e, values, float(np.abs(e).max(initial=0)), clusters


def _orthogonal(x: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Newton's step towards orthonormal columns."""
    for _ in range(3):
        x = x @ (one + (one - x.T @ x) / 2)
    return x


def _sub_solve(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Eigenvectors of the matrix that a is on the columns of x, less its mean eigenvalue, turned to be orthonormal."""
    own = x.T @ a @ x
    own = (own + own.T) / 2
    own = own - np.eye(len(own), dtype=_WIDE) * (np.trace(own) / len(own))
    largest = float(np.abs(own).max(initial=0))
    if not largest:
        return np.eye(len(own), dtype=_WIDE)
    turn = np.linalg.eigh((own / largest).astype(np.float64))[1].astype(_WIDE)
    return _orthogonal(turn, np.eye(len(own), dtype=_WIDE))


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns): float32 first, then refined."""
    size = np.abs(matrix).max(initial=0)
    if not size:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    start = np.linalg.eigh((matrix / size).astype(np.float32))[1]
    values, vectors = refine(matrix / size, start)
    return (values * size).astype(np.float64), vectors.astype(np.float64)


@dataclass(frozen=True)
class Whitening:
    """Centre, unit eigenvectors (columns), their eigenvalues, the trace, and how far the whitened covariance is from the identity."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ (self.vectors / np.sqrt(self.values))


def fit(rows: DataFrame, folder: str, most: int = 16) -> Whitening | None:
    """Whitening by the first `most` components of the distinct vectors x_ of `rows`; None without rows."""
    rows.select("x_").distinct().write.mode("overwrite").parquet(f"{folder}/distinct")
    distinct = rows.sparkSession.read.schema("x_ array<bigint>").parquet(f"{folder}/distinct")
    n, total = sums(distinct)
    if not n:
        return None
    centre = Centre(n, tuple(total))
    matrix = covariance(distinct, centre)
    values, vectors = eigen(matrix)
    trace = float(np.trace(matrix))
    whole = int((values[:most] > NOUGHT * trace).sum()) if trace > 0 else 0
    first = Whitening(centre, vectors[:, :whole], values[:whole], trace, 0.0)
    if not whole:
        return first
    error = float(np.abs(spread(distinct, first.project, whole, n) - np.eye(whole)).max())
    return Whitening(centre, first.vectors, first.values, trace, error)


def whiten(vectors: DataFrame, folder: str, most: int = 16, embedding: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error of each row and component."""
    spark: SparkSession = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(vectors, embedding, (key,))
    model = fit(rows, folder, most)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)  # as large as the vectors are long

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for cut, x in _slices(parts, 1):
            if not k:
                continue
            n = len(x)
            twice = pa.array(np.repeat(np.arange(n), k))
            columns = [
                pc.take(cut.column(0), twice), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, m.centre.n)), pc.take(pa.array(m.centre.deviation(x), pa.int64()), twice),
                pa.array(m.project(x).ravel()), pa.array(np.tile(m.values / m.trace, n)), pa.array(np.full(n * k, m.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(key, "x_").mapInArrow(project, schema)
