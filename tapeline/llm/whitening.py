"""Whitening of embeddings by QDWH spectral divide and conquer.

Entries are rounded to whole numbers, so that sums are exact. Each distinct vector counts once in the covariance, which Spark
sums from centred products, block by block. The eigenvectors come from polar decompositions: the orthogonal polar
factor of the covariance, shifted, is the matrix sign; half of it plus identity is the projector to the eigenvalues above the shift. Its range and
that of its complement are invariant subspaces, which are split in turn, down to single components. A polar decomposition is
Halley's iteration with dynamical weights (QDWH), by QR factorisations. Last the components are improved by
Newton steps for the whole basis, to double precision. The matrix of the components goes to all tasks: dimensions x components numbers.

Defined results: vectors that are null, or hold null or non-finite entries (or entries from 2^50 on, which have no place in
the rounding), take no part, nor do vectors of another dimension than the one with the smallest id has; null ids and repeated rows are kept, each
with its rows; components whose variance is within rounding of zero have no whitened values and are left out, so a
single vector or an empty table gives no rows; within equal eigenvalues any basis is right, one for all rows; ``deviation`` is null where it exceeds a LONG; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.session import saved

COMPONENTS = 16
SCALE, SHIFT, LIMIT = 64, 1_000_000, float(2**50)
EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of the polar decomposition of a symmetric matrix, by QDWH."""
    n = len(a)
    x = a / np.linalg.norm(a)
    least = max(1 / (np.linalg.norm(np.linalg.inv(x)) if np.linalg.cond(x, 1) < 1 / EPS else 1 / EPS), EPS)
    for _ in range(30):
        d = (4 * (1 - least**2) / least**4) ** (1 / 3)
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - least**2) / (least**2 * np.sqrt(1 + d)))
        b = (p - 1) ** 2 / 4
        c = p + b - 1
        q = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))[0]
        after = b / c * x + (p - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        moved = np.linalg.norm(after - x)
        x = (after + after.T) / 2
        least = min(1.0, least * (p + b * least**2) / (1 + c * least**2))
        if moved < 1e-10 * np.sqrt(n):
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces: the larger and the smaller eigenvalues; None where the matrix is a multiple of the identity to rounding."""
    n = len(a)
    middle = np.trace(a) / n
    rest = a - middle * np.eye(n)
    spread = np.linalg.norm(rest)
    if spread <= 4 * EPS * n * np.linalg.norm(a):
        return None
    for shift in (0.0, 0.21, -0.21, 0.07, -0.07, 0.4, -0.4):  # in standard deviations of the eigenvalues; another where one of them is too near
        sign = polar_factor(rest - shift * spread / np.sqrt(n) * np.eye(n))
        upper = (sign + np.eye(n)) / 2
        rank = int(round(np.trace(upper)))
        if 0 < rank < n and np.linalg.norm(upper @ upper - upper) < 1e-8:
            base = np.linalg.qr(upper @ np.random.default_rng(n).standard_normal((n, n)))[0]  # the first columns span the range
            first = np.linalg.qr(upper @ base[:, :rank])[0]
            second = np.linalg.qr(base[:, rank:] - first @ (first.T @ base[:, rank:]))[0]
            return first, second
    return None


def components_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    done, todo = [], [np.eye(len(a))]
    while todo:
        basis = todo.pop()
        block = basis.T @ a @ basis
        parts = split((block + block.T) / 2) if basis.shape[1] > 1 else None
        if parts is None:
            done.append(basis)
        else:
            todo += [basis @ p for p in parts]
    x = refined(a, np.hstack(done))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def refined(a: np.ndarray, x: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Newton steps for all eigenvectors at once: what is not orthogonal goes, what is not diagonal is divided by the gap of the eigenvalues."""
    for _ in range(rounds):
        off = np.eye(x.shape[1]) - x.T @ x
        inner = x.T @ a @ x
        values = np.diag(inner) / (1 - np.diag(off))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 2 * (np.linalg.norm(inner - np.diag(values)) + np.linalg.norm(a) * np.linalg.norm(off)) + 1e-300
        step = np.where(near, off / 2, (inner + values[None, :] * off) / np.where(near, 1, gap))
        x = x + x @ step
    return x


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums; ``axes``: dimensions x components, each over the root of its variance; ``explained`` of each component."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of whole numbers; centred as n * x - sums, which is exact, so that nothing cancels."""
        return centred(x, self.n, self.sums) @ self.axes


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n: the whole part of the mean is taken off exactly."""
    whole, rest = sums // n, sums % n
    return (x - whole).astype(float) - rest / n


def rounded(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x (array<long>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & fits & (F.size("v") > 0))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """Sums of (at, value) by place: ``size`` numbers to the driver."""
    out = np.zeros(size)
    for row in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[row["at"]] = row["value"]
    return out


def _products(fit: DataFrame, of_rows, width: int) -> np.ndarray:
    """Sum over the rows of ``fit`` of the outer products of what ``of_rows`` makes of them, as width x width numbers; one task gives one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                z = of_rows(whole(batch.column(0)))
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width, dtype=np.int32)), pa.array(total.reshape(-1))], names=["at", "value"])

    total = _summed(fit.select("x").mapInArrow(run, "at int, value double"), width * width).reshape(width, width)
    return (total + total.T) / 2


def whole(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_whitening(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors ``fit`` (x); None where there is no component of any variance."""
    place = F.posexplode("x").alias("at", "c")
    sums = {r["at"]: (r["s"], r["n"]) for r in fit.select(place).groupBy("at").agg(F.sum("c").alias("s"), F.count("*").alias("n")).collect()}  # a row a dimension
    if not sums:
        return None
    n, total = sums[0][1], np.array([sums[i][0] for i in range(dims)], np.int64)
    covariance = _products(fit, lambda x: centred(x, n, total), dims) / n
    values, vectors = components_of(covariance)
    some = [i for i in range(min(components, dims)) if values[i] > dims * 64 * EPS * max(values[0], 0)]
    if not some:
        return None
    return Whitening(n, total, vectors[:, some] / np.sqrt(values[some]), values[some] / np.trace(covariance))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n * x - sums)^2 of each row, exact; None above a LONG."""
    about = (centred(x, n, sums) * n).astype(float)
    if len(x) and np.abs(about).max() < 2**31 and (about**2).sum(axis=1).max() < 2.0**62:  # n * x - sums itself may wrap around, and is right then
        step = x * np.int64(n) - sums
        return (step * step).sum(axis=1).tolist()
    exact = (sum((n * c - s) ** 2 for c, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist())
    return [d if d < 2**63 else None for d in exact]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component; ``identity_error`` is one value: how far the whitened covariance is from the identity."""
    rows = rounded(vectors, id_col, vector_col)
    first = rows.agg(F.min_by(F.size("x"), F.struct(F.col("vec_id").isNull(), "vec_id")).alias("dims")).first()
    nothing = vectors.sparkSession.createDataFrame([], SCHEMA)
    if first.dims is None:
        return nothing
    rows = rows.where(F.size("x") == first.dims)
    fit = saved(rows.select("x").distinct())
    model = fit_whitening(fit, first.dims, components)
    if model is None:
        return nothing
    k = model.axes.shape[1]
    error = float(np.abs(_products(fit, model.apply, k) / model.n - np.eye(k)).max())
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                x = whole(some.column("x"))
                rows = np.repeat(np.arange(len(x)), k)
                out = some.select(["vec_id"]).take(pa.array(rows))
                deviation = pa.array(deviations(x, m.n, m.sums), pa.int64()).take(pa.array(rows))
                columns = [out.column(0), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), m.n)), deviation, pa.array(m.apply(x).reshape(-1)), pa.array(np.tile(m.explained, len(x))), pa.array(np.full(len(rows), error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)
