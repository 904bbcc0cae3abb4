"""Embedding whitening by cyclic Jacobi rotations.

Vectors become whole numbers, so that their sums are exact. A pass over all vectors sums them, a second sums the
products of centred vectors (each task its own matrix, rows of the matrices added by key). The driver holds that one matrix and rotates it by Jacobi's method until
every off-diagonal entry is negligible beside the diagonal entries of its row and column, which leaves small eigenvalues accurate.
The sorted whitening matrix is broadcast: its size is the number of dimensions squared, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Whole numbers beyond this are held there, so that sums stay exact.
LARGEST = 1 << 40
#: Off-diagonal entries under this share of the geometric mean of their diagonal entries are zero; so are eigenvalues under this share of the trace.
NEGLIGIBLE, MOST_SWEEPS = 1e-16, 60


@dataclass(frozen=True)
class Whitening:
    """n vectors' exact sums, eigenvalues from the largest, unit eigenvectors in columns, trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: whole parts are subtracted as whole numbers."""
        whole, rest = np.array([divmod(s, self.n) for s in self.sums], np.int64).reshape(-1, 2).T
        return (x - whole) - rest / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - sum)^2 over the dimensions, exact."""
        whole, rest = np.array([divmod(s, self.n) for s in self.sums], np.int64).reshape(-1, 2).T
        if self.n * (int(np.abs(x - whole).max(initial=0)) + 1) < 2**31 and x.shape[1] * (self.n * (int(np.abs(x - whole).max(initial=0)) + 1)) ** 2 < 2**63:
            return ((self.n * (x - whole) - rest) ** 2).sum(1).tolist()
        off = (x - whole).astype(object) * self.n - rest.astype(object)
        return [int(v) for v in (off * off).sum(1)]

    def matrix(self, components: int) -> np.ndarray:
        """Eigenvectors over the roots of their eigenvalues; those without variance are nan."""
        values = self.values[:components]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(values > 0, self.vectors[:, :components] / np.sqrt(values), np.nan)


def usable(vec_col: str, size: int | None = None) -> Column:
    """Vectors with components, all of them finite numbers, and of a size."""
    v = F.col(vec_col)
    fit = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (fit if size is None else fit & (F.size(v) == size))


def numbers(column: pa.Array, size: int) -> np.ndarray:
    """The whole numbers of clean vectors of one size."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return (np.clip(np.floor(np.clip(values * SCALE, -LARGEST, LARGEST)), -LARGEST, LARGEST) + SHIFT).astype(np.int64)


def summed_rows(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sum of the arrays of each row number; there are as many numbers as dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = row.values.to_numpy()
                sums[i] = sums[i] + row if i in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["i", "row"])

    return {r["i"]: np.array(r["row"]) for r in parts.repartition("i").mapInArrow(run, "i int, row array<double>").collect()}


def scatter(vectors: DataFrame, vec_col: str, size: int, projected) -> np.ndarray:
    """Sum of y y' over the rows y that `projected` makes of whole-number vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = projected(numbers(batch.column(0), size))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    rows = summed_rows(vectors.select(vec_col).mapInArrow(run, "i int, row array<double>"))
    return np.array([rows[i] for i in range(len(rows))])


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix from the largest, and unit eigenvectors in columns, by cyclic rotations.

    Equal eigenvalues keep the order of their columns; each vector's largest component is positive.
    """
    a, v = np.array(matrix, np.float64), np.eye(len(matrix))
    for _ in range(MOST_SWEEPS):
        turned = False
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if abs(a[p, q]) <= NEGLIGIBLE * np.sqrt(abs(a[p, p] * a[q, q])) or a[p, q] == 0:
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s, off, pp, qq = t * c, a[p, q], a[p, p], a[q, q]
                row_p, row_q = a[p].copy(), a[q].copy()
                a[p], a[q] = c * row_p - s * row_q, s * row_p + c * row_q
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = pp - t * off, qq + t * off, 0, 0
                v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    v = v[:, order] / np.linalg.norm(v[:, order], axis=0)
    return values[order], v * np.where(v[np.abs(v).argmax(0), np.arange(len(v))] < 0, -1, 1)


def fit(vectors: DataFrame, vec_col: str = "embedding") -> Whitening | None:
    """The whitening of a table's vectors; None if it has none.

    Vectors that are null, empty, or hold a null or a number that isn't finite take no part; of several sizes the commonest (of equally
    common ones the smallest) is the table's, others take no part.
    """
    sizes = vectors.where(usable(vec_col)).groupBy(F.size(vec_col).alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    if most is None:
        return None
    size, n = most["d"], most["n"]
    clean = vectors.where(usable(vec_col, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * size
        for batch in batches:
            sums = [a + b for a, b in zip(sums, numbers(batch.column(0), size).sum(0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(map(Decimal, sums)), pa.decimal128(38, 0))], names=["i", "s"])

    parts = clean.select(vec_col).mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    sums = {r["i"]: int(r["s"]) for r in parts.collect()}
    bare = Whitening(n, tuple(sums[i] for i in range(size)), np.empty(0), np.empty((0, 0)), 0.0)
    covariance = scatter(clean, vec_col, size, bare.centred) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = jacobi(covariance)
    trace = float(np.trace(covariance))
    return Whitening(n, bare.sums, np.where(values > NEGLIGIBLE * size * trace, values, 0.0), axes, trace)


def whitened(vectors: DataFrame, fitted: Whitening | None, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector that takes part: id, deviation (decimal; null from 10^38), whitened (array, largest component first;
    null for components without variance). Rows that share an id stay apart; a null id stays null."""
    schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size = len(fitted.sums)
    sent = vectors.sparkSession.sparkContext.broadcast((fitted, fitted.matrix(components)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, matrix = sent.value
        for batch in batches:
            x = numbers(batch.column(1), size)
            z = own.centred(x) @ matrix
            far = [Decimal(v) if v < 10**38 else None for v in own.deviation(x)]
            rows = pa.array([[None if v != v else v for v in row] for row in z.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far, pa.decimal128(38, 0)), rows], names=[id_col, "deviation", "whitened"])

    return vectors.where(usable(vec_col, size)).select(id_col, vec_col).mapInArrow(run, schema)


def identity_error(vectors: DataFrame, fitted: Whitening | None, components: int = COMPONENTS, vec_col: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over components with variance."""
    if fitted is None:
        return None
    size, keep = len(fitted.sums), int((fitted.values[:components] > 0).sum())
    if not keep:
        return None
    sent = vectors.sparkSession.sparkContext.broadcast((fitted, fitted.matrix(keep)))

    def projected(x: np.ndarray) -> np.ndarray:
        own, matrix = sent.value
        return np.hstack([own.centred(x) @ matrix, np.ones((len(x), 1))])

    sums = scatter(vectors.where(usable(vec_col, size)), vec_col, size, projected) / fitted.n
    mean = sums[:keep, keep]
    return float(np.abs(sums[:keep, :keep] - np.outer(mean, mean) - np.eye(keep)).max())


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    fitted = fit(vectors)
    rows = whitened(vectors, fitted)
    share = [] if fitted is None or not fitted.trace else [float(e / fitted.trace) for e in fitted.values[:COMPONENTS]]
    explained = F.array(*map(F.lit, share or [0.0] * COMPONENTS))
    error = identity_error(vectors, fitted)
    each = rows.select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n if fitted else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "at").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


QUERIES = {"op12_jacobi_whitening": op12_jacobi_whitening}
SQL: dict[str, str] = {}
