"""Whitening of embeddings by shifted CholeskyQR.

The centred rows Y (n x d) are orthogonalised by Gram passes: each pass sums
Q'Q over all partitions, factors the d x d sum by Cholesky and divides Q by the
factor R with a triangular solve, which every task does on the rows it reads.
The first factor is taken of the shifted Gram matrix, so that it exists at any
condition number; the passes after it restore orthogonality. The factors
compose to one R with Y'Y = R'R, and the SVD of R gives the components.

Entries are integers, floor(1024 * c) + 100000, so sums, means and distances
are exact. What reaches the driver has d or d(d+1)/2 rows, whatever n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.session import staging_path

SCALE, OFFSET = 1024, 100_000
MAX_ENTRY = 2.0**40
MAX_DIMENSION = 4096  # the driver holds a few d x d matrices
_SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: exact sums, unit components as columns, their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and only finite ones."""
    value = vector.cast("array<double>")
    finite = F.forall(value, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce((F.size(value) > 0) & finite, F.lit(False))


def integers(vector: Column) -> Column:
    """floor(1024 * c) + 100000 of every entry; entries beyond 2**40 are an error."""
    def one(c: Column) -> Column:
        fits = F.abs(c) <= F.lit(MAX_ENTRY)
        wrong = F.raise_error(F.lit("an entry of a vector is beyond 2**40"))
        return F.when(fits, F.floor(c * SCALE) + OFFSET).otherwise(wrong.cast("bigint"))

    return F.transform(vector.cast("array<double>"), one)


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    if lengths.size and lengths.min() != lengths.max():
        raise ValueError("the vectors differ in length")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["x"])
                # Entries are below 2**51, so the sums of 2048 of them fit.
                sums = [0] * x.shape[1]
                for at in range(0, len(x), 2048):
                    sums = [a + int(b) for a, b in zip(sums, x[at : at + 2048].sum(axis=0), strict=True)]
                if totals is not None and len(totals) != len(sums):
                    raise ValueError("the vectors differ in length")
                totals = sums if totals is None else [a + b for a, b in zip(totals, sums, strict=True)]
                n += len(x)
        totals = totals or []
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(totals)), pa.int32()),
                pa.array([n] * len(totals), pa.int64()),
                pa.array([str(t) for t in totals], pa.string()),
            ],
            names=["j", "n", "total"],
        )

    parts = rows.mapInArrow(run, "j int, n bigint, total string")
    found = parts.groupBy("j").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = found.orderBy("j").limit(MAX_DIMENSION + 1).collect()
    if len(found) > MAX_DIMENSION:
        raise ValueError(f"vectors of more than {MAX_DIMENSION} entries")
    if len({r.n for r in found}) > 1:
        raise ValueError("the vectors differ in length")
    return (found[0].n if found else 0), tuple(int(r.total) for r in found)


def _centre(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whole part and remainder of sums / n, so that x - S/n loses no digit of x."""
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([s - n * w for s, w in zip(sums, whole, strict=True)], np.int64)


def _divided(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular factor, by forward substitution."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _gram(rows: DataFrame, n: int, sums: tuple[int, ...], change: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over all rows of q'q, where ``change`` turns centred rows into rows q."""
    whole, rest = _centre(n, sums)
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                q = change((_matrix(batch["x"]) - whole) - rest / n)
                total += q.T @ q
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"]
        )

    parts = rows.mapInArrow(run, "i int, j int, v double")
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular R of the Gram matrix, shifted where it has no factor otherwise."""
    d = gram.shape[0]
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps * np.trace(gram)
    return np.linalg.cholesky(gram + min(shift, 0.01 * np.trace(gram)) * np.eye(d)).T


def _last_factor(gram: np.ndarray) -> np.ndarray:
    """A factor C of the last Gram matrix, C'C = gram; dependent columns leave zero rows."""
    try:
        return np.linalg.cholesky(gram).T
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(gram)
        return np.sqrt(np.clip(values, 0, None))[:, None] * vectors.T


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """Whitening components of a written table with ``x`` (array of bigint); None if it has no spread."""
    n, sums = _summed(rows)
    if n == 0:
        return None
    d = len(sums)
    factors: list[np.ndarray] = []

    def orthogonal(y: np.ndarray) -> np.ndarray:
        for factor in factors:
            y = _divided(y, factor)
        return y

    gram = _gram(rows, n, sums, orthogonal, d)
    if not np.trace(gram) > 0:
        return None
    trace = np.trace(gram) / n
    for _ in range(2):
        factors.append(_factor(gram, n, shifted=not factors))
        gram = _gram(rows, n, sums, orthogonal, d)
    composed = _last_factor(gram)
    for factor in reversed(factors):
        composed = composed @ factor
    _, singular, right = np.linalg.svd(composed)
    # Directions without spread have singular values of rounding errors only.
    rank = int((singular > singular[0] * d * np.finfo(float).eps * 16).sum())
    kept = min(components, rank)
    basis = right[:kept].T
    # One sign for all runs: the largest entry of a component is positive.
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(kept)])
    values = singular[:kept] ** 2 / n
    spread = _gram(rows, n, sums, lambda y: y @ basis / np.sqrt(values), kept) / n
    error = float(np.abs(spread - np.eye(kept)).max())
    return Whitening(n, sums, basis, values, values / trace, error)


def _deviations(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> pa.Array:
    """Sum over the dimensions of (n * x - S) squared, exact at any size."""
    moved = x - whole
    top = n * (int(np.abs(moved).max(initial=0)) + 1)
    if top * top * x.shape[1] < _SAFE:
        return pa.array(((n * moved - rest) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = (n * moved.astype(object) - rest.astype(object)) ** 2
    return pa.array([str(s) for s in exact.sum(axis=1)]).cast(pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whitened coordinates: one row for each vector and component, numbered by falling eigenvalue.

    ``key``, ``component``, ``n`` (vectors fitted), ``deviation`` (exact sum of
    (n*x - S)**2, decimal), ``whitened``, ``explained`` (share of the variance)
    and ``identity_error`` (measured over all rows, not derived).

    Vectors that are null or empty, or hold null or non-finite entries, are left
    out of fit and result; a null key stays null. Repeated rows each count and
    come out. An empty table, one vector, or equal vectors have no component and
    give no rows; fewer independent dimensions than ``components`` give as many
    components as there are. Equal eigenvalues may share their space in any way.
    Other columns, of whatever name, are not read. Vectors of different lengths,
    or with entries beyond 2**40, are an error.
    """
    spark = vectors.sparkSession
    path = staging_path(spark, "whitening")
    slim = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("x"))
    # All passes must read the same rows.
    slim.filter(usable(F.col("x"))).select("id", integers(F.col("x")).alias("x")).write.parquet(path)
    kind = vectors.schema[key].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("x", T.ArrayType(T.LongType()))])
    rows = spark.read.schema(schema).parquet(path)
    out = T.StructType(
        [
            T.StructField(key, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
            T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
        ]
    )
    model = fit(rows, components)
    if model is None:
        return spark.createDataFrame([], out)
    whole, rest = _centre(model.n, model.sums)
    k = model.components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"])
            coordinates = ((x - whole) - rest / model.n) @ model.components / np.sqrt(model.eigenvalues)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, model.n)),
                    _deviations(x, model.n, whole, rest).take(at),
                    pa.array(coordinates.ravel()),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(len(x) * k, model.identity_error)),
                ],
                names=out.names,
            )

    return rows.mapInArrow(run, out)
