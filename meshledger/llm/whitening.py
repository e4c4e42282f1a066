"""Whitening of embeddings: principal components of the distinct vectors, scaled to variance one.

Vectors become integers first, so counts and sums are exact. The covariance is a distributed sum of
centred products, one d x d matrix from each task, added up row by row of the matrix. Its eigenvectors
come from `polar`, on the driver, as the matrix does not grow with the table; at most COMPONENTS of
them (d x 16 numbers) go back to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm import common, polar, vectors

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
_CHUNK = 4096


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def integers(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, x) of the rows that take part, and the length of x."""
    rows = table.where(vectors.whole(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), vectors.scaled(F.col(vector_col), SCALE, OFFSET).alias("x"))
    d = vectors.dimension(rows, "x")
    return rows.where(F.size("x") == d), d


def sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Count and exact sum by dimension: one row from each task for each dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, np.int64)
        for b in batches:
            x = _matrix(b.column(0), d)
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.arange(d), "n": np.full(d, n), "s": total})

    found = fit.select("x").mapInArrow(add, "i long, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (found[0].n if found else 0), np.array([r.s for r in found], dtype=np.int64)


def products(rows: DataFrame, width: int, centred) -> np.ndarray:
    """Sum of y y' over the rows' vectors, where ``centred`` makes the y of a matrix of integers.

    Each task adds up its own matrix and sends it row by row; the tasks' rows of one number are added in Spark.
    """
    d = width

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((d, d)), False
        for b in batches:
            for at in range(0, b.num_rows, _CHUNK):
                y = centred(b.column(0).slice(at, _CHUNK))
                total, any_row = total + y.T @ y, True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(total))], ["i", "v"])

    parts = rows.select("x").mapInArrow(partial, "i long, v array<double>")
    added = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((d, d))
    total[added["i"].to_numpy(), added["j"].to_numpy()] = added["v"].to_numpy()
    return total


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining row and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows with a null vector or a null, NaN or infinite entry are left out, and so are vectors of
    another length than the commonest one. Repeated vectors count once in the fit; repeated rows and
    null ids are rows of the result. Components whose eigenvalue is rounding error (fewer distinct
    vectors than components, constant dimensions) do not exist: there are as many as the covariance has
    rank, so one distinct vector, or an empty table, gives no rows. ``deviation`` is null where it does
    not fit a long. Equal eigenvalues leave the choice of their vectors open; one is made for all rows.
    """
    spark = table.sparkSession
    rows, d = integers(table, id_col, vector_col)
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = common.store(rows.select("x").distinct(), "whitening-fit") if d else rows
    n, total = sums(fit, d) if d else (0, np.zeros(0, np.int64))
    if not n:
        return spark.createDataFrame([], schema)
    mean = total / n
    covariance = products(fit, d, lambda column: _matrix(column, d) - mean) / n
    e, v = polar.eigen(covariance)
    trace = float(np.trace(covariance))
    # the mean is rounded to 2^-53 of its size, so variances below the square of that are noise
    floor = max(d * polar.EPS * max(e[0], 0.0), (np.abs(mean).max() * polar.EPS * 4) ** 2)
    k = min(components, int((e > floor).sum()))
    if not k:
        return spark.createDataFrame([], schema)
    w = v[:, :k] / np.sqrt(e[:k])
    project = lambda column: (_matrix(column, d) - mean) @ w
    error = float(np.abs(_centred_covariance(fit, project, k, n) - np.eye(k)).max())
    explained = e[:k] / trace

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _CHUNK):
                part = b.slice(at, _CHUNK)
                x, m = _matrix(part.column(1), d), part.num_rows
                y = n * x - total
                if np.square(y.astype(float)).sum(axis=1).max() < 9e18:
                    far = pa.array(np.square(y).sum(axis=1))
                else:  # exact whatever the size
                    exact = [sum(int(t) ** 2 for t in row) for row in y.tolist()]
                    far = pa.array([t if t < 1 << 63 else None for t in exact], pa.int64())
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    far.take(pa.array(each)), pa.array(project(part.column(1)).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(write, schema)


def _centred_covariance(fit: DataFrame, project, k: int, n: int) -> np.ndarray:
    """Covariance of the projections, centred by their own mean before multiplying."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((project(b.column(0)).sum(axis=0) for b in batches if b.num_rows), np.zeros(k))
        yield pa.RecordBatch.from_pydict({"i": np.arange(k), "s": total})

    found = fit.select("x").mapInArrow(add, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    centre = np.zeros(k)
    for r in found:
        centre[r.i] = r.s / n
    return products(fit, k, lambda column: project(column) - centre) / n


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
