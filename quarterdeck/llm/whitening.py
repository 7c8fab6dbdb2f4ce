"""Whitening of embeddings, with covariances by polarisation of exact sums of squares.

Vectors become integers x = floor(64 c) + 1000000. With n vectors and sums S, the centred values y = n x - S are integers too.
Each task squares y of every dimension and the sum of y of every pair of dimensions, and adds the squares up without rounding
(two limbs where the squares fit in 62 bits, five limbs of 21 bits otherwise). Spark adds up the tasks' totals as decimals, so
the driver gets one number a pair of dimensions, whatever the number of rows or tasks. Then
cov(i, j) = (var(i + j) - var(i) - var(j)) / 2, an exact difference of integers, is rounded once, to a double, and the matrix
goes to `eigh`. Its leading eigenvectors are small and go out with the tasks that project the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
#: Integers beyond this are taken as this: the differences n x - S of three billion of them still fit a task's 64 bits.
MOST = 1 << 28
COMPONENTS = 32
#: Rows handled at a time.
STEP = 4096
_DECIMAL = pa.decimal128(38, 0)


def usable(table: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows whose vector is not null and has no null, NaN or infinite entry."""
    own = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return own.where(F.col("embedding").isNotNull() & finite)


def _whole(lists: pa.Array, width: int) -> np.ndarray:
    """The integers x, a row a vector; vectors shorter than width are filled up with entries of 0."""
    offsets = np.asarray(lists.offsets)
    flat = np.asarray(lists.values)[offsets[0] : offsets[-1]]
    offsets, own = offsets - offsets[0], np.diff(offsets)
    out = np.zeros((len(own), width))
    if len(own) and own.min() == width:
        out[:] = flat.reshape(len(own), width)
    else:
        row = np.repeat(np.arange(len(own)), own)
        out[row, np.arange(len(flat)) - offsets[row]] = flat
    return np.clip(np.floor(SCALE * out) + OFFSET, -MOST, MOST).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for k in range(0, whole.num_rows, STEP):
            batch = whole.slice(k, STEP)
            yield batch, _whole(batch.column(column), width)


def totals(vectors: DataFrame) -> tuple[int, list[int]]:
    """n and S of the vectors; one row a dimension comes to the driver."""
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    n, width = shape["n"], shape["width"] or 0
    if not n or not width:
        return n, []

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for _, x in _chunks(batches, 0, width):
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total, _DECIMAL)], ["i", "total"])

    rows = vectors.select("embedding").mapInArrow(add, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    return n, [int(r["total"]) for r in sorted(rows, key=lambda r: r["i"])]


def square_sums(t: np.ndarray) -> list[int]:
    """Exact sums of the squares of each column of 64-bit integers (at most STEP rows, below 2^62 in size)."""
    t = np.abs(t)
    if not t.size:
        return [0] * t.shape[1]
    if int(t.max()) < 1 << 31:
        t = t * t
        high, low = (t >> 32).sum(axis=0).tolist(), (t & 0xFFFFFFFF).sum(axis=0).tolist()
        return [(h << 32) + x for h, x in zip(high, low, strict=True)]
    limb = (1 << 21) - 1
    a, b, c = t & limb, t >> 21 & limb, t >> 42
    parts = [a * a, 2 * a * b, 2 * a * c + b * b, 2 * b * c, c * c]
    sums = [p.sum(axis=0).tolist() for p in parts]
    return [sum(s[k] << 21 * power for power, s in enumerate(sums)) for k in range(t.shape[1])]


def pair_squares(vectors: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """Sums over all vectors of y_i^2, at (i, i), and of (y_i + y_j)^2, at (i, j) with i < j."""
    width, total = len(sums), np.array(sums, np.int64)

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[int]] = [[0] * (width - i) for i in range(width)]
        for _, x in _chunks(batches, 0, width):
            y = n * x - total
            for i in range(width):
                t = y[:, i:] + y[:, i : i + 1]
                t[:, 0] = y[:, i]
                held[i] = [p + q for p, q in zip(held[i], square_sums(t), strict=True)]
        for i in range(width):
            columns = [pa.array([i] * (width - i), pa.int32()), pa.array(range(i, width), pa.int32()), pa.array(held[i], _DECIMAL)]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "squares"])

    made = vectors.select("embedding").mapInArrow(square, "i int, j int, squares decimal(38,0)")
    rows = made.groupBy("i", "j").agg(F.sum("squares").alias("squares")).collect()  # one row a pair of dimensions
    return {(r["i"], r["j"]): int(r["squares"]) for r in rows}


def covariance(squares: dict[tuple[int, int], int], n: int, width: int) -> np.ndarray:
    """Of x, divisor n: the differences of the sums of squares, each rounded once."""
    out = np.zeros((width, width))
    for i in range(width):
        out[i, i] = squares[i, i] / n**3
        for j in range(i + 1, width):
            out[i, j] = out[j, i] = (squares[i, j] - squares[i, i] - squares[j, j]) / (2 * n**3)
    return out


def principal(cov: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading eigenvectors (columns), 1 / sqrt(eigenvalue) (NaN where the eigenvalue is no more than rounding) and
    eigenvalue / trace (NaN where the trace is 0)."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    real = values > len(cov) * np.finfo(float).eps * max(values[0], 0)
    trace = np.trace(cov)
    scale = np.full(len(values), np.nan)
    scale[real] = 1 / np.sqrt(values[real])
    return vectors, scale, np.where(real, values, 0) / trace if trace > 0 else np.full(len(values), np.nan)


def identity_error(vectors: DataFrame, n: int, sums: list[int], axes: np.ndarray) -> float | None:
    """Largest absolute entry of the covariance of the projections on axes minus the identity; None without axes."""
    width, total, kinds = len(sums), np.array(sums, np.int64), axes.shape[1]
    if not kinds:
        return None
    upper = np.triu_indices(kinds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(kinds), np.zeros((kinds, kinds))
        for _, x in _chunks(batches, 0, width):
            w = (n * x - total) / n @ axes
            first += w.sum(axis=0)
            second += w.T @ w
        columns = [pa.array([-1] * kinds + upper[0].tolist(), pa.int32()), pa.array([*range(kinds), *upper[1].tolist()], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(np.concatenate([first, second[upper]]) / n)], ["i", "j", "mean"])

    rows = vectors.select("embedding").mapInArrow(add, "i int, j int, mean double").groupBy("i", "j").agg(F.sum("mean").alias("mean")).collect()
    mean = {(r["i"], r["j"]): r["mean"] for r in rows}
    return max(abs(mean[i, j] - mean[-1, i] * mean[-1, j] - (i == j)) for i, j in zip(*map(np.ndarray.tolist, upper), strict=True))


def whitened(table: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row a usable vector and component.

    Rows whose vector is null or has a null, NaN or infinite entry are left out; all others are whitened, equal rows and
    null vec_ids too. Vectors shorter than the longest are filled up with entries of 0; without a vector, or if all are
    empty, there are no rows. x is held within 2^28 (entries of four million). deviation is null where it does not fit in
    a long. A component with no variance beyond rounding has whitened null and explained 0; if no dimension varies, explained
    and identity_error are null. Sums of squares are exact up to 38 digits.
    """
    vectors = usable(table)
    n, sums = totals(vectors)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not sums:
        return table.sparkSession.createDataFrame([], schema)
    width, total = len(sums), np.array(sums, np.int64)
    axes, scale, explained = principal(covariance(pair_squares(vectors, n, sums), n, width), most)
    kinds, real = len(scale), ~np.isnan(scale)
    axes = axes * np.where(real, scale, 0)
    error = identity_error(vectors, n, sums, axes[:, real])
    share = [None if np.isnan(e) else float(e) for e in explained]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _chunks(batches, 1, width):
            y, rows = n * x - total, len(x)
            squares = square_sums(y.T)
            w = pa.array((y / n @ axes).ravel(), mask=np.tile(~real, rows))
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), kinds))), pa.array(np.tile(np.arange(1, kinds + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * kinds, n)), pa.array([s if s < 1 << 63 else None for s in squares for _ in range(kinds)], pa.int64()), w,
                pa.array(share * rows, pa.float64()), pa.array([error] * (rows * kinds), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return vectors.mapInArrow(project, schema)
