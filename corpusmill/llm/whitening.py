"""Embedding whitening from an exact integer scatter matrix.

An entry c becomes the integer x = floor(SCALE * c) + OFFSET. Each task subtracts the shift OFFSET and
adds up its rows and their cross-products in integers of any size (blocks whose sums provably stay
under 2^53 go through a matrix product of doubles, which is exact there). The sums leave a task as two
halves of 60 bits and more, so the sum of all tasks in the JVM is exact too. n X'X - S S' is then formed in
Python integers, and only its entries over n^2 become doubles (each rounded once) for `eigh`. Rows are
whitened from n x - S, which is an exact integer, in the tasks; a second pass measures the covariance
of what is whitened.

The driver holds d x d matrices only, d the length of a vector (at most `MAX_DIM`, else an error); no
row passes through it, and a task keeps one block of rows and one matrix.

Edge cases: rows whose vector is null, empty, holds a null or non-finite entry, or one whose x no long
can hold, are left out; vectors of another length than most rows have (of the longer one, if two lengths are equally
common) are left out too; repeated rows count each; a null vec_id stays null; components whose
variance is zero to double precision cannot be whitened and have no rows, so one vector, or equal ones,
give none; an empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import turn_to

SCALE, OFFSET, COMPONENTS, MAX_DIM = 64, 1_000_000, 32, 4096
#: Rows taken at once, and the bits of the lower half of a sum.
BLOCK, HALF = 2048, 60
#: A variance below this share of the largest one is rounding.
RANK = 1e-13


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that are whitened."""
    fine = f"size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs({SCALE} * cast(c as double)) < 9.2e18)"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(f"embedding is not null and {fine}")
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return rows
    if lengths[0].d > MAX_DIM:
        raise ValueError(f"vectors of {lengths[0].d} entries: the driver holds square matrices of at most {MAX_DIM}")
    return rows.where(F.size("embedding") == lengths[0].d)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(vec_id, x - OFFSET as integers) of a few rows each."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            yield part.column(0), np.floor(SCALE * flat).astype(np.int64).reshape(-1, d)


def products(y: np.ndarray) -> np.ndarray:
    """y'y, exact: an array of Python integers."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    whole = y.astype(object)
    return whole.T @ whole


def _add_up(d: int):
    """One row for each entry of the sums (j = -1) and of the upper half of the products of a task: low 60 bits, and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("whitening")
        n, s, m = 0, np.zeros(d, object), np.zeros((d, d), object)
        for _, y in _blocks(batches, d):
            n += len(y)
            s += y.astype(object).sum(0)
            m += products(y)
        if not n:
            return
        i, j = np.triu_indices(d)
        values = [n, *s, *m[i, j]]
        schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("low", pa.decimal128(38, 0)), ("high", pa.decimal128(38, 0))])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([[-1], np.arange(d), i]), pa.int32()),
                pa.array(np.concatenate([np.full(d + 1, -1), j]), pa.int32()),
                pa.array([decimal.Decimal(v & (1 << HALF) - 1) for v in values], pa.decimal128(38, 0)),
                pa.array([decimal.Decimal(v >> HALF) for v in values], pa.decimal128(38, 0)),
            ],
            schema=schema,
        )

    return run


def scatter(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, S of x, n X'X - S S'), exact, of the rows of `usable`; n is 0 without rows."""
    first = rows.select(F.size("embedding")).first()
    if first is None:
        return 0, [], np.zeros((0, 0), object)
    d = first[0]
    parts = rows.mapInArrow(_add_up(d), "i int, j int, low decimal(38,0), high decimal(38,0)")
    # one row for each entry of the matrix, whatever the number of vectors
    sums = {(r.i, r.j): (int(r.high) << HALF) + int(r.low) for r in parts.groupBy("i", "j").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).collect()}
    n = sums[-1, -1]
    s = [sums[i, -1] for i in range(d)]
    out = np.zeros((d, d), object)
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = n * sums[i, j] - s[i] * s[j]
    return n, [x + n * OFFSET for x in s], out


def components(n: int, matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns, shares of the trace) of the largest components of matrix / n^2."""
    d = len(matrix)
    covariance = np.array([[matrix[i, j] / (n * n) for j in range(d)] for i in range(d)])  # true division of integers rounds once
    e, w = np.linalg.eigh(covariance)
    e, w = e[::-1], w[:, ::-1]
    k = min(most, int((e > max(RANK * e[0], 0.0)).sum()))
    trace = sum(int(matrix[i, i]) for i in range(d)) / (n * n)
    return e[:k], w[:, :k], e[:k] / trace if trace else e[:k]


def centred(y: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n x - S: integers of 64 bits where they fit, else Python's."""
    top = max(int(np.abs(y).max(initial=0)) * n, max(abs(v) for v in s))
    if top < 1 << 62:
        return n * y - np.array(s, np.int64)
    return n * y.astype(object) - np.array(s, object)


def _spans(z: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    top = int(abs(z).max()) if z.size else 0
    if z.dtype == object or top * top * z.shape[1] >= 1 << 63:
        return [sum(int(v) * int(v) for v in r) for r in z]
    return (z * z).sum(1).tolist()


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error for each usable row and component."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = usable(vectors)
    n, s, matrix = scatter(rows)
    out = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    e, w, explained = components(n, matrix, most) if n else (np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    if not len(e):
        return vectors.sparkSession.createDataFrame([], out)
    d, k = len(s), len(e)
    shifted = [v - n * OFFSET for v in s]
    onto = w / np.sqrt(e)

    def project(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = centred(y, n, shifted)
        return z, (z.astype(np.float64) / n) @ onto

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task: sums (j = -1), and products centred on the task's own mean plus the mean's part."""
        turn_to("whitening")
        count, total, m = 0, np.zeros(k), np.zeros((k, k))
        for _, y in _blocks(batches, d):
            v = project(y)[1]
            mean, rows_here = v.mean(0), len(v)
            apart = mean - total / count if count else mean
            m += (v - mean).T @ (v - mean) + (np.outer(apart, apart) * count * rows_here / (count + rows_here) if count else 0.0)
            total += v.sum(0)
            count += rows_here
        if count:
            i, j = np.triu_indices(k)
            value = (m + np.outer(total, total) / count)[i, j]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(k), i]), pa.int32()), pa.array(np.concatenate([np.full(k, -1), j]), pa.int32()), pa.array(np.concatenate([total, value]))], names=["i", "j", "value"])

    found = {(r.i, r.j): r.value for r in rows.mapInArrow(moments, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    error = max(abs((found[i, j] - found[i, -1] * found[j, -1] / n) / n - (i == j)) for i in range(k) for j in range(i, k))
    share, number = np.tile(explained, BLOCK), np.tile(np.arange(1, k + 1, dtype=np.int32), BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("whitening")
        for ids, y in _blocks(batches, d):
            z, v = project(y)
            m = len(y) * k
            each = pa.array(np.repeat(np.arange(len(y)), k))
            deviation = pa.array([decimal.Decimal(x) for x in _spans(z)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [ids.take(each), pa.array(number[:m]), pa.array(np.full(m, n)), deviation.take(each), pa.array(v.ravel()), pa.array(share[:m]), pa.array(np.full(m, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))
