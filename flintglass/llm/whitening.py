"""Whitening of embeddings by MLlib's singular value decomposition of the centred rows.

An entry c becomes the whole number floor(1024 * c) + 100000, so sums, means and deviations are exact. Rows are
centred and given to RowMatrix.computeSVD, which multiplies them on the executors and decomposes
one dimensions x dimensions matrix on the driver. A singular value s of n centred rows is an eigenvalue s * s / n of their
covariance (divisor n), its right vector the component. The trace doesn't come from the
decomposition, which has the leading values only, but from the rows' exact deviations.

Rows whose vector is null or holds null or non-finite entries are left out, as are rows of another length than the commonest
(the greatest of several) and entries of 2^40 or more, whose whole numbers have no exact place in doubles and sums.
Null keys and repeated rows count and are returned as any other. Components whose
variance is below RANK^2 of the first one's are rounding errors of the decomposition and aren't returned: none for one row or for equal
rows. deviation is null where it exceeds a long; deviation_digits always has it. An empty table gives an empty table. Columns other than the two named ones
aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flintglass.llm.store import Scratch

COMPONENTS = 8
SCALE, SHIFT, LIMIT = 1024, 100_000, 1 << 40
RANK = 1e-6
#: Up to so many dimensions computeSVD is asked for over half of the vectors, for which it decomposes in full instead of iterating to a tolerance.
FULL = 4096
_RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"


def whole(table: DataFrame, key: str, vector: str, scratch: Scratch) -> DataFrame:
    """id and x, the vector in whole numbers, of the rows that count."""
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LIMIT))
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT))
    rows = scratch.keep(table.filter(F.col(vector).isNotNull() & finite).select(F.col(key).alias("id"), x.alias("x")))
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("x") == (usual["d"] if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and each dimension's sum: partial sums of batches, added exactly."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):  # 4096 entries below 2^51 have sums below 2^63
                x = _matrix(b.column("x").slice(lo, 4096))
                yield pa.RecordBatch.from_arrays([pa.array(range(x.shape[1]), pa.int32()), pa.array([len(x)] * x.shape[1], pa.int64()), pa.array(x.sum(axis=0))], names=["dim", "n", "total"])

    partial = rows.select("x").mapInArrow(run, "dim int, n long, total long")
    got = partial.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(28,0)")).alias("total")).orderBy("dim").collect()
    return (got[0]["n"], [int(r["total"]) for r in got]) if got else (0, [])


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """For each row the sum of (n * x - total)^2 over its dimensions, in exact integers."""
    low, high = (np.array([int(v) for v in f(axis=0)], object) * n - np.array(total, object) for f in (x.min, x.max))
    reach = max(max(abs(v) for v in low), max(abs(v) for v in high))
    if reach * reach * x.shape[1] >= 1 << 63 or n * int(np.abs(x).max()) >= 1 << 63:
        far = x.astype(object) * n - np.array(total, object)
    else:
        far = x * n - np.array(total, np.int64)
    return (far * far).sum(axis=1).tolist()


def components(centred: DataFrame, n: int, dims: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of the covariance of the rows x of centred, at most k, and their unit eigenvectors in columns."""
    vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("x").alias("v")), "v")
    found = RowMatrix(vectors, n, dims).computeSVD(min(dims, max(k, dims // 2 + 1)) if dims <= FULL else k, rCond=RANK)
    values, axes = found.s.toArray()[:k] ** 2 / n, found.V.toArray()[:, :k]
    real = values > 0
    return values[real], axes[:, real]


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, scratch: Scratch | None = None) -> DataFrame:
    """For each row that counts and each of up to k components: key, component, n, deviation, whitened, explained, identity_error and deviation_digits."""
    scratch, spark = scratch or Scratch(table.sparkSession), table.sparkSession
    rows = whole(table, key, vector, scratch)
    kind = f"`{key}` {table.schema[key].dataType.simpleString()}, {_RESULT}"
    n, total = sums(rows)
    dims = len(total)
    if not n or not dims:
        return spark.createDataFrame([], kind)
    base = [t // n for t in total]
    rest = [(t - b * n) / n for t, b in zip(total, base, strict=True)]  # the mean is base + rest: x - base is exact

    def centre(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                x = _matrix(part.column("x"))
                away = deviations(x, n, total)
                near = (x - np.array(base, np.int64)).astype(float) - np.array(rest)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([v if v < 1 << 63 else None for v in away], pa.int64()), pa.array(map(str, away), pa.string()), flat], names=["id", "deviation", "deviation_digits", "x"])

    id_kind = table.schema[key].dataType.simpleString()
    centred = scratch.keep(rows.mapInArrow(centre, f"id {id_kind}, deviation long, deviation_digits string, x array<double>"))
    trace = centred.agg(F.sum(F.col("deviation_digits").cast("double"))).first()[0] / n / n / n
    if trace == 0:
        return spark.createDataFrame([], kind)
    values, axes = components(centred, n, dims, k)
    scaled = axes / np.sqrt(values)

    def project(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                w = _matrix(part.column("x")) @ scaled
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * len(values)), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "deviation", "deviation_digits")), flat], names=["id", "deviation", "deviation_digits", "w"])

    white = scratch.keep(centred.mapInArrow(project, f"id {id_kind}, deviation long, deviation_digits string, w array<double>"))
    w = [F.col("w")[i] for i in range(len(values))]
    means = white.agg(*(F.avg(c) for c in w)).first()
    cells = [(i, j) for i in range(len(w)) for j in range(i, len(w))]
    cov = white.agg(*(F.avg((w[i] - F.lit(means[i])) * (w[j] - F.lit(means[j]))) for i, j in cells)).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(cov, cells, strict=True))
    each = F.arrays_zip(F.col("w").alias("whitened"), F.array(*(F.lit(float(v / trace)) for v in values)).alias("explained"))
    return white.select("id", "deviation", "deviation_digits", F.posexplode(each).alias("at", "c")).select(
        F.col("id").alias(key),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "c.whitened",
        "c.explained",
        F.lit(float(error)).alias("identity_error"),
        "deviation_digits",
    )
