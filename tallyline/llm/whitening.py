"""Whitening of whole-number vectors by blockwise QR and a bidiagonal qd solver.

1. Counts and exact sums S of every dimension, one row per task, summed by Spark.
2. Rows n x - S (exact whole numbers) over n are the centred vectors. Each task reduces
   its rows, block by block, to the R factor of a QR factorisation; R factors are
   stacked and reduced again, ``FAN`` at a time, until one is left. Covariances are
   never formed, so small variances keep their digits.
3. The driver takes that one d x d triangle: Householder bidiagonalisation, dqds for the
   singular values, twisted factorisations for the right singular vectors (:mod:`qd`).
   With s a singular value, s^2 / n is the variance of its component.
4. Directions (d x count numbers) go to the tasks, which project every row. The covariance
   of the projections, summed the same way, tells how far they are from white.

Bounds: a task holds one block of rows and FAN triangles of d x d numbers; the driver
holds one. d is the vectors' length, which does not grow with the rows.

Defined results: :func:`quantise` drops rows whose vector is NULL or holds a NULL, NaN or
infinite entry. Vectors of another length than most (of equally many: the shorter) are not
of the same space, and dropped by :func:`apply`. Components whose singular value is at most
``NO_VARIANCE`` of the largest have no variance to divide by and are left out, so fewer than
``count`` may come back; equal vectors, a single vector or an empty table have none.
Repeated rows and NULL or repeated ids are rows of their own. Input columns named like an
output column (in any case) are replaced by it. A squared deviation beyond a long is NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm import qd
from tallyline.llm.common import free_name, numbered
from tallyline.session import materialize

FAN = 32  # triangles reduced to one in a task
BLOCK = 4096  # rows of one QR step
NO_VARIANCE = 1e-10
_FACTOR = "part bigint, factor array<double>"


@dataclass(frozen=True)
class Whitening:
    """What was learned: rows, sums, falling variances of the kept components,
    their directions (d x components) and the trace of the covariance."""
    n: int
    sums: tuple[int, ...]
    variances: np.ndarray
    directions: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.variances]


def quantise(df: DataFrame, vector_col: str, out: str, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """``df`` with ``out`` = floor(scale * c) + shift of every entry c, for rows with
    a vector of finite entries."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    sound = df.where(vector.isNotNull() & finite)
    return sound.withColumn(out, F.transform(vector, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift)))


def _matrices(column: pa.Array, dims: int | None = None) -> Iterator[np.ndarray]:
    """The vectors of one length (or of ``dims``) in a list column, as whole-number matrices."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist() if dims is None else [dims]:
        rows = np.flatnonzero(sizes == size)
        if len(rows) and size:
            yield flat[starts[rows][:, None] + np.arange(size)].astype(np.int64)


def _sums(batches):
    held: dict[int, list] = {}
    for batch in batches:
        for x in _matrices(batch.column(0)):
            n, total = held.get(x.shape[1], (0, 0))
            held[x.shape[1]] = (n + len(x), total + x.sum(axis=0))
    for dims, (n, total) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([dims]), pa.array([n]), pa.array([total.tolist()])],
                                         names=["dims", "n", "sums"])


def _factors(sums: tuple[int, ...], n: int):
    """A task's centred rows to one R factor."""
    centre, dims = np.array(sums, dtype=np.int64), len(sums)

    def run(batches):
        factor, held, rows = np.zeros((0, dims)), [], 0
        for batch in batches:
            for x in _matrices(batch.column(0), dims):
                held.append((n * x - centre) / n)
                rows += len(x)
            if rows >= BLOCK:
                factor, held, rows = np.linalg.qr(np.concatenate([factor, *held]), mode="r"), [], 0
        if held:
            factor = np.linalg.qr(np.concatenate([factor, *held]), mode="r")
        if len(factor):
            yield _factor_batch(TaskContext.get().partitionId(), factor)
    return run


def _factor_batch(part: int, factor: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([factor.ravel().tolist()], pa.list_(pa.float64()))],
                                      names=["part", "factor"])


def _joined(dims: int):
    def run(table: pa.Table) -> pa.Table:
        stacked = np.concatenate([np.array(f).reshape(-1, dims) for f in table["factor"].to_pylist()])
        return pa.Table.from_batches([_factor_batch(table["part"][0].as_py() // FAN, np.linalg.qr(stacked, mode="r"))])
    return run


def fit(df: DataFrame, vector_col: str, count: int) -> Whitening | None:
    """The first ``count`` whitening directions of a column of whole-number vectors;
    None where there is no vector."""
    rows = df.select(F.col(f"`{vector_col}`").cast("array<bigint>").alias("x")).where("x is not null")
    sums = materialize(rows.mapInArrow(_sums, "dims bigint, n bigint, sums array<bigint>"), "vector_sums")
    most = sums.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    if not most:
        return None
    dims, n = most[0]["dims"], most[0]["n"]
    totals = (sums.where(F.col("dims") == dims).select(F.posexplode("sums").alias("at", "v"))
              .groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect())  # one row per dimension
    centre = tuple(r["v"] for r in totals)
    parts = materialize(rows.mapInArrow(_factors(centre, n), _FACTOR), "factors")
    while (last := parts.agg(F.max("part")).first()[0]) > 0:
        group = F.floor(F.col("part") / FAN).alias("of")
        parts = materialize(parts.groupBy(group).applyInArrow(_joined(dims), _FACTOR), f"factors-{last}")
    factor = np.array(parts.first()["factor"]).reshape(-1, dims)
    square = np.zeros((dims, dims))
    square[:len(factor)] = factor
    values, first, directions = qd.right_singular(square, count)
    kept = np.sqrt(np.maximum(first, 0.0)) > NO_VARIANCE * np.sqrt(values[0])
    return Whitening(n, centre, first[kept] / n, directions[:, kept], float(values.sum()) / n)


def _squares(deviations: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; None beyond a long."""
    rough = np.square(deviations.astype(float)).sum(axis=1)
    if rough.max(initial=0.0) < 2.0 ** 62:
        return np.square(deviations).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in deviations.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def apply(df: DataFrame, vector_col: str, white: Whitening) -> DataFrame:
    """The rows of ``df`` with a vector of the learned length, with ``deviation``
    (sum of (n x - S)^2, exact) and ``whitened`` (array, one entry per component)."""
    added = [("deviation", T.LongType()), ("whitened", T.ArrayType(T.DoubleType()))]
    kept = [c for c in df.columns if c.lower() not in {n for n, _ in added}]
    n, dims, centre = white.n, len(white.sums), np.array(white.sums, dtype=np.int64)
    project = white.directions / np.sqrt(white.variances)
    name = free_name(df, "vector_of")
    rows = (df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{vector_col}`").cast("array<bigint>").alias(name))
            .where(F.size(F.col(name)) == dims))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, t) for n, t in added)])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            (x,) = _matrices(batch.column(batch.num_columns - 1), dims)
            deviations = n * x - centre
            whitened = (deviations / n) @ project
            ends = np.arange(len(x) + 1, dtype=np.int32) * project.shape[1]
            made = [pa.array(_squares(deviations), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(whitened.ravel()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.fieldNames())

    return numbered(rows).mapInArrow(run, schema)


def identity_error(whitened: DataFrame, column: str, components: int) -> float:
    """The largest absolute entry of the covariance of ``column`` minus the identity."""
    def run(batches):
        n, total, squares = 0, np.zeros(components), np.zeros((components, components))
        for batch in batches:
            if batch.num_rows:
                y = np.asarray(batch.column(0).flatten()).reshape(-1, components)
                n, total, squares = n + len(y), total + y.sum(axis=0), squares + y.T @ y
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[float(n), *total.tolist(), *squares.ravel().tolist()]])],
                                             names=["sums"])

    sums = whitened.select(F.col(f"`{column}`")).mapInArrow(run, "sums array<double>")
    found = (sums.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
             .orderBy("at").collect())  # components * (components + 1) + 1 rows
    flat = np.array([r["v"] for r in found])
    mean, squares = flat[1:components + 1] / flat[0], flat[components + 1:].reshape(components, components) / flat[0]
    return float(np.abs(squares - np.outer(mean, mean) - np.eye(components)).max())


def whiten(df: DataFrame, vector_col: str, count: int) -> tuple[DataFrame, Whitening | None, float | None]:
    """:func:`fit` and :func:`apply` on the same rows, written once: (rows, what was
    learned, :func:`identity_error`). Without any component the rows are empty."""
    white = fit(df, vector_col, count)
    if white is None or not len(white.variances):
        empty = df.limit(0).withColumn("deviation", F.lit(None).cast("bigint"))
        return empty.withColumn("whitened", F.lit(None).cast("array<double>")), white, None
    rows = materialize(apply(df, vector_col, white), "whitened")
    return rows, white, identity_error(rows, "whitened", len(white.variances))
