"""Whitening of embeddings by TSQR (operator 12).

Rows are centred with exact integer sums, every task reduces its rows to one triangular factor by QR, the factors meet in a tree
of QR steps, and the singular values and right vectors of the last one whiten. The covariance is never formed, so small components keep their digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stored, tidy

#: Whole numbers up to here are kept in 64 bits, where sums and products of two stay exact; larger ones become Python's.
SAFE = 1 << 62


def quantised(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id, x: floor(scale * entry) as longs (beyond a long: its limits). Null vectors and those with a null or non-finite entry go."""
    wide = F.col(vector).cast("array<double>")
    odd = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(wide, lambda c: F.floor(c * F.lit(float(scale))))
    return rows.where(F.col(vector).isNotNull() & ~odd).select(F.col(id).alias("vec_id"), whole.alias("x"))


def usual_length(fit: DataFrame) -> int:
    """The most common length of the vectors (ties: the longer); 0 without any."""
    first = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and their sum by dimension, exactly. A task sends d + 1 rows."""

    def work(batches):
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            sums = x.sum(axis=0) if _largest(x) * max(1, len(x)) < SAFE else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, sums, strict=True)]
        values = pa.array([str(v) for v in [*total, n]])
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), values], names=["i", "v"])

    parts = fit.select("x").mapInArrow(tidy(work), "i int, v string")
    sums = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()}
    return sums.get(d, 0), [sums.get(i, 0) for i in range(d)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly."""
    if n * _largest(x) < SAFE and max(map(abs, sums), default=0) < SAFE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _triangle(rows: np.ndarray, d: int) -> np.ndarray:
    """The factor R of rows, d by d (zero rows at its end where there are fewer)."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((d - len(r), d))])


def final_factor(fit: DataFrame, n: int, sums: list[int], fan: int = 8) -> np.ndarray:
    """R of all centred rows: one factor a task, then ``fan`` of them at a time in a tree of shuffles. Only the last comes to the driver."""
    d = len(sums)

    def reduce_rows(batches):
        r = np.zeros((d, d))
        for batch in batches:
            centred = (_centred(_matrix(batch.column(0), d), n, sums) / n).astype(np.float64)
            r = _triangle(np.vstack([r, centred]), d)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], names=["slot", "r"])

    def merge(table: pa.Table) -> pa.Table:
        factors = sorted(zip(table["part"].to_pylist(), table["r"].to_pylist(), strict=True))
        r = _triangle(np.vstack([np.frombuffer(x).reshape(d, d) for _, x in factors]), d)
        return pa.table({"slot": table["slot"][:1], "r": pa.array([r.tobytes()])})

    factors = cut(fit.select("x").mapInArrow(tidy(reduce_rows), "slot long, r binary"))
    width = (factors.agg(F.max("slot")).first()[0] or 0) + 1
    while width > 1:
        groups = factors.select(F.floor(F.col("slot") / fan).alias("slot"), F.col("slot").alias("part"), "r").groupBy("slot")
        factors = groups.applyInArrow(merge, "slot long, r binary")
        width = -(-width // fan)
    last = factors.collect()
    return np.frombuffer(last[0]["r"]).reshape(d, d) if last else np.zeros((d, d))


def principal(r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling (those that are nothing but rounding are 0), and unit eigenvectors as rows, of the covariance whose rows R stands for.

    Of each vector the entry of the largest size is positive.
    """
    _, s, v = np.linalg.svd(r)
    s = np.where(s > s.max(initial=0.0) * max(n, len(s)) ** 0.5 * np.finfo(float).eps, s, 0.0)
    largest = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1)
    return s * s / n, v * np.sign(largest)


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256, dimension: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every vector and component.

    The fit list is each distinct vector of whole numbers once; n, sums, eigenvectors and covariances are over it. Vectors that are
    null, hold null or non-finite entries, or are not of ``dimension`` entries (the most common length where it is None) are dropped.
    Repeated rows and ids are returned as often as they come. ``whitened`` is null on components without variance (all of them
    where n is 1) and ``explained`` then 0; identity_error leaves those out. deviation is exact, null beyond a long. An empty table gives an empty result.
    """
    x = quantised(rows, id, vector, scale)
    fit = stored(x.select("x").distinct(), "vectors")
    d = usual_length(fit) if dimension is None else dimension
    fit, x = fit.where(F.size("x") == d), x.where(F.size("x") == d)
    kind = x.schema["vec_id"].dataType.simpleString()
    n, sums = exact_sums(fit, d) if d else (0, [])
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    values, vectors = principal(final_factor(fit, n, sums), n)
    k = min(components, d)
    values, axes, whole = values[:k], vectors[:k], float(values.sum())
    live = values > 0
    project = np.where(live, axes.T / np.sqrt(np.where(live, values, 1.0)), np.nan)
    explained = values / whole if whole else np.zeros(k)
    error = identity_error(fit, n, sums, project[:, live])

    def work(batches):
        for batch in batches:
            moved = _centred(_matrix(batch.column(1), d), n, sums)
            if _largest(moved) ** 2 * d >= SAFE:
                moved = moved.astype(object)
            deviation = [int(v) if v < 1 << 63 else None for v in (moved * moved).sum(axis=1)]
            white = (moved / n).astype(np.float64) @ project
            m = len(moved)
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(at)),
                    pa.array(white.ravel(), from_pandas=True),  # no number: null
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(tidy(work), schema)


def identity_error(fit: DataFrame, n: int, sums: list[int], project: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity; a task sends one row."""
    d, k = project.shape
    if not k:
        return 0.0

    def work(batches):
        total, outer = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            white = (_centred(_matrix(batch.column(0), d), n, sums) / n).astype(np.float64) @ project
            total += white.sum(axis=0)
            outer += white.T @ white
        flat = np.concatenate([total, outer.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    parts = fit.select("x").mapInArrow(tidy(work), "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(k + k * k)
    for i, v in parts.collect():
        flat[i] = v
    mean, outer = flat[:k] / n, flat[k:].reshape(k, k) / n
    return float(np.abs(outer - np.outer(mean, mean) - np.eye(k)).max())
