"""Whitening of embeddings by matrix-free block subspace iteration.

Entries become whole numbers, so sums and deviations are exact. The covariance is never
formed: a pass over the vectors computes X'(XQ) of the centred rows for a block Q of
orthonormal columns, each task for its own rows. What tasks return is added up in Spark, and
a few matrices of dimension x block size reach the driver. There the directions that the
pass has brought in are made orthonormal (QR), the covariance is diagonalised within all
directions kept (Rayleigh-Ritz), and the residual of each leading vector is measured. Parts
of the residuals outside the directions kept are the next block. It ends when the residuals
of all ``k`` components are small, or the directions span the whole space. Directions
beyond ``KEPT`` blocks give way to the leading Ritz vectors, so the driver's memory does not
grow with the passes.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries take
no part, nor do vectors of another length than the commonest (of equally common ones the
longest); a null ``vec_id`` and repeated rows are handled row by row; directions
without variance give no component, so equal vectors, a single one, or none give no rows;
entries beyond +-2**37 count as that; a deviation beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.llm._common import documents_of, give_back

K = 8
SCALE, SHIFT = 1024, 100_000
BLOCK = 32
KEPT = 8
#: Largest residual of a certified component, as a part of the largest eigenvalue.
CERTIFIED = 1e-13
MOST_PASSES = 500
#: Components below this part of the largest eigenvalue are rounding.
RANK = 1e-12
#: Groups of tasks whose matrices are added up, in two steps; the last of them reach the driver.
FANS = (1024, 32)
ROWS = 4096
LARGEST = 1 << 47

_TYPES = {"vec_id": pa.int64(), "component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(),
          "whitened": pa.float64(), "explained": pa.float64(), "identity_error": pa.float64()}


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` for every row whose vector has entries, all of them finite."""
    x = F.col("embedding").cast("array<double>")
    rows = documents_of(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & sound)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole entries, up to ``ROWS`` rows of one length at a time."""
    for batch in batches:
        ids, lists = batch.column("vec_id"), batch.column("x")
        sizes = np.diff(lists.offsets.to_numpy())
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            for at in range(0, len(rows), ROWS):
                some = pa.array(rows[at : at + ROWS])
                flat = lists.take(some).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                whole = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT
                yield ids.take(some), whole
        give_back()


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors of the commonest length and the sum of each entry, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for _, whole in _matrices(batches):
            n, total = found.get(whole.shape[1], (0, 0))
            found[whole.shape[1]] = n + len(whole), total + whole.sum(axis=0).astype(object)  # a block's sums fit 64 bits
        parts = [(dim, at, n, str(s)) for dim, (n, total) in found.items() for at, s in enumerate(total.tolist())]
        columns = list(zip(*parts)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["dim", "at", "n", "s"])

    parts = rows.select("vec_id", "x").mapInArrow(run, "dim int, at int, n long, s string")
    added = parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    top = added.where("at = 0").orderBy(F.desc("n"), F.desc("dim")).select("dim", "n").first()
    if top is None:
        return 0, []
    return top.n, [int(r.s) for r in added.where(F.col("dim") == top.dim).orderBy("at").select("s").collect()]


def centred(whole: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n*x - S`` without rounding."""
    if n * max(int(np.abs(whole).max(initial=0)), 1) < 1 << 61:
        return whole * n - np.array(sums, np.int64)
    return whole.astype(object) * n - np.array(sums, object)


def _deviations(apart: np.ndarray) -> pa.Array:
    """The sum of squares of each row; null beyond 64 bits."""
    near = (apart.astype(np.float64) ** 2).sum(axis=1)
    if apart.dtype != object and (near < 2.0**62).all():
        return pa.array((apart * apart).sum(axis=1), pa.int64())
    whole = [sum(v * v for v in row) if about < 2.0**64 else 1 << 63 for row, about in zip(apart.tolist(), near.tolist())]
    return pa.array([v if v < 1 << 63 else None for v in whole], pa.int64())


def _added(rows: DataFrame, n: int, sums: list[int], part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of ``part`` of the centred rows, one matrix of ``shape`` for each task, added up in steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, number = np.zeros(shape), TaskContext.get().partitionId()
        for _, whole in _matrices(batches):
            if whole.shape[1] == len(sums):
                total += part(centred(whole, n, sums).astype(np.float64) / n)
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([total.tobytes()], pa.binary())], ["task", "data"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(shape)
        for at in np.argsort(group.column("task").to_numpy()).tolist():  # in order, so that sums repeat
            total += np.frombuffer(group.column("data")[at].as_py()).reshape(shape)
        return pa.table({"task": pa.array([group.column("task")[0].as_py()], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("vec_id", "x").mapInArrow(run, "task long, data binary")
    for fan in FANS:
        parts = parts.groupBy((F.col("task") % fan).alias("fan")).applyInArrow(add, "task long, data binary")
    found = sorted((r.task, bytes(r.data)) for r in parts.collect())
    return sum((np.frombuffer(data).reshape(shape) for _, data in found), np.zeros(shape))


def leading(rows: DataFrame, n: int, sums: list[int], k: int = K, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` largest eigenvalues of the covariance, their unit vectors as columns, and its trace."""
    dim = len(sums)
    trace = float(_added(rows, n, sums, lambda x: np.array([[(x * x).sum()]]), (1, 1))[0, 0]) / n
    k, block = min(k, dim), min(max(block, k), dim)
    fresh = np.linalg.qr(np.random.default_rng(20240611).standard_normal((dim, block)))[0]
    kept, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    for _ in range(MOST_PASSES):
        product = _added(rows, n, sums, lambda x, q=fresh: x.T @ (x @ q), fresh.shape) / n
        kept, image = np.hstack([kept, fresh]), np.hstack([image, product])
        small = kept.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        kept, image = kept @ turn, image @ turn
        residual = image - kept * values
        largest = max(values[0], 0.0)
        if kept.shape[1] >= dim or np.linalg.norm(residual[:, :k], axis=0).max() <= CERTIFIED * largest:
            return values[:k], kept[:, :k], trace
        if kept.shape[1] + block > max(KEPT * block, 2 * k):
            stay = max(2 * block, 2 * k)
            kept, image = kept[:, :stay], image[:, :stay]
        fresh = residual[:, : min(block, dim - kept.shape[1])]
        for _ in range(2):  # once more, as the first leaves rounding
            fresh = fresh / np.maximum(np.linalg.norm(fresh, axis=0), 1e-300)
            fresh = np.linalg.qr(fresh - kept @ (kept.T @ fresh))[0]
    raise ArithmeticError(f"the components are not certified after {MOST_PASSES} passes")


def whitened(vectors: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row that takes part and each component."""
    spark: SparkSession = vectors.sparkSession
    rows = sound_vectors(vectors)
    n, sums = _sums(rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], schema)
    values, axes, trace = leading(rows, n, sums, k, block)
    real = values > max(RANK * max(values[0], 0.0), 0.0)
    values, axes = values[real], axes[:, real]
    if not len(values):
        return spark.createDataFrame([], schema)
    weights = axes / np.sqrt(values)
    size = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        y = x @ weights
        return np.vstack([y.T @ y, y.sum(axis=0)])

    found = _added(rows, n, sums, moments, (size + 1, size)) / n
    error = float(np.abs(found[:size] - np.outer(found[size], found[size]) - np.eye(size)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, whole in _matrices(batches):
            if whole.shape[1] != len(sums):
                continue
            apart, m = centred(whole, n, sums), len(whole)
            each = pa.array(np.repeat(np.arange(m), size))
            values = [ids.take(each), np.tile(np.arange(1, size + 1), m), np.full(m * size, n), _deviations(apart).take(each),
                      (apart.astype(np.float64) / n @ weights).ravel(), np.tile(explained, m), np.full(m * size, error)]
            yield pa.RecordBatch.from_arrays([pa.array(v).cast(t) for v, t in zip(values, _TYPES.values())], list(_TYPES))

    return rows.mapInArrow(run, schema)
