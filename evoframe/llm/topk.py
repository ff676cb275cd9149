"""Exact top-k inner products: norm buckets, pruned by length or by coordinate, then verified.

Vectors are grouped by length into buckets, the longest first. Each query first meets
the longest bucket of its dimension, which gives a k-th score to beat. For every other
bucket that score, divided by the query's length and the bucket's largest length, is the
least cosine a vector must reach. If it is above 1 the bucket is passed over. If it is
high, the bucket is searched by coordinate: on the query's largest components only
vectors within the feasible range can reach the cosine. Else it is searched by length:
only vectors long enough for the score are looked at. What is left is verified by its
whole product.

Queries come in blocks and so do candidates; every pair of blocks is one row of work,
dealt out by Spark, and only the k best of a query leave it.

Defined results: vectors that are null, empty, or hold null or non-finite components, and
rows with a null ``vec_id``, take no part; a query meets vectors of its own dimension
only; rows with the query's ``vec_id`` are its own; other rows with equal ids each
count; ties go to the smaller ``vec_id``; other columns are ignored. Products beyond 2**53
are made with Python's integers, and beyond 64 bits are not supported.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evoframe.llm._common import documents_of, materialize, per_batch, shuffle_partitions

K = 10
SCALE = 1024
EVERY = 100
BUCKET = 4096
QUERY_BLOCK = 256
#: From this least cosine on, a bucket is searched by coordinate.
COORDINATE_FROM = 0.7
FOCUS = 3
NONE = -(1 << 63)  # stands for no score to beat yet

_PACKED = "dim int, block long, n long, longest double, ids binary, data binary"


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, x`` (whole numbers as doubles), ``dim`` and ``norm`` for every row that takes part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = documents_of(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & sound)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * float(scale)).cast("double")).alias("x"))
    squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    return rows.withColumn("dim", F.size("x")).withColumn("norm", F.sqrt(squares))


def _pack(batch: pd.DataFrame) -> pd.DataFrame:
    """One row for a group of (dim, block): ids and components one after the other, the longest vectors first."""
    batch = batch.sort_values(["norm", "vec_id"], ascending=[False, True], kind="stable")
    data = np.array(batch.x.tolist(), np.float64)
    first = batch.iloc[0]
    return pd.DataFrame(
        {"dim": [first.dim], "block": [first.block], "n": [len(batch)], "longest": [float(first.norm)],
         "ids": [batch.vec_id.to_numpy(np.int64).tobytes()], "data": [data.tobytes()]}
    )


def _products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    if len(vectors) and float(np.abs(vectors).max()) * float(np.abs(query).sum()) >= 2.0**53:
        whole = [sum(int(a) * int(b) for a, b in zip(v, query)) for v in vectors]
        return np.array(whole, np.int64)
    return (vectors @ query).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_bucket(bucket: "Bucket", query: np.ndarray, own: int, least: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of one bucket, with a score of ``least`` at least."""
    length = math.sqrt(float(query @ query))
    where = np.arange(len(bucket.ids))
    if least is not None and least > 0:
        slack = least * (1 - 1e-9)
        if slack > length * bucket.norms[0]:
            return bucket.ids[:0], np.zeros(0, np.int64)
        cosine = slack / (length * bucket.norms[0])
        if cosine >= COORDINATE_FROM:
            where = bucket.feasible(query / length, cosine)
        else:
            where = where[: int(np.searchsorted(-bucket.norms, -(slack / length), "right"))]
    where = where[bucket.ids[where] != own]
    found, scores = bucket.ids[where], _products(bucket.vectors[where], query)
    if least is not None:
        found, scores = found[scores >= least], scores[scores >= least]
    return _best(found, scores, k)


class Bucket:
    """Vectors from the longest to the shortest, and their directions sorted by each component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.units = vectors / np.maximum(self.norms, 1e-300)[:, None]
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def feasible(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Rows that may have this cosine with ``unit``, judged by its largest components.

        The angle of a direction to an axis differs from the query's by no more than
        the angle between the two, so each component has a range to lie in.
        """
        angle, keep = math.acos(min(1.0, cosine)), None
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS].tolist():
            if f not in self._sorted:
                order = np.argsort(self.units[:, f], kind="stable")
                self._sorted[f] = order, self.units[order, f]
            order, values = self._sorted[f]
            to_axis = math.acos(max(-1.0, min(1.0, float(unit[f]))))
            low, high = math.cos(min(math.pi, to_axis + angle)), math.cos(max(0.0, to_axis - angle))
            a, b = np.searchsorted(values, low - 1e-7, "left"), np.searchsorted(values, high + 1e-7, "right")
            keep = order[a:b] if keep is None else keep[(self.units[keep, f] >= low - 1e-7) & (self.units[keep, f] <= high + 1e-7)]
        return np.sort(keep)


def _search(k: int, with_least: bool):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        parts: list[tuple] = []
        for row in batch.itertuples():
            ids = np.frombuffer(row.ids, np.int64)
            bucket = Bucket(ids, np.frombuffer(row.data, np.float64).reshape(len(ids), -1))
            query_ids = np.frombuffer(row.query_ids, np.int64)
            queries = np.frombuffer(row.query_data, np.float64).reshape(len(query_ids), -1)
            least = np.frombuffer(row.least, np.int64) if with_least else np.full(len(query_ids), NONE)
            for i, (own, query, bound) in enumerate(zip(query_ids.tolist(), queries, least.tolist())):
                found, scores = search_bucket(bucket, query, own, None if bound == NONE else bound, k)
                parts.append((len(found), row.dim, row.query_block, i, own, found, scores))
        counts = [p[0] for p in parts]
        names = ("dim", "query_block", "query_no", "query_id")
        out = pd.DataFrame({name: np.repeat(np.array([p[1 + j] for p in parts], np.int64), counts) for j, name in enumerate(names)})
        out["vec_id"] = np.concatenate([p[5] for p in parts])
        out["score"] = np.concatenate([p[6] for p in parts])
        return out.astype({"dim": np.int32})

    return per_batch(run)


_FOUND = "dim int, query_block long, query_no long, query_id long, vec_id long, score long"


def _blocked(rows: DataFrame, size: int, *order) -> DataFrame:
    """Blocks of ``size`` rows of one dimension at most, alike in ``order``; their number follows the rows."""
    span = Window.partitionBy("dim", "part").orderBy(*order)
    parts = rows.repartitionByRange(max(1, -(-rows.count() // size)), *order).withColumn("part", F.spark_partition_id())
    return parts.withColumn("block", F.col("part").cast("long") * (1 << 30) + F.floor((F.row_number().over(span) - 1) / size)).drop("part")


def _pairs(buckets: DataFrame, queries: DataFrame, salts: int = 64) -> DataFrame:
    """Every block of queries with every bucket of its dimension, dealt out over all tasks."""
    left = buckets.select("dim", "block", F.pmod("block", F.lit(salts)).alias("salt"))
    right = queries.select("dim", "query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    ids = left.join(right, ["dim", "salt"]).drop("salt")
    work = ids.join(buckets, ["dim", "block"]).join(queries, ["dim", "query_block"])
    return work.repartition(shuffle_partitions(buckets.sparkSession))


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY, bucket: int = BUCKET, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries: rows whose ``vec_id`` is divisible by ``every``."""
    rows = materialize(integer_vectors(vectors, scale))
    buckets = materialize(_blocked(rows, bucket, F.desc("norm"), "vec_id").groupBy("dim", "block").applyInPandas(_pack, _PACKED))
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = _blocked(asked, query_block, F.asc("vec_id")).groupBy("dim", "block").applyInPandas(_pack, _PACKED)
    queries = materialize(
        queries.select("dim", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("data").alias("query_data"))
    )

    # The longest bucket of each dimension sets the score to beat.
    top = buckets.groupBy("dim").agg(F.max_by("block", F.struct("longest", -F.col("block"))).alias("block"))
    seeds = materialize(_pairs(buckets.join(top, ["dim", "block"]), queries).mapInPandas(_search(k, False), _FOUND))
    nth = seeds.groupBy("dim", "query_block", "query_no").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    nth = nth.where(F.col("n") >= k).groupBy("dim", "query_block")  # at most a block's queries
    known = nth.agg(F.collect_list("query_no").alias("numbers"), F.collect_list("low").alias("lows"))

    def bounds(batch: pd.DataFrame) -> pd.DataFrame:
        least = []
        for ids, numbers, lows in zip(batch.query_ids, batch.numbers, batch.lows):
            own = np.full(len(ids) // 8, NONE)
            if numbers is not None:
                own[np.asarray(numbers, np.int64)] = lows
            least.append(own.tobytes())
        return batch.drop(columns=["numbers", "lows"]).assign(least=least)

    schema = "dim int, query_block long, query_ids binary, query_data binary, least binary"
    ready = materialize(queries.join(known, ["dim", "query_block"], "left").mapInPandas(per_batch(bounds), schema))
    rest = buckets.join(top, ["dim", "block"], "left_anti")
    found = seeds.unionByName(_pairs(rest, ready).mapInPandas(_search(k, True), _FOUND))
    by_query = Window.partitionBy("dim", "query_block", "query_no").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle(k: int = K, scale: int = SCALE, every: int = EVERY) -> str:
    """The same in DuckDB's SQL by all products."""
    return f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda v: floor(v::DOUBLE * {scale})) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS "rank", vec_id, score FROM scored)
SELECT query_id, "rank"::INTEGER AS "rank", vec_id, score FROM ranked WHERE "rank" <= {k}"""
