"""Exact vector operators: JVM-side folds for one query, numpy blocks for many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are broadcast at once.
QUERY_BLOCK = 4096


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x * x))


def normalise(v: Column) -> Column:
    """Unit length; vectors shorter than 1e-10 stay as they are."""
    n = l2_norm(v)
    return F.when(n > 1e-10, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def dot(v: Column, query: list[float]) -> Column:
    """Inner product with a literal vector, in index order."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(doubles(v), q, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def cosine_scores(vectors: DataFrame, query: list[float], embedding: str = "embedding", to: str = "score") -> DataFrame:
    """vectors with the cosine to a literal query; 0 if either is shorter than 1e-10."""
    q = np.asarray(query, np.float64)
    size = float(np.sqrt(np.add.accumulate(q * q)[-1])) if len(q) else 0.0
    n = l2_norm(F.col(embedding)) * F.lit(size)
    return vectors.withColumn(to, F.when(n > 1e-10, dot(F.col(embedding), q.tolist()) / n).otherwise(0.0))


def top_k(scored: DataFrame, k: int, score: str = "score", tie: str = "vec_id") -> DataFrame:
    """Plans as TakeOrderedAndProject: k rows a task reach the driver side, never a full sort."""
    return scored.orderBy(F.col(score).desc(), F.col(tie)).limit(k)


def vector_of(vectors: DataFrame, vec_id: int, id_col: str = "vec_id", embedding: str = "embedding") -> list[float] | None:
    row = vectors.where(F.col(id_col) == vec_id).select(embedding).first()
    return None if row is None else list(row[0])


def batch_top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest by cosine of every query, ties by vec_id.

    queries: query_id, embedding; vectors: vec_id, embedding. A block of queries is broadcast and meets each batch of vectors in one matrix
    product; a task keeps k candidates a query, so the shuffle carries tasks * queries * k rows, never queries * vectors. Scores are rounded to 9
    digits before ranking, so that summation order can't reorder ties.
    """
    spark = vectors.sparkSession
    ids = [r.query_id for r in queries.select("query_id").orderBy("query_id").toLocalIterator()] if queries.count() > block else None
    edges = [(ids[i], ids[min(i + block, len(ids)) - 1]) for i in range(0, len(ids), block)] if ids else [None]
    parts = []
    for edge in edges:
        rows = (queries if edge is None else queries.where(F.col("query_id").between(*edge))).select("query_id", "embedding").collect()
        if not rows:
            continue
        q = np.array([r.embedding for r in rows], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((np.array([r.query_id for r in rows], np.int64), q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            best_s, best_v = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    x = np.array(batch.column("embedding").to_pylist(), np.float64)
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                    s = np.round(q @ x.T, 9)
                    best_s = np.concatenate([best_s, s], 1)
                    best_v = np.concatenate([best_v, np.broadcast_to(batch.column("vec_id").to_numpy(), s.shape)], 1)
                    order = np.lexsort((best_v, -best_s), axis=1)[:, :k]
                    best_s, best_v = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_v, order, 1)
            if best_s.shape[1]:
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(q_ids, best_s.shape[1]), "vec_id": best_v.ravel(), "score": best_s.ravel()})

        parts.append(vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
