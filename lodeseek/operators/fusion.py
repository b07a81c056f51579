"""Reciprocal rank fusion and joins of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RRF_K = 60


def rrf_fuse(keyword: DataFrame, semantic: DataFrame, k: int, key: str = "id") -> DataFrame:
    """(key, rrf): the k best by the sum of 1 / (60 + rank) over both lists (ranks from 1); ties go to what came first, keyword hits before semantic ones.

    A repeated key counts once a list, at its best rank.
    """
    best = lambda df, offset: df.groupBy(key).agg(F.min("rank").alias("rank")).select(key, (F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))).alias("rr"), (F.col("rank") + offset).alias("seq"))
    both = best(keyword, 0).unionByName(best(semantic, 1_000_000_000))
    fused = both.groupBy(key).agg(F.sum("rr").alias("rrf"), F.min("seq").alias("seq"))
    return fused.orderBy(F.col("rrf").desc(), "seq").limit(k)


def enrich(ranked: DataFrame, entities: DataFrame, key: str = "id") -> DataFrame:
    """Inner join of a short ranked list to the entities; ids without an entity are dropped. The list has a limit, so it is the broadcast side."""
    return F.broadcast(ranked).join(entities, key)
