"""Embedding providers: none, a table of vectors, or a deterministic hashing embedder (not a language model)."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stemming import tokens

#: Characters of a text that are embedded.
MOST_CHARS = 512


class EmbeddingProvider(Protocol):
    def is_ready(self) -> bool: ...

    def embed(self, text: str) -> list[float] | None: ...

    def embed_column(self, df: DataFrame, text: str, to: str) -> DataFrame: ...


def hashed(text: str | None, dims: int) -> np.ndarray | None:
    """Signed feature hashing of stemmed words, unit length; None without words."""
    out = np.zeros(dims)
    for word in tokens((text or "")[:MOST_CHARS]):
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        out[h % dims] += 1 if h >> 40 & 1 else -1
    norm = np.linalg.norm(out)
    return (out / norm).astype(np.float32) if norm > 1e-10 else None


class HashingProvider:
    """Loads nothing and is always ready; vectors of equal words are equal."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def is_ready(self) -> bool:
        return True

    def embed(self, text: str) -> list[float] | None:
        v = hashed(text, self.dims)
        return None if v is None else v.tolist()

    def embed_column(self, df: DataFrame, text: str, to: str) -> DataFrame:
        dims = self.dims

        @F.pandas_udf("array<float>")
        def run(x: pd.Series) -> pd.Series:
            return x.map(lambda t: hashed(t, dims))

        return df.withColumn(to, run(F.col(text)))

    def status(self) -> dict:
        return {"state": "ready", "model_id": f"hashing-{self.dims}", "dimensions": self.dims}


class VectorTableProvider:
    """Vectors from a table (text, embedding): texts that it lacks, and null texts, have none. Of repeated texts the first vector by value counts."""

    def __init__(self, table: DataFrame, text: str = "text", embedding: str = "embedding", model_id: str = "table"):
        self.table = table.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("__text")).agg(F.min(F.col(embedding).cast("array<float>")).alias("__vector"))
        self.model_id = model_id

    def is_ready(self) -> bool:
        return True

    def embed(self, text: str) -> list[float] | None:
        found = self.table.where(F.col("__text") == text).first()
        return None if found is None or found[1] is None else list(found[1])

    def embed_column(self, df: DataFrame, text: str, to: str) -> DataFrame:
        return df.join(self.table, F.col(text) == F.col("__text"), "left").withColumn(to, F.col("__vector")).drop("__text", "__vector")

    def status(self) -> dict:
        first = self.table.select(F.size("__vector")).first()
        return {"state": "ready", "model_id": self.model_id, "dimensions": first[0] if first else 0}


class NoProvider:
    """Keyword search only."""

    def is_ready(self) -> bool:
        return False

    def embed(self, text: str) -> None:
        return None

    def embed_column(self, df: DataFrame, text: str, to: str) -> DataFrame:
        return df.withColumn(to, F.lit(None).cast("array<float>"))

    def status(self) -> dict:
        return {"state": "unloaded", "model_id": None, "dimensions": 0}
