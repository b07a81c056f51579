"""Vector compression: 4-bit recursive polar codes and a 1-bit random projection of the residual, in numpy batches.

float32 is kept where vectors are stored and float64 where they are computed with.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packing import pack_rows, unpack_rows

BINS, SEED, PROJECTIONS, TINY = 16, 42, 64, 1e-10
_WIDTH = 2 * np.pi / BINS
_CENTRES = (np.arange(BINS) + 0.5) * _WIDTH
SCHEMA = "vec_id long, final_radius double, pq_angles binary, qjl_bits binary, pq_dimensions int, qjl_projected_dimensions int"


def level_sizes(d: int) -> list[int]:
    """Codes of each level of the recursion."""
    out = []
    while d > 1:
        d = -(-d // 2)
        out.append(d)
    return out


def num_angles(d: int) -> int:
    return sum(level_sizes(d))


def angle_codes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.mod(np.arctan2(y, x), 2 * np.pi) / _WIDTH), BINS - 1).astype(np.uint8)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    n = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    return np.where(n > TINY, x / np.where(n > TINY, n, 1), x).astype(np.float32)


def polar_encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, d) -> final radii and (rows, num_angles) codes. An odd tail keeps its size, its sign as code 0 or 8."""
    if not x.shape[1]:
        raise ValueError("an empty vector has no polar form")
    now, codes = x.astype(np.float32), []
    while now.shape[1] > 1:
        even, odd = now[:, ::2].astype(np.float64), now[:, 1::2].astype(np.float64)
        n = odd.shape[1]
        level = np.where(even >= 0, 0, BINS // 2).astype(np.uint8)
        level[:, :n] = angle_codes(even[:, :n], odd)
        radii = np.abs(even)
        radii[:, :n] = np.sqrt(even[:, :n] ** 2 + odd**2)
        codes.append(level)
        now = radii.astype(np.float32)
    return now[:, 0].astype(np.float64), np.concatenate(codes, 1) if codes else np.zeros((len(x), 0), np.uint8)


def polar_decode(radius: np.ndarray, codes: np.ndarray, d: int) -> np.ndarray:
    now, end = radius.astype(np.float32)[:, None], codes.shape[1]
    sizes = [d, *level_sizes(d)]
    for size, n in zip(sizes[-2::-1], sizes[:0:-1], strict=True):
        of = codes[:, end - n : end]
        end -= n
        wide = np.empty((len(now), 2 * n))
        wide[:, ::2], wide[:, 1::2] = now * np.cos(_CENTRES)[of], now * np.sin(_CENTRES)[of]
        now = wide[:, :size].astype(np.float32)
    return now


def _signed(x: int) -> int:
    return (x & 0xFFFFFFFF) - ((x & 0x80000000) << 1)


class Generator:
    """32-bit xorshift with two words of state, as the compressed format defines it. The two seed masks, and the shifts 23, 17 and 26."""

    def __init__(self, seed: int = SEED):
        self.a, self.b = _signed(seed ^ 0xDEADBEEF), _signed(seed ^ 0xC0FFEE42)
        for _ in range(20):
            self._step()

    def _step(self) -> None:
        mixed = _signed(self.a ^ (self.a << 23))
        self.a, self.b = self.b, _signed(mixed ^ self.b ^ ((mixed & 0xFFFFFFFF) >> 17) ^ ((self.b & 0xFFFFFFFF) >> 26))

    def uint32(self) -> int:
        self._step()
        return (self.a + self.b) & 0xFFFFFFFF

    def normal(self) -> float:
        """Box-Muller, cosine branch."""
        u = (self.uint32() + 1) / 4294967297
        v = self.uint32() / 4294967296
        return float(np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v))


@cache
def projection(m: int, d: int) -> np.ndarray:
    g, scale = Generator(), 1 / np.sqrt(d)
    return np.array([g.normal() * scale for _ in range(m * d)], np.float32).reshape(m, d)


def encode_rows(x: np.ndarray, m: int = PROJECTIONS) -> dict[str, np.ndarray]:
    x = unit_rows(x)
    radius, codes = polar_encode(x)
    residual = (x - polar_decode(radius, codes, x.shape[1])).astype(np.float32)
    signs = residual.astype(np.float64) @ projection(m, x.shape[1]).astype(np.float64).T >= 0
    return {"final_radius": radius, "pq_angles": pack_rows(codes, 4), "qjl_bits": np.packbits(signs, axis=1)}


def similarity_rows(query: np.ndarray, radius: np.ndarray, angles: np.ndarray, bits: np.ndarray, m: int, correction: bool = True) -> np.ndarray:
    """Approximate cosines of one query with compressed rows; 0 where the radius is tiny. The query is projected once."""
    q = unit_rows(query[None])[0].astype(np.float64)
    d = len(q)
    out = polar_decode(radius, unpack_rows(angles, num_angles(d), 4), d).astype(np.float64) @ q
    if correction and m:
        signs = np.unpackbits(bits, axis=1)[:, :m].astype(np.float64) * 2 - 1
        out = out + signs @ (projection(m, d).astype(np.float64) @ q) / np.sqrt(m)
    return np.where(radius < TINY, 0.0, out / np.where(radius < TINY, 1, radius))


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def compress(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", m: int = PROJECTIONS, id_type: str = "long") -> DataFrame:
    """One Arrow pass: id, final_radius, pq_angles, qjl_bits and the dimensions. Null and empty vectors are left out."""
    schema = SCHEMA.replace("vec_id long", f"`{id_col}` {id_type}")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = batch.column("v").to_pylist()
                for d in sorted({len(r) for r in rows}):
                    of = [i for i, r in enumerate(rows) if len(r) == d]
                    made = encode_rows(np.array([rows[i] for i in of], np.float32), m)
                    yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(of, pa.int64())), pa.array(made["final_radius"]), _bytes(made["pq_angles"]), _bytes(made["qjl_bits"]), pa.array(np.full(len(of), d, np.int32)), pa.array(np.full(len(of), m, np.int32))], names=[id_col, "final_radius", "pq_angles", "qjl_bits", "pq_dimensions", "qjl_projected_dimensions"])

    base = vectors.where(F.size(embedding) > 0).select(F.col(id_col).cast(id_type).alias("i"), F.col(embedding).cast("array<float>").alias("v"))
    return base.mapInArrow(run, schema)


def decompress(compressed: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(id, embedding) of the polar stage."""

    def run(batches):
        for batch in batches:
            dims = batch.column("pq_dimensions").to_numpy(zero_copy_only=False)
            radius, packed = batch.column("final_radius").to_numpy(zero_copy_only=False), batch.column("pq_angles").to_pylist()
            for d in np.unique(dims).tolist():  # vectors of a length are decoded together
                of = np.flatnonzero(dims == d)
                codes = unpack_rows(np.stack([np.frombuffer(packed[i], np.uint8) for i in of]), num_angles(d), 4)
                rows = polar_decode(radius[of], codes, d)
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel(), pa.float32()), d).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(of)), vectors], names=[id_col, "embedding"])

    kind = dict(compressed.dtypes)[id_col]
    return compressed.select(F.col(id_col).alias("i"), "final_radius", "pq_angles", "pq_dimensions").mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")


def score_compressed(compressed: DataFrame, query: list[float], to: str = "score", correction: bool = True) -> DataFrame:
    """compressed with the approximate cosine; rows of other dimensions than the query are left out."""
    q = np.asarray(query, np.float32)

    @F.pandas_udf("double")
    def run(radius, angles, bits, m):  # noqa: ANN001, ANN202
        import pandas as pd

        if not len(radius):
            return pd.Series([], dtype=float)
        out = pd.Series(0.0, index=radius.index)
        for n in m.unique():
            of = (m == n).to_numpy()
            stack = lambda col, of=of: np.stack([np.frombuffer(x, np.uint8) for x in col[of]])
            out[of] = similarity_rows(q, radius[of].to_numpy(), stack(angles), stack(bits), int(n), correction)
        return out

    rows = compressed.where(F.col("pq_dimensions") == len(q))
    return rows.withColumn(to, run("final_radius", "pq_angles", "qjl_bits", "qjl_projected_dimensions"))


def storage_stats(compressed: DataFrame) -> DataFrame:
    """total_vectors, storage_bytes and the ratio to float32 vectors of the true dimensions."""
    per = F.octet_length("pq_angles") + F.octet_length("qjl_bits") + 8
    ratio = F.sum(F.col("pq_dimensions") * 4) / F.sum(per)
    return compressed.agg(F.count("*").alias("total_vectors"), F.coalesce(F.sum(per), F.lit(0)).cast("long").alias("storage_bytes"), F.when(ratio.isNotNull(), F.format_string("%.1f:1", ratio)).otherwise("N/A").alias("compression_ratio"))
