"""Embedding near-dedup over an inverted multi-index.

Two codebooks, fitted on the two halves of the vectors, span a product grid of cells. Every vector lives in one cell; the
multi-sequence traversal visits the other cells in the order of a lower bound of their distance, up to the
radius that a calibration found to hold the target recall for pairs at the threshold whose differences lie as those of
the vectors do; exact=True visits all cells that any pair can reach. What two cells share is verified exactly, in double
precision, block by block: a block returns sums of links and a spanning forest, never its pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fraction_of
from .components import connected_components

THRESHOLD, RECALL = 0.98, 0.9999
#: Distinct vectors the codebooks are fitted on, mean vectors a cell and label, and vectors on a side of a block.
SAMPLE, PER_CELL, BLOCK, MOST_CODES = 20_000, 64, 256, 1024
#: Vector lengths that get codebooks, the most frequent first; vectors of other lengths are one cell a label, compared in full.
MOST_LENGTHS = 64
#: What rounding may add to a squared bound.
SLACK = 1e-6


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _squares(x, centres).argmin(1)
        for j in range(k):
            mine = x[near == j]
            centres[j] = mine.mean(0) if len(mine) else x[rng.integers(len(x))]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


class MultiIndex:
    """Codebooks, and for unit vectors their home cell and the lower bounds of the distance to every code's cell."""

    def __init__(self, sample: np.ndarray, codes: int, threshold: float, recall: float, exact: bool = False, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2 if len(sample) else 0
        self.codes = max(1, min(codes, len(sample)))
        self.books = [_kmeans(part, self.codes, rng) for part in self._parts(sample)] if self.codes > 1 else []
        #: Beyond it no pair can be.
        self.radius2 = 2 - 2 * threshold + SLACK
        if self.books and not exact:
            self.radius2 = min(self.radius2, max(np.quantile(self._needed(x, y), recall) for x, y in self._pairs(sample, threshold, rng)) + SLACK)

    def _parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :]]

    def _pairs(self, sample: np.ndarray, threshold: float, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Unit vectors and partners at the threshold: off towards other vectors of the sample, towards their nearest one in it, along the
        differences of near ones, along a single axis, and in any direction. Real pairs differ along directions that the data has, which may be few."""
        x = sample[rng.choice(len(sample), 4 * len(sample) if len(sample) < 2500 else 10_000)]
        other = sample[rng.integers(0, len(sample), len(x))]
        near = np.empty_like(x)
        pool = sample[rng.permutation(len(sample))[:5000]]
        for at in range(0, len(x), 1000):
            d = _squares(x[at : at + 1000], pool)
            d[d < 1e-12] = np.inf
            near[at : at + 1000] = pool[d.argmin(1)]
        axis = np.eye(x.shape[1])[rng.integers(0, x.shape[1], len(x))]
        turn = rng.permutation(len(x))
        for to in (other, near, (near - x)[turn], axis, rng.standard_normal(x.shape)):
            away = to - (to * x).sum(1, keepdims=True) * x
            size = np.linalg.norm(away, axis=1, keepdims=True)
            some = size[:, 0] > 1e-9
            if some.any():
                yield x[some], threshold * x[some] + np.sqrt(1 - threshold**2) * away[some] / size[some]

    def _needed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Squared radius around each x that reaches the cell of its y."""
        need = np.zeros(len(x))
        for (_, bound), (home, _) in zip(self.bounds(x), self.bounds(y), strict=True):
            need += bound[np.arange(len(x)), home] ** 2
        return need

    def bounds(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: the nearest code, and a lower bound of the distance to each code's Voronoi cell
        (the distance to the plane between that code and the nearest one)."""
        out = []
        for part, book in zip(self._parts(x), self.books, strict=True):
            d = _squares(part, book)
            home = d.argmin(1)
            apart = np.sqrt(_squares(book, book))[home]
            with np.errstate(divide="ignore", invalid="ignore"):
                bound = (d - d.min(1, keepdims=True)) / (2 * apart)
            out.append((home, np.nan_to_num(np.maximum(bound, 0), posinf=0.0)))
        return out

    def visit(self, first: np.ndarray, second: np.ndarray) -> Iterator[int]:
        """Multi-sequence traversal: cells in ascending order of the summed squared bounds, up to the radius."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        p, q = (first[a] ** 2).tolist(), (second[b] ** 2).tolist()
        heap, seen = [(p[0] + q[0], 0, 0)], {(0, 0)}
        while heap and heap[0][0] <= self.radius2:
            _, i, j = heapq.heappop(heap)
            yield int(a[i]) * self.codes + int(b[j])
            for u, v in ((i + 1, j), (i, j + 1)):
                if u < len(p) and v < len(q) and (u, v) not in seen:
                    seen.add((u, v))
                    heapq.heappush(heap, (p[u] + q[v], u, v))

    def cells(self, x: np.ndarray) -> list[tuple[int, list[int]]]:
        """Home cell, and the visited cells of a greater number: so two cells meet once."""
        if not self.books:
            return [(0, [])] * len(x)
        (h1, b1), (h2, b2) = self.bounds(x)
        homes = (h1 * self.codes + h2).tolist()
        return [(home, [c for c in self.visit(b1[i], b2[i]) if c > home]) for i, home in enumerate(homes)]


def _rows(column) -> list[np.ndarray | None]:
    """Float vectors of an Arrow list column; None for null, zero, empty, or with a null or non-finite component."""
    out = []
    for v in column:
        if v.as_py() is None or v.values.null_count or not len(v.values):
            out.append(None)
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(x if np.isfinite(x).all() and x.any() else None)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _identify(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vkey, dims, vector): vkey names equal vectors, null if the vector can't link."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = _rows(batch.column("embedding"))
                data = [None if r is None else r.tobytes() for r in rows]
                keys = [None if d is None else xxhash.xxh3_128_hexdigest(d) for d in data]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.string()), pa.array([None if r is None else len(r) for r in rows], pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "label", "vkey", "dims", "vector"])

    return vectors.mapInArrow(run, "vec_id long, label string, vkey string, dims int, vector binary")


def _place(reps: DataFrame, index) -> DataFrame:
    """A home row and the probe rows of every distinct vector."""

    plain = MultiIndex(np.zeros((0, 0)), 1, 0.0, 1.0)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = [np.frombuffer(v) for v in batch.column("vector").to_pylist()]
                take, cell, probe = [], [], []
                for dims in {len(r) for r in rows}:
                    of = [i for i, r in enumerate(rows) if len(r) == dims]
                    fits = index.value.get(dims) or plain
                    for i, (home, visited) in zip(of, fits.cells(_unit(np.stack([rows[i] for i in of]))), strict=True):
                        take += [i] * (1 + len(visited))
                        cell += [home, *visited]
                        probe += [False] + [True] * len(visited)
                picked = batch.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(cell, pa.int64()), pa.array(probe, pa.bool_())], names=[*picked.schema.names, "cell", "probe"])

    return reps.mapInArrow(run, "rep long, label string, copies long, dims int, vector binary, cell long, probe boolean")


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix."""
    left, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], stack = False, [root]
        while stack:
            v = stack.pop()
            new = np.flatnonzero(linked[v] & left)
            left[new] = False
            edges += [(v, int(u)) for u in new]
            stack += new.tolist()
    return edges


def _verify(threshold: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack([np.frombuffer(v) for v in block.vector]))
        side, copies, ids = block.side.to_numpy(), block.copies.to_numpy(np.int64), block.rep.to_numpy(np.int64)
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        # side 2: both sides are one chunk, all pairs count; else pairs across the sides
        linked &= ((side[:, None] == 2) & (side[None] == 2)) | (side[:, None] != side[None])
        n = linked @ copies
        edges = _forest(linked)
        some = np.flatnonzero(n)
        return pd.DataFrame({"a": np.concatenate([ids[some], ids[[e[0] for e in edges]]]).astype(np.int64), "b": np.concatenate([np.zeros(len(some), np.int64), ids[[e[1] for e in edges]]]).astype(np.int64), "n": np.concatenate([n[some], np.zeros(len(edges), np.int64)]).astype(np.int64)})

    return run


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL, exact: bool = False, sample: int = SAMPLE, per_cell: int = PER_CELL, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null; null, zero or empty vectors and those with null or
    non-finite components link with nothing, nor do rows with a null vec_id. Equal vectors are one class: a class is compared
    once and its copies are counted. Rows that share a vec_id are one vertex: equal ones count once and don't link with each other, and
    one with several vectors counts once for each. Vectors of different length never link.
    Cells with many members are cut into chunks, so that a block holds about 2 * block vectors whatever the
    size of the cell. With exact=True no link is lost; otherwise the radius holds `recall` of the calibration's pairs at the
    threshold. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    marked = _identify(base.select("vec_id", "label", "embedding"))
    named = cut(marked, "vectors")
    usable = named.where("vkey IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    # rows that repeat count once; they are folded before the vectors themselves are
    ids = usable.groupBy("label", "vkey", "vec_id").agg(F.first("dims").alias("dims"), F.first("vector").alias("vector"))
    classes = ids.groupBy("label", "vkey").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("dims").alias("dims"), F.first("vector").alias("vector"))
    classes = cut(classes, "classes")
    shape = classes.groupBy("dims").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).orderBy(F.col("n").desc(), "dims").limit(MOST_LENGTHS).collect()
    fitted = {}
    for s in shape:
        of = classes.where(F.col("dims") == s.dims)
        if s.n > sample:
            of = of.where(fraction_of(F.col("rep"), "codes") < sample / s.n)
        drawn = of.select("rep", "vkey", "vector").limit(2 * sample).collect()
        drawn = _unit(np.stack([np.frombuffer(bytes(r.vector)) for r in sorted(drawn, key=lambda r: (r.rep, r.vkey))])) if drawn else np.zeros((0, s.dims))
        # at least two codes a half, so that every table goes through the index
        codes = max(2, min(MOST_CODES, int(np.sqrt(s.n / (per_cell * max(1, s.labels))))))
        fitted[s.dims] = MultiIndex(drawn, codes if s.dims > 1 else 1, threshold, recall, exact)
    placed = cut(_place(classes.select("rep", "label", "copies", "dims", "vector"), spark.sparkContext.broadcast(fitted)), "placed")
    counts = placed.groupBy("dims", "label", "cell").agg(F.ceil(F.sum(F.when(F.col("probe"), 0).otherwise(1)) / F.lit(block)).alias("homes"), F.ceil(F.sum(F.when(F.col("probe"), 1).otherwise(0)) / F.lit(block)).alias("probes"))
    rows = placed.join(counts.where("homes > 0"), ["dims", "label", "cell"])
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("probe"), F.col("probes")).otherwise(F.col("homes")))
    rows = rows.withColumn("chunk", mine)
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    key = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))
    # homes meet homes (chunk x <= chunk y) and probes meet homes (probe chunk x, home chunk y)
    within = F.transform(each(F.col("homes")), lambda o: key("hh", F.least(o, F.col("chunk")), F.greatest(o, F.col("chunk")), F.when(o == F.col("chunk"), 2).when(o > F.col("chunk"), 0).otherwise(1)))
    visited = F.when(F.col("probes") > 0, F.transform(each(F.greatest(F.col("probes"), F.lit(1))), lambda o: key("ph", o, F.col("chunk"), F.lit(1)))).otherwise(F.array().cast("array<struct<kind:string,x:bigint,y:bigint,side:int>>"))
    visits = F.transform(each(F.col("homes")), lambda o: key("ph", F.col("chunk"), o, F.lit(0)))
    dealt = rows.select("dims", "label", "cell", "rep", "copies", "vector", F.explode(F.when(F.col("probe"), visits).otherwise(F.concat(within, visited))).alias("k")).select("dims", "label", "cell", "k.kind", "k.x", "k.y", "k.side", "rep", "copies", "vector")
    # dealt by block, not by cell: the blocks of a large cell go to many tasks
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dims", "label", "cell", "kind", "x", "y")
    found = cut(dealt.groupBy("dims", "label", "cell", "kind", "x", "y").applyInPandas(_verify(threshold), "a long, b long, n long"), "links")
    links = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    edges = found.where("n = 0").select("a", "b")
    # a vec_id with several vectors is one vertex: their classes are joined
    again = cut(ids.groupBy("vec_id").count().where("count > 1").select("vec_id"), "again")
    if again.limit(1).count():
        reps = ids.join(again, "vec_id").select("vec_id", "label", "vkey").join(classes.select("label", "vkey", "rep"), ["label", "vkey"])
        edges = edges.union(reps.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    comps = connected_components(edges)
    of = classes.select("label", "vkey", "rep", "copies").join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    # a class's smallest vec_id is the smallest of its component's, but for the vertices that several classes share
    of = of.select("label", "vkey", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    alone = named.where("vkey IS NULL OR label IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = usable.select("vec_id", "label", "vkey").join(of, ["label", "vkey"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    return out.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2(embeddings: DataFrame) -> DataFrame:
    return link_vectors(embeddings)
