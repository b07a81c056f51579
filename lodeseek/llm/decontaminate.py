"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams is met by the token windows
of every document; hits are verified word by word, then spans or whole documents go."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, blocks, cut, free_name, words_of

WINDOW = 10
#: Windows that are broadcast at once (20 bytes each, and the block's vocabulary); a larger benchmark is met block by block. A longer item
#: is cut into pieces of PIECE words that overlap by a window less one word.
BLOCK_WINDOWS, PIECE = 400_000, 50_000


class WindowSet:
    """The windows of some benchmark items in flat arrays: all item words as numbers, and by window length the sorted hashes and the places of the windows."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int):
        self.vocab: dict[bytes, int] = {}
        self.names = [i for i, _ in items]
        number = self.vocab.setdefault
        rows = [np.fromiter((number(w, len(self.vocab) + 1) for w in words_of(t)), np.uint32) for _, t in items]
        self.ids = np.concatenate([*rows, np.zeros(0, np.uint32)])
        self.starts = np.cumsum([0, *map(len, rows)])
        self.factors = np.random.default_rng(7).integers(1, 2**63, n, np.uint64) | np.uint64(1)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {min(n, len(r)) for r in rows} - {0}:
            at = np.concatenate([np.arange(s, s + len(r) - size + 1) for s, r in zip(self.starts, rows, strict=False) if min(n, len(r)) == size]).astype(np.int32)
            value = self._hashed(self.ids, at, size)
            order = np.argsort(value, kind="stable")
            self.windows[size] = value[order], at[order]

    def _hashed(self, ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        value = np.zeros(len(at), np.uint64)
        for j in range(size):
            value += ids[at + j].astype(np.uint64) * self.factors[j]
        return value

    def find(self, words: list[bytes], mask: np.ndarray, items: set[str]) -> None:
        """Mark the words in any occurring window and add the items those windows are of; every hit is verified word by word."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint32, len(words))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, (hashes, places) in self.windows.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            value = self._hashed(ids, at, size)
            low, high = np.searchsorted(hashes, value), np.searchsorted(hashes, value, "right")
            done: dict[int, np.ndarray] = {}
            for k in np.flatnonzero(high > low).tolist():
                start, first = int(at[k]), int(low[k])
                if first not in done:
                    done[first] = places[first : int(high[k])]
                    met = (self.ids[done[first][:, None] + np.arange(size)] == ids[start : start + size]).all(1)
                    owners = np.unique(np.searchsorted(self.starts, done[first][met], "right") - 1)
                    items.update(self.names[o] for o in owners.tolist() if self.names[o] is not None)
                    if met.all():
                        mask[start : start + size] = True
                        continue
                if (self.ids[done[first][:, None] + np.arange(size)] == ids[start : start + size]).all(1).any():
                    mask[start : start + size] = True


def _runs(mask: np.ndarray) -> list[int]:
    """[start, end, start, end, ...] of the runs of True."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()


def _scan(docs: DataFrame, sets, text: str, hits: str, ids: str, size: str) -> DataFrame:
    """Add or widen the hit runs and items; one pass, no shuffle."""
    schema = T.StructType([*docs.schema.fields, T.StructField(size, T.LongType())])

    def run(batches):
        index = sets.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made = {hits: [], ids: [], size: []}
                old = zip(batch.column(hits).to_pylist(), batch.column(ids).to_pylist(), strict=True)
                for data, (runs, items) in zip(batch.column(text).cast(pa.binary()).to_pylist(), old, strict=True):
                    words = words_of(data)
                    mask, items = np.zeros(len(words), bool), set(items)
                    for s, e in zip(runs[::2], runs[1::2], strict=True):
                        mask[s:e] = True
                    index.find(words, mask, items)
                    made[hits].append(_runs(mask))
                    made[ids].append(sorted(items))
                    made[size].append(len(words))
                typed = {hits: pa.array(made[hits], pa.list_(pa.int32())), ids: pa.array(made[ids], pa.list_(pa.string())), size: pa.array(made[size], pa.int64())}
                names = [f.name for f in schema.fields]
                yield pa.RecordBatch.from_arrays([typed[c] if c in typed else batch.column(c) for c in names], names=names)

    return docs.mapInArrow(run, schema)


def _pieces(items: DataFrame, n: int, piece: int) -> DataFrame:
    """(i, t, windows): the words of each item, in pieces that hold each of its windows once; items without words are left out."""

    def run(batches):
        for batch in batches:
            out = {"i": [], "t": [], "windows": []}
            for i, t in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True):
                words = words_of(t)
                for at in range(0, max(len(words) - n, 0) + 1 if words else 0, piece):
                    part = words[at : at + piece + n - 1]
                    out["i"].append(i)
                    out["t"].append(b" ".join(part))
                    out["windows"].append(max(1, len(part) - n + 1))
            yield pa.RecordBatch.from_arrays([pa.array(out["i"], pa.string()), pa.array(out["t"], pa.binary()), pa.array(out["windows"], pa.int64())], names=["i", "t", "windows"])

    return items.mapInArrow(run, "i string, t binary, windows long")


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW, block_windows: int = BLOCK_WINDOWS, piece: int = PIECE) -> DataFrame:
    """docs with n_words, n_hit, hit_runs (word positions, [start, end, ...]) and hit_items (sorted ids) added.

    A window is n consecutive words of an item (all words of a shorter one); a document word inside an occurrence
    of a window is hit. Null or empty texts have no words and no windows; a null item id adds hits but no id;
    repeated items count once; an empty benchmark hits nothing; rows that repeat get the same; columns of docs are kept, whatever their
    names, but one that is named like an added column is replaced. The windows are counted first: what is broadcast at once is about
    block_windows of them, and further blocks are met one after another, each over a written copy of the rows.
    """
    added = {"n_words", "n_hit", "hit_runs", "hit_items"}
    keep = [c for c in docs.columns if c.lower() not in added]
    hits, ids, words = (free_name(docs, x) for x in ("at", "of", "size"))
    items = cut(_pieces(benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t")), n, min(piece, block_windows)), "items")
    count = blocks(items.agg(F.sum("windows")).first()[0] or 0, block_windows)
    state = docs.select(*keep, F.expr("cast(array() as array<int>)").alias(hits), F.expr("cast(array() as array<string>)").alias(ids))
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k) if count > 1 else items
        index = WindowSet([(r.i, bytes(r.t)) for r in part.select("i", "t").distinct().collect()], n)
        state = _scan(state.drop(words), docs.sparkSession.sparkContext.broadcast(index), text, hits, ids, words)
        state = cut(state, "decontaminate") if count > 1 else state
    n_hit = F.aggregate(F.transform(F.col(hits), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return state.select(*keep, F.col(words).alias("n_words"), n_hit.alias("n_hit"), F.col(hits).alias("hit_runs"), F.col(ids).alias("hit_items"))


def _without(text: bytes, runs: list[int]) -> bytes:
    """The text without the words of the runs and what stands between them."""
    at = [m.span() for m in WORD.finditer(text.lower())]
    out, end = [], 0
    for s, e in zip(runs[::2], runs[1::2], strict=True):
        out.append(text[end : at[s][0]])
        end = at[e - 1][1]
    return b"".join([*out, text[end:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text", most_hit: float = 0.0, **found) -> DataFrame:
    """docs, with the same columns, without what the benchmark hits.

    mode "documents": documents whose share of hit words exceeds most_hit go; null and empty texts stay. mode "spans": the hit runs are cut
    out of the text and every document stays, null texts and ids as they are. Columns named like those find_contamination adds are kept too.
    """
    names = docs.columns
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode}")
    # the columns travel under other names, so that none is replaced
    inner = {c: f"c{k}" for k, c in enumerate(names)}
    held = docs.select(*[F.col(c).alias(x) for c, x in inner.items()])
    marked = find_contamination(held, benchmark, text=inner[text], **found)
    back = [F.col(x).alias(c) for c, x in inner.items()]
    if mode == "documents":
        return marked.where(F.col("n_hit") <= F.lit(most_hit) * F.col("n_words")).select(*back)
    body, kept = inner[text], list(inner.values())

    def run(batches):
        for batch in batches:
            texts = batch.column(body).cast(pa.binary()).to_pylist()
            clean = [_without(t, r) if r else t for t, r in zip(texts, batch.column("hit_runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([None if c is None else c.decode() for c in clean], pa.string()) if c == body else batch.column(c) for c in kept], names=kept)

    return marked.select(*kept, "hit_runs").mapInArrow(run, held.schema).select(*back)


def op1(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
