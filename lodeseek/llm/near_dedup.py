"""Near-dedup by Order MinHash with banded alignment.

A sketch samples, for each of several hash functions, the two smallest occurrence-labelled five-word k-mers of a document
and keeps them in text order, which makes collisions follow the edit similarity rather than the overlap of sets. Documents that
share a sketch entry are candidates; a candidate pair links if the banded alignment of their words gives
an edit similarity (1 - edits / longer length) of 0.8 or more.

In a short text few five-word k-mers outlive a fifth of the words being changed: texts under 128 words are sketched over three
words, under 20 over two. A length that can meet partners of the next shorter class has the entries of both.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, arrow_map, cut, forget, free_name, small, utf8, words_of
from .components import connected_components

K, SKETCHES, ELL, SIMILARITY = 5, 72, 2, 0.8
#: Words below which shorter k-mers are taken, and their length.
SHORTER = ((20, 2), (128, 3))
#: Partners of a pivot in one task; members of a chunk of a bucket, and their words; cells of a bag of words and of its coarse fold.
PARTNERS, BLOCK, BLOCK_WORDS, BAG, COARSE = 64, 2048, 800_000, 1024, 64
#: Rows of identifiers that are broadcast to the texts; more meet them in a shuffle.
NAMES = 400_000
#: Buckets met HOT times among a HOT-th of the documents get their pivot by a broadcast of at most MOST_HOT rows, the rest by a sort.
HOT, MOST_HOT = 64, 10_000
_RNG = np.random.default_rng(2019)
_MASKS = _RNG.integers(0, 2**63, SKETCHES, np.uint64)
_FACTORS = _RNG.integers(0, 2**63, SKETCHES, np.uint64) * np.uint64(2) + np.uint64(1)
_END = np.iinfo(np.uint64).max
_MIX = _RNG.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[14]
    x = (x ^ (x >> np.uint64(27))) * _MIX[15]
    return x ^ (x >> np.uint64(31))


def kmers(ids: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-word windows in text order; of a shorter text the one window there is."""
    k = min(k, len(ids))
    n = len(ids) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += ids[j : j + n] * _MIX[j]
    return _mixed(out)


def occurrence_labelled(grams: np.ndarray) -> np.ndarray:
    """Each k-mer with the number of its earlier occurrences mixed in, so that a repeat is another element."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))
    seen = np.empty(len(grams), np.uint64)
    seen[order] = (np.arange(len(ranked)) - start).astype(np.uint64)
    return _mixed(grams + seen * _MIX[13])


def kmer_lengths(n: int, least: float = SIMILARITY) -> list[int]:
    """The k that texts of n words are sketched with: that of every length a similar text, or the shorter of the two, may have."""
    of = lambda m: next((k for most, k in SHORTER if m < most), K)
    return sorted({of(n), of(int(np.ceil(least * n - 1e-9)))}, reverse=True)


def sketch(ids: np.ndarray, k: int = K) -> np.ndarray:
    """Order MinHash: per hash function one 64-bit entry over its ELL smallest labelled k-mers, in text order."""
    grams = kmers(ids, k)
    labelled = occurrence_labelled(grams)
    rows = np.arange(SKETCHES)[:, None]
    best_v = best_p = None
    for at in range(0, len(labelled), 8192):
        values = (labelled[None, at : at + 8192] ^ _MASKS[:, None]) * _FACTORS[:, None]
        for _ in range(ELL):  # a scan for each minimum: a sketch needs two, which is less than a partial sort
            near = values.argmin(1)[:, None]
            found = values[rows, near]
            place = np.where(found == _END, -1, near + at)
            best_v, best_p = (found, place) if best_v is None else (np.concatenate([best_v, found], 1), np.concatenate([best_p, place], 1))
            values[rows, near] = _END
        if best_v.shape[1] > ELL:
            keep = np.argsort(best_v, axis=1, kind="stable")[:, :ELL]
            best_v, best_p = best_v[rows, keep], best_p[rows, keep]
    places = np.sort(best_p, axis=1)
    out = np.arange(SKETCHES, dtype=np.uint64) * _MIX[12] + np.uint64(k)
    for j in range(ELL):
        out += np.where(places[:, j] >= 0, grams[np.maximum(places[:, j], 0)], np.uint64(j)) * _MIX[8 + j]
    return _mixed(out)


def entries_of(ids: np.ndarray) -> np.ndarray:
    """All sketch entries of a text, as signed integers."""
    return np.concatenate([sketch(ids, k) for k in kmer_lengths(len(ids))]).view(np.int64)


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences, or most + 1 if it is greater.

    The band of 2 * most + 1 diagonals is one machine integer that slides along the diagonal, a bit a cell
    (Hyyro's bit-parallel form of the banded alignment). Common ends are cut off first.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    i, j = len(a), len(b)
    while i > low and j > low and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
    a, b = a[low:i], b[low:j]
    if len(a) < len(b):
        a, b = b, a
    if not b or not most:
        return min(len(a), most + 1)
    band = min(most, len(a))
    top, full = 1 << (2 * band), (1 << (2 * band + 1)) - 1
    at: dict = {}
    for p, symbol in enumerate(a):
        at[symbol] = at.get(symbol, 0) | (1 << (p + band))
    # the window's top bit is row j + band of column j: it is followed down to the last row, then along that
    plus, minus, distance, row = full & ~((1 << band) - 1), 0, band, top >> 1
    for j, symbol in enumerate(b):
        match = (at.get(symbol, 0) >> j) & full
        same = ((((match & plus) + plus) ^ plus) | match | minus) & full
        over_plus, over_minus = minus | (full & ~(same | plus)), same & plus
        if j < len(a) - band:
            distance += not same & top
        else:
            distance += bool(over_plus & row) - bool(over_minus & row)
            row >>= 1
        below = same >> 1
        plus, minus = over_minus | (full & ~(below | over_plus)), below & over_plus
    return min(distance, most + 1)


def similar(a: list, b: list, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    return banded_distance(a, b, most) <= most


def _same(text: bytes | None, words: list[bytes]) -> str | None:
    """Names equal word sequences, or equal texts without words; null and empty texts have no name."""
    if words:
        return xxhash.xxh3_128_hexdigest(b" ".join(words))
    return "-" + xxhash.xxh3_128_hexdigest(text) if text else None


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, same, n, bands): the name of the word sequence, its length and its sketch entries."""

    def run(batches):
        hashes = WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                same, sizes, bands = [], [], []
                for text in utf8(batch.column("text")):
                    words = words_of(text)
                    sizes.append(len(words))
                    same.append(_same(text, words))
                    bands.append(entries_of(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))) if words else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(same, pa.string()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "same", "n", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, same string, n int, bands array<long>")


def _named(rows: DataFrame) -> tuple[DataFrame, str]:
    """rows with the name of their word sequence in a new column, and that column's name."""
    mark = free_name(rows, "same")

    def run(batches):
        for batch in batches:
            same = pa.array([_same(t, words_of(t)) for t in utf8(batch.column("text"))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, same], names=[*batch.schema.names, mark])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(mark, T.StringType())])), mark


def _worded(texts: DataFrame) -> DataFrame:
    """(doc, words, bands) of (doc, text): 32-bit word hashes, and the sketch entries."""

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) for words in map(words_of, utf8(batch.column("text")))]
            some = [i for i, ids in enumerate(rows) if len(ids)]
            return pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(some, pa.int64())), pa.array([rows[i].astype(np.uint32).tobytes() for i in some], pa.binary()), pa.array([entries_of(rows[i]) for i in some], pa.list_(pa.int64()))], names=["doc", "words", "bands"])

        return step

    return arrow_map(texts.select("doc", "text"), make, "doc long, words binary, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")


def _aligned(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(a, b, ok) of the distinct pairs (a, b): a pivot's partners are dealt to tasks in chunks, each with one copy of its text."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        pivot, partners = [], {}
        for is_pivot, doc, text in zip(block.is_pivot, block.doc, block.text, strict=True):
            words = words_of(text)
            if is_pivot:
                pivot.append(words)
            else:
                partners.setdefault(doc, []).append(words)
        ok = [any(similar(p, w, least) for p in pivot for w in texts) for texts in partners.values()]
        return pd.DataFrame({"a": np.full(len(ok), block.a.iloc[0] if len(block) else 0, np.int64), "b": np.array(list(partners), np.int64), "ok": np.array(ok, bool)})

    chunks = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).alias("chunks")).where("chunks > 1"), "chunks")
    dealt = pairs.join(small(chunks, chunks.count()), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("chunks", F.lit(1))).alias("chunk"))
    ends = dealt.select("a", "chunk", F.col("b").alias("doc"), F.lit(False).alias("is_pivot")).union(dealt.select("a", "chunk", F.col("a").alias("doc"), F.lit(True).alias("is_pivot")).distinct())
    # few ends go to the texts, many meet them in a shuffle
    ends = cut(ends, "ends")
    return small(ends, ends.count(), NAMES).join(_texts(docs).withColumn("text", F.col("text").cast("binary")), "doc").groupBy("a", "chunk").applyInPandas(run, "a long, b long, ok boolean")


def _excess(bags: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The larger of what each bag has above own and own above it: an edit changes either by one at most, capped or folded too."""
    diff = bags - own
    return np.maximum(np.maximum(diff, 0).sum(1), np.maximum(-diff, 0).sum(1))


def block_links(block: pd.DataFrame, least: float) -> list[tuple[int, int]]:
    """A forest of links that joins the components of a residual block (key, side, x, y, out, doc, comp, words, keys) as far as its pairs do.

    The block holds two chunks of a bucket, or one (x = y): pairs lie across them, or inside the one. At least one of a pair is out, not in the
    pivot's component. Pairs pass exact bounds first: the lengths' ratio, and the bags' distance, which is never above the edit distance,
    folded and then whole. What is left of a member is aligned nearest first, and only while both lie in different components. A pair of
    different components meets in every bucket it shares, since the pivot can't be in both; it is tested in the one of the smallest key."""
    words = [np.frombuffer(x, np.uint32) for x in block.words]
    doc, comp = block.doc.to_numpy(np.int64), block.comp.to_numpy(np.int64, copy=True)
    side, out, key = block.side.to_numpy(), block.out.to_numpy(bool), int(block.key.iloc[0])
    alone = bool(block.x.iloc[0] == block.y.iloc[0])
    n = np.array([len(w) for w in words])
    kind = np.int16 if n.max() < 2**15 else np.int32
    bag = np.empty((len(n), BAG), kind)
    for i, w in enumerate(words):
        bag[i] = np.bincount(w % np.uint32(BAG), minlength=BAG)
    fold = bag.reshape(len(bag), -1, COARSE).sum(1, dtype=kind)
    order = np.argsort(n, kind="stable")
    ranked = n[order]
    keys, lists, links = block["keys"].tolist(), {}, []
    listed = lambda i: lists[i] if i in lists else lists.setdefault(i, words[i].tolist())
    for i in range(len(n)) if alone else np.flatnonzero(side == 0).tolist():
        # lengths first: what is near in length is a run of the ranking
        at = order[np.searchsorted(ranked, int(least * n[i] - 1e-9)) : np.searchsorted(ranked, n[i] / least + 1, "right")]
        at = at[(comp[at] != comp[i]) & (out[at] | out[i]) & ((at > i) if alone else (side[at] == 1))]
        most = ((1 - least) * np.maximum(n[at], n[i]) + 1e-9).astype(np.int64)
        ok = np.abs(n[at] - n[i]) <= most
        at, most = at[ok], most[ok]
        ok = _excess(fold[at], fold[i]) <= most
        at, most = at[ok], most[ok]
        bound = _excess(bag[at], bag[i])
        ok = bound <= most
        at = at[ok][np.argsort((bound[ok] / np.maximum(most[ok], 1)), kind="stable")]
        for j in at.tolist():
            if comp[i] == comp[j]:
                continue
            shared = np.intersect1d(keys[i], keys[j])
            if len(shared) and shared[0] == key and similar(listed(i), listed(j), least):
                low, high = sorted((comp[i], comp[j]))
                comp[comp == high] = low
                links.append((int(doc[i]), int(doc[j])))
    return links


def _block(least: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        links = np.array(block_links(block, least), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    return run


def _stars(entries: DataFrame) -> DataFrame:
    """(key, pivot, pivot_n, rep, n) of every member of a bucket but its pivot, the smallest.

    One sort by key with a running first row gives the pivots. Keys that a sample of the documents shows to be very frequent are kept out of
    it: their smallest members are aggregated before a shuffle and broadcast back, so that no bucket lies in one task. Which
    way a bucket goes changes nothing in the result.
    """
    drawn = entries.where(F.pmod(F.xxhash64("rep"), F.lit(HOT)) == 0).groupBy("key").count().where(F.col("count") >= HOT)
    hot = cut(drawn.orderBy(F.col("count").desc(), "key").limit(MOST_HOT).select("key"), "hot")
    w = Window.partitionBy("key").orderBy("rep", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = entries.join(F.broadcast(hot), "key", "left_anti").select("key", F.first("rep").over(w).alias("pivot"), F.first("n").over(w).alias("pivot_n"), "rep", "n")
    often = entries.join(F.broadcast(hot), "key", "left_semi")
    least = often.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("p")).select("key", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pivot_n"))
    return plain.unionByName(often.join(F.broadcast(least), "key")).where("rep <> pivot")


def _joined(comps: DataFrame, found: DataFrame, comp_of) -> DataFrame:
    """(node, component) after further links (a, b), by the components of the links between components."""
    links = cut(comp_of(comp_of(found.select("a", "b"), "a", "x"), "b", "y").select("a", "b", "x", "y"), "links")
    if not links.limit(1).count():
        return comps
    over = connected_components(links, "x", "y").select(F.col("node").alias("component"), F.col("component").alias("root"))
    ends = links.select(F.col("a").alias("node"), F.col("x").alias("component")).union(links.select("b", "y"))
    nodes = comps.unionByName(ends).distinct()
    return cut(nodes.join(over, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of its class), kept (doc_id = class_id).

    Equal word sequences (A-Z lower-cased) are one class from the start, also texts without words that are equal; null and
    empty texts are classes of their own, rows with a null doc_id too (class_id null, kept). Rows that share a doc_id are one
    document. Other classes grow by links between candidates, which share one of SKETCHES entries.

    Candidates of a bucket are first aligned with its smallest document only, so a bucket of m copies costs m - 1
    alignments. Where that fails, the members left outside meet all members of other classes in the bucket, in blocks whose
    sizes are bounded; a block tests what exact bounds leave, the nearest pairs first, only while they lie in different classes, and gives
    the links that join classes, never its pairs: no candidate pair of different classes goes untested, and nothing is
    capped. An empty table gives an empty result; other columns are ignored.
    """
    return _classified(docs, doc_id, text, least).drop("same")


def _classified(docs: DataFrame, doc_id: str, text: str, least: float) -> DataFrame:
    """near_duplicates with same, the name of the row's word sequence."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    slim = cut(_sketched(base), "sketches")
    usable = slim.where("same IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(usable.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    star = cut(_stars(classes.where("bands IS NOT NULL").select("rep", "n", F.explode("bands").alias("key"))), "star")
    fits = F.abs(F.col("n") - F.col("pivot_n")) <= F.floor(F.lit(1 - least) * F.greatest("n", "pivot_n") + 1e-9)
    pairs = star.where(fits).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    comp_of = lambda df, c, to: df.join(comps.select(F.col("node").alias(c), F.col("component").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))

    # a first pivot each, so a group of m copies has m - 1 links; its other pivots matter only where that one failed
    first = cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    comps = connected_components(cut(_aligned(first, base, least).where("ok").select("a", "b"), "links"))
    apart = comp_of(comp_of(pairs.join(first, ["a", "b"], "left_anti"), "a", "comp_a"), "b", "comp_b").where("comp_a <> comp_b")
    comps = _joined(comps, _aligned(cut(apart.select("a", "b"), "apart"), base, least).where("ok"), comp_of)
    # every pair with a pivot is tested now: a bucket with a member outside the pivot's class matters if it has yet another member
    sided = comp_of(comp_of(star.select("key", "pivot", "rep", "n"), "pivot", "pivot_comp"), "rep", "comp").select("key", F.col("rep").alias("doc"), "n", "comp", (F.col("comp") != F.col("pivot_comp")).alias("out"))
    sided = cut(sided, "sided")
    chunks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_WORDS))).alias("chunks")
    there = sided.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("out").alias("some"), chunks)
    members = cut(sided.join(there.where("some AND m > 1 AND lo <> hi").select("key", "chunks"), "key").drop("n"), "members")
    if members.limit(1).count():
        # words are read for the members of these buckets alone; rows that share a doc_id bring theirs each
        of_doc = cut(members.groupBy("doc").agg(F.collect_set("key").alias("keys")), "keys")
        words = _worded(_texts(base).join(small(of_doc.select("doc"), of_doc.count(), NAMES), "doc", "left_semi"))
        words = words.join(of_doc, "doc").select("doc", "words", F.array_sort(F.array_intersect("keys", "bands")).alias("keys"))
        own = F.pmod(F.xxhash64("doc"), F.col("chunks"))
        steps = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
        at = F.transform(steps, lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y"), (own > o).cast("int").alias("side")))
        zero = F.lit(0).cast("long")
        places = members.where("chunks = 1").select("key", "doc", "comp", "out", zero.alias("x"), zero.alias("y"), F.lit(0).alias("side"))
        places = places.union(members.where("chunks > 1").select("key", "doc", "comp", "out", F.explode(at).alias("at")).select("key", "doc", "comp", "out", "at.x", "at.y", "at.side"))
        full = places.join(words, "doc").where(F.array_contains("keys", F.col("key")))
        # a fixed number of partitions: these few bytes take long, so they aren't to be packed together by size
        dealt = full.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "x", "y")
        found = cut(dealt.groupBy("key", "x", "y").applyInPandas(_block(least), "a long, b long").distinct(), "found")
        # 32 bits of a word decided so far; whole words decide in the end
        comps = _joined(comps, _aligned(found, base, least).where("ok"), comp_of)
    of = classes.select("same", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("component", "rep").alias("class_id"))
    alone = slim.where("same IS NULL OR doc_id IS NULL").select("doc_id", "same", F.col("doc_id").alias("class_id"))
    out = usable.select("doc_id", "same").join(of, "same").select("doc_id", "same", "class_id").union(alone)
    forget(star)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs, with the same columns, with one document of each class.

    Rows with a null doc_id stay. Of rows that share a kept doc_id, those equal in their word sequence count once (the one whose columns have the
    smallest hash stays), others stay beside each other. An empty table gives an empty result.
    """
    found = cut(_classified(docs, "doc_id", "text", least), "classified")
    gone = found.where("NOT kept").select("doc_id").distinct()
    again = cut(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    leave = cut(gone.union(again), "leave")
    single = docs.join(small(leave, leave.count(), 400_000), "doc_id", "left_anti")
    if not again.limit(1).count():
        return single.select(*docs.columns)
    rows, mark = _named(docs.join(small(again, again.count()), "doc_id", "left_semi").select(*docs.columns))
    w = Window.partitionBy("doc_id", mark).orderBy(F.xxhash64(*docs.columns), F.to_json(F.struct(*docs.columns)))
    nth = free_name(rows, "nth")
    return single.select(*docs.columns).unionByName(rows.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).select(*docs.columns))


def op9(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents)
