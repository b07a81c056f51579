"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key over its quality weight; a source's documents, in key order, are taken
until the words reach the source's target. Complete epochs come first, the fraction that is left is sampled.
No source is ever sorted as a whole: sums of words over 1,024 parts of the keys' range (pre-aggregated) show in which part the budget
ends, that part is divided in the same way, and so on until it holds few documents; only these are sorted. What comes of
it is one key a source, up to which documents are taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fraction_of, small

WEIGHTS = (3, 1, 2)
SHARE, MOST_EPOCHS, SEED = 1.5, 2, "mix-1"
#: Units of a key (fixed point), least weight, parts of a range, and documents that may be sorted in one piece.
UNIT, LEAST, PARTS, EDGE = 2**44, 0.001, 1024, 20_000


def size_of(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of ink that isn't ASCII punctuation or a digit. Empty texts weigh 0.1."""
    ink = F.length(F.regexp_replace(text, r"[\x00-\x20]+", ""))
    odd = F.length(F.regexp_replace(text, r"[^\x21-\x40\x5B-\x60\x7B-\x7E]+", ""))
    return F.when(F.coalesce(ink, F.lit(0)) == 0, F.lit(0.1)).otherwise(F.greatest(F.lit(0.1), F.lit(1.0) - odd.cast("double") / ink.cast("double")))


def exponential_key(row_id: Column, weight: Column, seed: str = SEED) -> Column:
    """Efraimidis-Spirakis: -ln(u) / weight, in units of 2^-44."""
    u = fraction_of(row_id, seed)
    key = -F.ln(F.greatest(u, F.lit(2.0**-53))) / F.greatest(weight, F.lit(LEAST))
    return F.floor(key * F.lit(float(UNIT))).cast("long")


def _weighed(sizes: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """sizes with w, by the place of the source in code point order (null last), and cap. Places are counted in ranges of the order, never in one task."""
    order = [F.col("source").isNull(), F.col("source")]
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(sizes.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("part").agg(F.count("*").alias("n"))
    # a row a range goes through the second window
    before = before.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    return parts.join(F.broadcast(before), "part").select("source", "source_size", w.alias("w"), (F.col("source_size") * most).cast("double").alias("cap"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> with target: weights by the sources' order (code points, null last, repeating) share
    `share` of all words; no target exceeds `most` times its source, and the excess is shared again by weight.

    Each round sums what is full at the level so far and levels the rest, until no further source is full: two sums a round, no sort by capacity.
    """
    t = cut(_weighed(sizes, weights, most), "weighed")
    words, heavy = t.agg(F.sum("source_size"), F.sum("w")).first()
    total = float(words or 0) * share
    level, full = total / heavy if heavy else 0.0, -1
    while True:
        fits = F.col("cap") >= F.col("w") * F.lit(level)
        n, capped, free = t.agg(F.sum(F.when(fits, 0).otherwise(1)), F.sum(F.when(fits, 0.0).otherwise(F.col("cap"))), F.sum(F.when(fits, F.col("w")).otherwise(0.0))).first()
        if n is None or n == full or not free:
            break
        level, full = (total - capped) / free, n
    return t.select("source", "source_size", F.least(F.col("w") * F.lit(level), "cap").alias("target"))


def _key(source: str = "source") -> Column:
    """Sources as a join key that also holds null."""
    return F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source)))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: str = SEED, quality: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target (its source's), taken (words, repeats counted), copies, and the columns of carry.

    A document is taken whole, most times at most: the fractional epoch ends with the document whose middle the budget
    reaches, so a source ends within half a document of its target. Null texts have size 0 and are taken 0 words; null
    is a source of its own; equal keys are ordered by doc_id, then by text hash; rows equal in all three are taken alike.
    An empty table gives an empty result; a carried column named like one of the others is left out. The draw depends on doc_id, seed and weight
    alone: quality (quality_weight of the text by default; null or below 0.001 counts as 0.001).
    """
    weight = quality_weight(F.col(text)) if quality is None else F.coalesce(quality.cast("double"), F.lit(LEAST))
    made = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    carry = [c for c in carry if c.lower() not in made]
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _key(source).alias("k"), size_of(F.col(text)).alias("size"), exponential_key(F.col(doc_id), weight, seed).alias("key"), F.xxhash64(F.col(text)).alias("tie"), F.struct(*carry).alias("row") if carry else F.lit(None).cast("int").alias("row"))
    slim = cut(slim, "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = cut(plan.select(_key().alias("k"), "source_size", "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("rest")), "targets")
    n = plan.count()
    top = slim.agg(F.max("key")).first()[0]
    width = -(-((top or 0) + 1) // PARTS)
    edge = plan.where("rest > 0").select("k", "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("lo"))
    while True:
        here = F.floor((F.col("key") - F.col("lo")) / F.lit(width)).cast("long")
        inside = slim.select("k", "size", "key").join(small(edge, n), "k").where((F.col("key") >= F.col("lo")) & (here < PARTS))
        sums = inside.groupBy("k", "rest", "before", "lo", here.alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("k").orderBy("digit"))).where(F.col("upto") > F.col("rest"))
        ends = sums.groupBy("k", "rest").agg(F.min(F.struct("digit", (F.col("upto") - F.col("words")).alias("before"), (F.col("lo") + F.col("digit") * F.lit(width)).alias("lo"), "rows")).alias("m"))
        edge = cut(ends.select("k", "rest", "m.before", "m.lo", "m.rows"), "edge")
        most_rows = edge.agg(F.max("rows")).first()[0] or 0
        if width == 1 or most_rows <= EDGE:
            break
        edge, width = edge.drop("rows"), -(-width // PARTS)
    at_edge = slim.select("k", "doc_id", "size", "key", "tie").join(small(edge, n), "k").where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("lo") + F.lit(width)))
    order = ["key", "doc_id", "tie"]
    # rows that are equal here come to one: they are taken alike
    same = at_edge.groupBy("k", "rest", "before", *order).agg(F.sum("size").alias("words"))
    middle = F.col("before") + F.sum("words").over(Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words") / F.lit(2.0)
    last = same.withColumn("middle", middle).where("middle <= rest").groupBy("k").agg(F.max(F.struct(*order)).alias("last"))
    ends = cut(edge.select("k", "lo").join(last, "k", "left"), "ends")
    rows = slim.join(small(plan, n), "k").join(small(ends, n), "k", "left")
    inside = (F.col("rest") > 0) & ((F.col("key") < F.col("lo")) | (F.struct(*order) <= F.col("last")))
    copies = F.least(F.col("epochs") + F.when(inside, 1).otherwise(0), F.lit(most)).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), *[F.col("row")[c].alias(c) for c in carry])


def op5(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
