"""Keyword retrieval: BM25 over phrases with a prefix at their end, trigram substrings, and the fallback between them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stemming import tokens as stem_tokens
from ..functions.text import word_tokens

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
FALLBACK_BELOW, TRIGRAM_SHARE = 3, 0.8


def query_terms(query: str) -> list[str]:
    """camelCase split, then whitespace: each term is a prefix phrase, and any of them may match."""
    return re.sub("([a-z])([A-Z])", r"\1 \2", query).split()


def phrases(query: str, stemmed: bool = False) -> list[list[str]]:
    """Token phrases of a query; terms without letters or digits match nothing and are left out."""
    cut = stem_tokens if stemmed else (lambda t: re.findall(r"[^\W_]+", t.lower()))
    return [p for p in (cut(t) for t in query_terms(query)) if p]


def phrase_count(tokens: Column, phrase: list[str], prefix: bool = True) -> Column:
    """Occurrences of a phrase in a token array; with prefix its last token need only begin the word."""
    hit = lambda x, word, last: F.startswith(x, F.lit(word)) if last and prefix else x == F.lit(word)
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda x: hit(x, phrase[0], True)))
    # the array shifted against itself: it is evaluated outside the lambda, once a shift, not once a word
    shifted = F.arrays_zip(*[F.slice(tokens, j + 1, F.greatest(F.size(tokens) - j, F.lit(0))).alias(f"w{j}") for j in range(len(phrase))])
    match = lambda x: reduce(lambda a, b: a & b, [hit(x[f"w{j}"], w, j == len(phrase) - 1) for j, w in enumerate(phrase)])
    return F.size(F.filter(shifted, lambda x: F.coalesce(match(x), F.lit(False))))


def bm25(docs: DataFrame, token_columns: list[str], query_phrases: list[list[str]], prefix: bool = True, to: str = "score") -> DataFrame:
    """Rows of docs that match any phrase, with their BM25 score.

    A phrase stays inside a column, but lengths and frequencies are summed over all columns. Per phrase
    idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)), idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6. Term
    frequencies are counted in the scan; corpus statistics are one aggregate row, broadcast back.
    """
    if not query_phrases:
        return docs.withColumn(to, F.lit(0.0)).where(F.lit(False))
    tf = [reduce(lambda a, b: a + b, [phrase_count(F.col(c), p, prefix) for c in token_columns]) for p in query_phrases]
    length = reduce(lambda a, b: a + b, [F.size(c) for c in token_columns])
    counted = docs.select(*docs.columns, length.alias("__len"), *[x.alias(f"__tf{i}") for i, x in enumerate(tf)])
    stats = counted.agg(F.count("*").cast("double").alias("__n"), F.avg("__len").alias("__mean"), *[F.sum(F.when(F.col(f"__tf{i}") > 0, 1).otherwise(0)).cast("double").alias(f"__df{i}") for i in range(len(tf))])
    joined = counted.crossJoin(F.broadcast(stats)).where(reduce(lambda a, b: a | b, [F.col(f"__tf{i}") > 0 for i in range(len(tf))]))
    return joined.withColumn(to, _score(len(tf))).select(*docs.columns, to)


def _score(n_phrases: int) -> Column:
    """The sum over phrases, from columns __tf0.., __df0.., __len, __n and __mean."""
    total = F.lit(0.0)
    for i in range(n_phrases):
        f, n = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.ln((F.col("__n") - n + 0.5) / (n + 0.5))
        total = total + F.when(idf <= 0, IDF_FLOOR).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__len") / F.col("__mean")))
    return total


def occurrences(docs: DataFrame, token_columns: list[str], keep: list[str], length: str = "length") -> DataFrame:
    """The search index: one row (term, pos, *keep) a word. Between columns a position stays empty, so that no phrase runs over their border."""
    gap = F.array(F.lit(None).cast("string"))
    spaced = F.concat(*[x for c in token_columns for x in (F.coalesce(F.col(c), F.array().cast("array<string>")), gap)])
    return docs.select(*keep, length, F.posexplode(spaced).alias("pos", "term")).where("term IS NOT NULL")


def bm25_indexed(postings: DataFrame, stats: DataFrame, query_phrases: list[list[str]], keys: list[str], length: str = "length", to: str = "score") -> DataFrame:
    """(*keys, score) as bm25 gives it, from `occurrences` and (docs, words) totals: only the rows of the query's terms are read.

    A word filter is an equality or a prefix on `term`, so it reaches the scan, and files sorted by term skip all other row groups. A
    phrase occurs where all its words give the same start. Hot terms are no hot keys: rows are dealt by document.
    """
    if not query_phrases:
        return postings.select(*keys, F.lit(0.0).alias(to)).where(F.lit(False))
    hit = lambda p, j: F.startswith(F.col("term"), F.lit(p[j])) if j == len(p) - 1 else F.col("term") == F.lit(p[j])
    words = [hit(p, j) for p in query_phrases for j in range(len(p))]
    rows = postings.where(reduce(lambda a, b: a | b, words))
    group = [*keys, length]
    if all(len(p) == 1 for p in query_phrases):
        found, of = rows, [hit(p, 0) for p in query_phrases]
    else:
        places = F.array(*[F.when(hit(p, j), F.struct(F.lit(i).alias("i"), (F.col("pos") - j).alias("start"))) for i, p in enumerate(query_phrases) for j in range(len(p))])
        found = rows.repartition(*keys).select(*group, F.explode(F.filter(places, lambda x: x.isNotNull())).alias("x")).select(*group, "x.i", "x.start")
        found = found.groupBy(*group, "i", "start").agg(F.count("*").alias("w"))
        found = found.where(F.col("w") == F.element_at(F.array(*[F.lit(len(p)) for p in query_phrases]), F.col("i") + 1))
        of = [F.col("i") == i for i in range(len(query_phrases))]
    counted = found.groupBy(*group).agg(*[F.count(F.when(x, 1)).alias(f"__tf{i}") for i, x in enumerate(of)]).withColumnRenamed(length, "__len")
    df = counted.agg(*[F.count(F.when(F.col(f"__tf{i}") > 0, 1)).cast("double").alias(f"__df{i}") for i in range(len(of))])
    total = stats.agg(F.sum("docs").cast("double").alias("__n"), (F.sum("words") / F.sum("docs")).alias("__mean"))
    return counted.crossJoin(F.broadcast(df)).crossJoin(F.broadcast(total)).select(*keys, _score(len(of)).alias(to))


def overlapping_count(x: Column, needle: str) -> Column:
    """Occurrences of a literal, overlapping ones too."""
    n = len(needle)
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: x.substr(i, F.lit(n)) == F.lit(needle)))


def trigram_search(docs: DataFrame, columns: list[str], query: str, to: str = "score") -> DataFrame:
    """Rows that hold the trimmed query as a substring of a column, ignoring case, scored by BM25 over trigrams. Queries under 3 characters match nothing."""
    needle = query.strip().lower()
    if len(needle) < 3:
        return docs.withColumn(to, F.lit(0.0)).where(F.lit(False))
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    # the substring test comes first: positions are only counted where there is one
    tf = reduce(lambda a, b: a + b, [F.when(F.contains(x, F.lit(needle)), overlapping_count(x, needle)).otherwise(0) for x in low])
    length = reduce(lambda a, b: a + b, [F.greatest(F.length(x) - 2, F.lit(0)) for x in low])
    counted = docs.select(*docs.columns, tf.alias("__tf"), length.alias("__len"))
    stats = counted.agg(F.count("*").cast("double").alias("__n"), F.avg("__len").alias("__mean"), F.sum(F.when(F.col("__tf") > 0, 1).otherwise(0)).cast("double").alias("__df"))
    idf = F.ln((F.col("__n") - F.col("__df") + 0.5) / (F.col("__df") + 0.5))
    score = F.when(idf <= 0, IDF_FLOOR).otherwise(idf) * F.col("__tf") * (K1 + 1) / (F.col("__tf") + K1 * (1 - B + B * F.col("__len") / F.col("__mean")))
    return counted.crossJoin(F.broadcast(stats)).where("__tf > 0").withColumn(to, score).select(*docs.columns, to)


def with_fallback(fts: DataFrame, trigram: DataFrame, key: str, limit: int, fuzzy: bool = False, score: str = "score") -> DataFrame:
    """Full-text hits, and if they are fewer than 3 or fuzzy is set also trigram hits at 0.8 of their score that aren't among them; the best `limit`.

    Adds source (fts5, trigram) and strategy. One job: the count is a broadcast scalar that gates the trigram side.
    """
    n = fts.agg(F.count("*").alias("__hits"))
    opened = F.lit(fuzzy) | (F.col("__hits") < FALLBACK_BELOW)
    extra = trigram.join(fts.select(key), key, "left_anti").crossJoin(F.broadcast(n)).where(opened).drop("__hits").withColumn(score, F.col(score) * TRIGRAM_SHARE)
    both = fts.withColumn("source", F.lit("fts5")).unionByName(extra.withColumn("source", F.lit("trigram")))
    label = F.when(~opened, "fts5").when(F.col("__hits") > 0, "fts5+trigram").otherwise("trigram")
    return both.orderBy(F.col(score).desc(), F.col("source"), F.col(key)).limit(limit).crossJoin(F.broadcast(n)).withColumn("strategy", label).drop("__hits")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted index: (term, key, positions), positions from 0. Partition or bucket it by term to keep it."""
    return docs.select(key, F.posexplode(word_tokens(F.col(text))).alias("pos", "term")).groupBy("term", key).agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def document_frequency(docs: DataFrame, text: str) -> DataFrame:
    """(term, df). Words are made distinct inside each document first, so the aggregate is one map-side combined count."""
    return docs.select(F.explode(F.array_distinct(word_tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def ranked(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with rank from 1: the limit runs before the single-partition numbering."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))

