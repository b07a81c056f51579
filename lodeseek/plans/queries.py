"""Registered queries of the retrieval operators, each beside the DuckDB SQL that gives the same rows (None where SQL can't)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.durable import cut, shared_dir
from ..functions.embedding import HashingProvider
from ..functions.stemming import stemmed_tokens
from ..operators import fusion, keyword, quantiser, store, structure, vectors
from ..sources import code, files, markdown
from . import quantiser_sql, stemming_sql
from .engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
QUERY_TEXT, QUERY_WORDS, PHRASE = "the", "tion est", "de la"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# vectors

_COS = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) / sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))"
_SCORED = f"SELECT e.vec_id, e.label, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.cosine_scores(e, vectors.vector_of(e, 0)).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vec_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.l2_norm(F.col("embedding")), 6).alias("norm"))


@query(_SCORED)
def vec_normalize_dot(spark, d):
    e = table(spark, d, "embeddings")
    q = vectors.vector_of(e, 0)
    size = sum(x * x for x in q) ** 0.5
    return e.select("vec_id", "label", F.round(vectors.dot(vectors.normalise(F.col("embedding")), [x / size for x in q]), 6).alias("score"))


@query(f"{_SCORED} ORDER BY score DESC, vec_id LIMIT 10")
def vec_topk_exact(spark, d):
    return vectors.top_k(_scored(spark, d), 10)


@query(f"SELECT vec_id, label, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM ({_SCORED}) QUALIFY rank <= 3")
def vec_topk_by_label(spark, d):
    w = Window.partitionBy("label").orderBy(F.col("score").desc(), "vec_id")
    return _scored(spark, d).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3")


@query(f"SELECT * FROM ({_SCORED}) WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10")
def vec_exclude_self(spark, d):
    return vectors.top_k(_scored(spark, d).where("vec_id <> 0"), 10)


@query(f"SELECT * FROM (SELECT * FROM ({_SCORED}) ORDER BY score DESC, vec_id LIMIT 10) WHERE score > 0.5")
def vec_threshold_after_topk(spark, d):
    return vectors.top_k(_scored(spark, d), 10).where("score > 0.5")


@query(f"""SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (
SELECT q.vec_id AS query_id, e.vec_id, round({_COS.format(a="e.embedding", b="q.embedding")}, 9) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS rank
FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 QUALIFY rank <= 10)""")
def vec_batch_topk(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.batch_top_k(queries, e, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT vec_id, CAST(i AS BIGINT) AS pair, CAST(least(floor((CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END) / (pi() / 8)), 15) AS BIGINT) AS code
FROM (SELECT vec_id, i, atan2(CAST(embedding[2 * i + 2] AS DOUBLE), CAST(embedding[2 * i + 1] AS DOUBLE)) AS t FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 2)) AS i FROM embeddings))""")
def polar_level0_codes(spark, d):
    # the first level has a code of four bits, a hexadecimal digit, for every two components
    e = quantiser.compress(table(spark, d, "embeddings")).select("vec_id", F.hex("pq_angles").alias("digits"), "pq_dimensions")
    e = e.select("vec_id", "digits", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("pq_dimensions") / 2) - 1)).alias("pair"))
    return e.select("vec_id", "pair", F.conv(F.expr("substring(digits, cast(pair as int) + 1, 1)"), 16, 10).cast("long").alias("code"))


@query("""SELECT count(*) AS total_vectors, CAST(sum(b) AS BIGINT) AS storage_bytes, printf('%.1f:1', sum(len(embedding) * 4) / sum(b)) AS compression_ratio
FROM (SELECT embedding, list_sum([len(embedding) // 2 // (1 << k) FOR k IN range(0, 6)]) // 2 + 1 + 8 + 8 AS b FROM embeddings)""")
def quant_storage_stats(spark, d):
    return quantiser.storage_stats(quantiser.compress(table(spark, d, "embeddings")))


@query(quantiser_sql.ROUNDTRIP)
def quant_roundtrip(spark, d):
    e = table(spark, d, "embeddings")
    back = quantiser.decompress(quantiser.compress(e)).withColumnRenamed("embedding", "decoded")
    both = e.join(back, "vec_id")
    cos = F.aggregate(F.zip_with(vectors.doubles(F.col("embedding")), vectors.doubles(F.col("decoded")), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / vectors.l2_norm(F.col("embedding")) / vectors.l2_norm(F.col("decoded"))
    return both.select("vec_id", F.round(cos, 6).alias("cosine"))


@query(quantiser_sql.TOP_K)
def quant_topk(spark, d):
    e = table(spark, d, "embeddings")
    scored = quantiser.score_compressed(quantiser.compress(e), vectors.vector_of(e, 0), correction=False)
    return vectors.top_k(scored.select("vec_id", F.round("score", 6).alias("score")), 10)


@query(quantiser_sql.CORRECTED)
def quant_topk_corrected(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.top_k(quantiser.score_compressed(quantiser.compress(e), vectors.vector_of(e, 0)).select("vec_id", F.round("score", 6).alias("score")), 10)


@query(quantiser_sql.BITS)
def qjl_bits(spark, d):
    return quantiser.compress(table(spark, d, "embeddings")).select("vec_id", F.hex("pq_angles").alias("angles"), F.hex("qjl_bits").alias("bits"), F.round("final_radius", 6).alias("radius"))


@query(quantiser_sql.BATCH_TOP_K)
def quant_batch_topk(spark, d):
    """The compressed search for every query row: what is stored is decoded and met by blocks of queries."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.batch_top_k(queries, quantiser.decompress(quantiser.compress(e)), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(quantiser_sql.RECALL)
def quant_recall(spark, d):
    """Share of the exact ten nearest that the compressed search finds, per query row."""
    exact, found = vec_batch_topk(spark, d).select("query_id", "vec_id"), quant_batch_topk(spark, d).select("query_id", "vec_id", F.lit(1.0).alias("hit"))
    return exact.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


# scalar text functions

_DOC = "SELECT doc_id, {x} FROM documents"


@query(_DOC.format(x="substr(sha256(text), 1, 16) AS hash"))
def doc_hash16(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(_DOC.format(x="CAST(ceil(length(text) / 4.0) AS INT) AS tokens, CAST(strlen(text) AS BIGINT) AS bytes"))
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), F.octet_length("text").cast("long").alias("bytes"))


_CUT = "(CASE WHEN instr(h, chr(10)) > 0 AND 400 - instr(reverse(h), chr(10)) > 320 THEN h[1 : 400 - instr(reverse(h), chr(10))] ELSE h END) || chr(10) || '... [truncated]'"


@query(f"SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE {_CUT} END AS content, length(text) > 400 AS truncated FROM (SELECT doc_id, text, text[1:400] AS h FROM documents)")
def token_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_to_budget(F.col("text"), 100).alias("content"), T.was_truncated(F.col("text"), 100).alias("truncated"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^0-9A-Za-z_\t\n\f\r\x0b -]', '', 'g'), '[\t\n\f\r\x0b ]+', '-', 'g')[1:80] AS slug FROM documents")
def title_slug(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query(r"SELECT p_partkey, trim(regexp_replace(concat_ws(' ', p_type, p_name, p_brand), '\s+', ' ', 'g')) AS embedding_text FROM part")
def embedding_text(spark, d):
    return table(spark, d, "part").select("p_partkey", T.squeeze(F.col("p_type"), F.col("p_name"), F.col("p_brand")).alias("embedding_text"))


_PATHS = "source || '/' || lang || '.d/f' || doc_id || (['.ts', '.py', '.md', '', '.tar.gz', '.RS', '.h', '.txt'])[CAST(doc_id % 8 + 1 AS INT)]"


@query(f"""SELECT p AS path, e AS extension, CASE e WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.h' THEN 'c' END AS language, e IN ('.md', '.txt') AS is_doc
FROM (SELECT p, regexp_extract(p, '(\\.[^.]*)$', 1) AS e FROM (SELECT {_PATHS} AS p FROM documents))""")
def classify_paths(spark, d):
    ends = F.array(*[F.lit(x) for x in (".ts", ".py", ".md", "", ".tar.gz", ".RS", ".h", ".txt")])
    p = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit(".d/f"), F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 8 + 1).cast("int"))).alias("path"))
    return p.select("path", files.extension(F.col("path")).alias("extension"), files.language_of(F.col("path")).alias("language"), files.is_doc(F.col("path")).alias("is_doc"))


# lines and references

_LINES = "SELECT doc_id, CAST(i AS INT) AS line, l[i] AS content FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_REFS = rf"SELECT doc_id, line, regexp_replace(content, '^\s+|\s+$', '', 'g')[1:200] AS context FROM ({_LINES}) WHERE contains(content, '{QUERY_TEXT}')"


@query(f"SELECT doc_id, line, length(content) AS chars FROM ({_LINES})")
def doc_lines(spark, d):
    return structure.lines_of(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "line", F.length("content").cast("long").alias("chars"))


@query(_REFS)
def references_substring(spark, d):
    return structure.references(table(spark, d, "documents"), QUERY_TEXT, "doc_id", "text", limit=None)


@query(f"{_REFS} ORDER BY doc_id, line LIMIT 20")
def references_top20(spark, d):
    return structure.references(table(spark, d, "documents"), QUERY_TEXT, "doc_id", "text", limit=20)


# full text

_TOKENS = r"SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents"


def _tokenised(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", T.word_tokens(F.col("text")).alias("t"))


@query(f"SELECT doc_id, t AS term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(t) AS t FROM ({_TOKENS})) GROUP BY ALL")
def fts_tokens(spark, d):
    return keyword.postings(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "term", F.size("positions").cast("long").alias("tf"))


@query(f"SELECT t AS term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM (SELECT doc_id, unnest(t) AS t FROM ({_TOKENS})) GROUP BY ALL")
def fts_df(spark, d):
    return keyword.document_frequency(table(spark, d, "documents"), "text")


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS doc_len FROM ({_TOKENS})")
def fts_doclen(spark, d):
    return _tokenised(spark, d).select("doc_id", F.size("t").cast("long").alias("doc_len"))


def _tf_sql(phrase: list[str], prefix: bool) -> str:
    words = [f"t[i + {j}] = '{w}'" if not prefix or j < len(phrase) - 1 else f"starts_with(t[i + {j}], '{w}')" for j, w in enumerate(phrase)]
    return f"len(list_filter(range(1, len(t) + 1), lambda i: coalesce({' AND '.join(words)}, false)))"


def _bm25_sql(phrases: list[list[str]], prefix: bool, rows: str = _TOKENS) -> str:
    k = range(len(phrases))
    idf = lambda i: f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END)"
    terms = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in k)
    return f"""WITH c AS (SELECT doc_id, lang, len(t) AS dl, {", ".join(f"{_tf_sql(p, prefix)} AS f{i}" for i, p in enumerate(phrases))} FROM ({rows})),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS mean, {", ".join(f"CAST(count(*) FILTER (f{i} > 0) AS DOUBLE) AS df{i}" for i in k)} FROM c)
SELECT doc_id, lang, {terms} AS score FROM c, s WHERE {" OR ".join(f"f{i} > 0" for i in k)}"""


def _rounded(sql: str) -> str:
    return f"SELECT doc_id, lang, round(score, 6) AS score FROM ({sql})"


def _bm25(spark, d, phrases, prefix):
    return keyword.bm25(_tokenised(spark, d), ["t"], phrases, prefix).select("doc_id", "lang", F.round("score", 6).alias("score"))


@query(_rounded(_bm25_sql([["the"]], False)))
def bm25_single(spark, d):
    return _bm25(spark, d, [["the"]], False)


@query(_rounded(_bm25_sql([["tion"], ["est"]], True)))
def bm25_or(spark, d):
    return _bm25(spark, d, keyword.phrases(QUERY_WORDS), True)


@query(_rounded(_bm25_sql([["ther"]], True)))
def bm25_prefix(spark, d):
    return _bm25(spark, d, [["ther"]], True)


@query(_rounded(_bm25_sql([["de", "la"]], True)))
def bm25_phrase(spark, d):
    return _bm25(spark, d, [PHRASE.split()], True)


@query(_rounded(_bm25_sql([["tion"], ["de", "la"]], True)))
def bm25_indexed(spark, d):
    """The same search over a stored index, sorted by term: the scan reads the row groups of the query's words only."""
    docs = _tokenised(spark, d).withColumn("length", F.size("t"))
    postings = keyword.occurrences(docs, ["t"], ["doc_id", "lang"]).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    totals = docs.agg(F.count("*").alias("docs"), F.sum("length").alias("words"))
    hits = keyword.bm25_indexed(cut(postings, "postings"), totals, [["tion"], PHRASE.split()], ["doc_id", "lang"])
    return hits.withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql([['thing'], ['run']], True, stemming_sql.STEMMED)})")
def bm25_porter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", stemmed_tokens("text").alias("t"))
    return keyword.bm25(docs, ["t"], keyword.phrases("things running", stemmed=True)).select("doc_id", F.round("score", 6).alias("score"))


_SUB = lambda q: f"len(list_filter(range(1, length(lower(p_name)) + 1), lambda i: lower(p_name)[i : i + {len(q) - 1}] = '{q}'))"


def _trigram_sql(q: str) -> str:
    return f"""WITH c AS (SELECT p_partkey, p_name, {_SUB(q)} AS f, greatest(length(p_name) - 2, 0) AS dl FROM part),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS mean, CAST(count(*) FILTER (f > 0) AS DOUBLE) AS df FROM c)
SELECT p_partkey, p_name, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean)) AS score FROM c, s WHERE f > 0"""


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ro')")
def trigram_contains(spark, d):
    return table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lit("ro"))).select("p_partkey", "p_name")


@query(f"SELECT p_partkey, p_name, round(score, 6) AS score FROM ({_trigram_sql('idg')})")
def trigram_bm25(spark, d):
    return keyword.trigram_search(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name"], "IDG").withColumn("score", F.round("score", 6))


@query(f"SELECT p_partkey, p_name, round(score * 0.8, 6) AS score, 'trigram' AS source, 'trigram' AS strategy FROM ({_trigram_sql('idg')}) ORDER BY score DESC, p_partkey LIMIT 20")
def keyword_fallback(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    fts = keyword.bm25(part.withColumn("t", T.word_tokens(F.col("p_name"))), ["t"], [["idg"]]).drop("t")
    return keyword.with_fallback(fts, keyword.trigram_search(part, ["p_name"], "idg"), "p_partkey", 20).withColumn("score", F.round("score", 6))


# fusion

_KW = f"SELECT doc_id AS id, lang, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ({_bm25_sql([['tion'], ['est']], True)}) QUALIFY rank <= 20"
_SEM = f"SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({_SCORED}) QUALIFY rank <= 20"
_RRF = "SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(rank + o) AS seq FROM (SELECT id, rank, 0 AS o FROM ({kw}) UNION ALL SELECT id, rank, 1000000000 AS o FROM ({sem})) GROUP BY id ORDER BY rrf DESC, seq LIMIT 10"


def _kw_list(spark, d, k=20):
    hits = _bm25(spark, d, keyword.phrases(QUERY_WORDS), True)
    return keyword.ranked(hits, [F.col("score").desc(), F.col("doc_id")], k).withColumnRenamed("doc_id", "id")


def _sem_list(spark, d, k=20):
    return keyword.ranked(_scored(spark, d), [F.col("score").desc(), F.col("vec_id")], k).withColumnRenamed("vec_id", "id")


@query(f"SELECT id, round(rrf, 9) AS rrf FROM ({_RRF.format(kw=_KW, sem=_SEM)})")
def rrf_fuse(spark, d):
    return fusion.rrf_fuse(_kw_list(spark, d).select("id", "rank"), _sem_list(spark, d).select("id", "rank"), 10).select("id", F.round("rrf", 9).alias("rrf"))


@query("SELECT id, round(rrf, 9) AS rrf, CAST(row_number() OVER (ORDER BY rrf DESC, seq) AS BIGINT) AS place FROM (" + _RRF.format(kw="SELECT n_nationkey AS id, n_nationkey + 1 AS rank FROM nation WHERE n_nationkey < 10", sem="SELECT n_nationkey AS id, 25 - n_nationkey AS rank FROM nation WHERE n_nationkey >= 15") + ")")
def rrf_ties(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    fused = fusion.rrf_fuse(n.where("id < 10").withColumn("rank", F.col("id") + 1), n.where("id >= 15").withColumn("rank", 25 - F.col("id")), 10)
    return fused.select("id", F.round("rrf", 9).alias("rrf"), F.row_number().over(Window.orderBy(F.col("rrf").desc(), "seq")).cast("long").alias("place"))


@query(f"SELECT f.id, round(rrf, 9) AS score, lang, source, substr(text, 1, 80) AS snippet FROM ({_RRF.format(kw=_KW, sem=_SEM)}) f JOIN documents ON doc_id = f.id")
def hybrid_search_flagship(spark, d):
    fused = fusion.rrf_fuse(_kw_list(spark, d).select("id", "rank"), _sem_list(spark, d).select("id", "rank"), 10)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.substring("text", 1, 80).alias("snippet"))
    return fusion.enrich(fused, docs).select("id", F.round("rrf", 9).alias("score"), "lang", "source", "snippet")


@query(f"SELECT id, lang, rank FROM ({_KW}) WHERE lang = 'fr'")
def type_filter_post_limit(spark, d):
    return _kw_list(spark, d).where("lang = 'fr'").select("id", "lang", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT doc_id AS id, lang, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ({_bm25_sql([['tion'], ['est']], True)}) WHERE lang = 'fr' QUALIFY rank <= 20")
def type_filter_pre_limit(spark, d):
    hits = _bm25(spark, d, keyword.phrases(QUERY_WORDS), True).where("lang = 'fr'")
    return keyword.ranked(hits, [F.col("score").desc(), F.col("doc_id")], 20).select(F.col("doc_id").alias("id"), "lang", F.col("rank").cast("long").alias("rank"))


# parsers

_MD = "'# ' || source || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || text"


@query(f"""SELECT path, seq, title, level, coalesce(parent_seq, -1) AS parent_seq, byte_start, byte_end FROM (
SELECT CAST(doc_id AS VARCHAR) AS path, 0 AS seq, source AS title, 1 AS level, NULL::INT AS parent_seq, 0::INT AS byte_start, CAST(strlen(source) + 4 AS INT) AS byte_end FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, lang, 2, 0, CAST(strlen(source) + 4 AS INT), CAST(strlen({_MD}) + 1 AS INT) FROM documents)""")
def md_sections(spark, d):
    md = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n\n"), "text").alias("content"))
    return markdown.parse_sections(md).select("path", "seq", "title", "level", F.coalesce("parent_seq", F.lit(-1)).alias("parent_seq"), "byte_start", "byte_end")


@query(r"""SELECT page_id, CAST(regexp_extract(h, '(?i)^<h([1-6])', 1) AS INT) AS level, regexp_replace(h, '<[^>]*>', '', 'g') AS title
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>')) AS h FROM pages)""")
def html_headings(spark, d):
    return markdown.html_headings(table(spark, d, "pages"), "page_id", "html")


@query("""SELECT doc_id || '.go' AS path, 'f' || doc_id AS name, 'function' AS kind, 'func f' || doc_id AS signature, 1::INT AS line_start, 2::INT AS line_end, 0::INT AS char_start, CAST(length('func f' || doc_id || '() {' || chr(10) || '}') AS INT) AS char_end FROM documents""")
def code_symbols(spark, d):
    src = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".go")).alias("path"), F.lit("go").alias("language"), F.concat(F.lit("func f"), F.col("doc_id").cast("string"), F.lit("() {\n}\n\n// "), F.translate("text", "\n", " ")).alias("content"))
    return code.parse_symbols(src).select("path", "name", "kind", "signature", "line_start", "line_end", "char_start", "char_end")


# structure

_NODES = """SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer"""


def _nodes(spark, d):
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, d, "region").select(k("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(k("n", "n_nationkey").alias("id"), k("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    c = table(spark, d, "customer").select(k("c", "c_custkey").alias("id"), k("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("name"))
    return r.union(n).union(c)


@query(f"SELECT p.id AS parent_id, p.name AS parent_name, c.id, c.name FROM ({_NODES}) c JOIN ({_NODES}) p ON c.parent_id = p.id")
def outline_children(spark, d):
    n = _nodes(spark, d)
    p = n.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return n.join(p, "parent_id").select("parent_id", "parent_name", "id", "name")


@query(f"""WITH RECURSIVE n AS ({_NODES}), t AS (SELECT id, 0 AS depth, id AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, t.depth + 1, t.path || '/' || n.id FROM n JOIN t ON n.parent_id = t.id)
SELECT id, CAST(depth AS INT) AS depth, path FROM t""")
def outline_tree_depth(spark, d):
    return structure.tree_depth(_nodes(spark, d)).select("id", "depth", F.concat_ws("/", "path").alias("path"))


@query("SELECT n_nationkey AS id, n_name FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) AND n_nationkey <> 3")
def siblings_except_self(spark, d):
    return structure.siblings(table(spark, d, "nation").withColumnRenamed("n_nationkey", "id"), 3, "n_regionkey").select("id", "n_name")


@query("""SELECT source, doc_id, used FROM (SELECT source, doc_id, coalesce(sum(n_chars / 4.0) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents) WHERE used <= 750""")
def budget_running_sum(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", (F.col("n_chars") / 4.0).alias("cost"))
    return structure.within_budget(docs, ["source"], ["doc_id"], "cost", 750).select("source", "doc_id", "used")


# incremental maintenance: stored hashes are right for all but every tenth document, and a document in seven isn't stored

_STORED = "SELECT doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE substr(sha256(text), 1, 16) END AS hash, 1 AS version FROM documents WHERE doc_id % 7 <> 0"
_CURRENT = "SELECT doc_id AS path, substr(sha256(text), 1, 16) AS hash, 2 AS version FROM documents"
_CHANGED = f"SELECT c.* FROM ({_CURRENT}) c ANTI JOIN ({_STORED}) s ON c.path = s.path AND c.hash = s.hash"


def _versions(spark, d):
    now = table(spark, d, "documents").select(F.col("doc_id").alias("path"), T.content_hash(F.col("text")).alias("hash"), F.lit(2).alias("version"))
    old = now.where("path % 7 <> 0").select("path", F.when(F.col("path") % 10 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.lit(1).alias("version"))
    return old, now


@query(_CHANGED)
def incremental_changed(spark, d):
    old, now = _versions(spark, d)
    return store.changed(now, old)


@query(f"SELECT s.* FROM ({_STORED}) s ANTI JOIN ({_CHANGED}) n ON s.path = n.path UNION ALL ({_CHANGED})")
def incremental_merge(spark, d):
    old, now = _versions(spark, d)
    return store.merge(old, store.changed(now, old), ["path"])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def dedup_last_wins(spark, d):
    return store.last_wins(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_cascade(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("file_path"), F.col("c_mktsegment").alias("seg"))
    gone = spark.createDataFrame([("3",), ("BUILDING",)], "file_path string")
    left = store.delete_of_files(table(spark, d, "orders").withColumnRenamed("o_custkey", "entity_id"), c.select("id", "file_path"), c.select("id", F.col("seg").alias("file_path")), gone)
    return left.select("o_orderkey", "o_orderpriority")


# statistics

@query("SELECT (SELECT count(*) FROM documents) AS total_files, (SELECT count(*) FROM pages) AS total_symbols, (SELECT count(*) FROM conversations) AS total_sections")
def status_counts(spark, d):
    one = lambda t, c: table(spark, d, t).agg(F.count("*").alias(c))
    return one("documents", "total_files").crossJoin(one("pages", "total_symbols")).crossJoin(one("conversations", "total_sections"))


@query("SELECT CASE WHEN d > 0 THEN CAST(floor(100.0 * v / d + 0.5) AS INT) ELSE 0 END AS coverage_pct FROM (SELECT (SELECT count(*) FROM labels) AS v, (SELECT count(*) FROM documents) AS d)")
def coverage_pct(spark, d):
    n = table(spark, d, "labels").agg(F.count("*").alias("v")).crossJoin(table(spark, d, "documents").agg(F.count("*").alias("d")))
    return n.select(F.when(F.col("d") > 0, T.round_half_up(100.0 * F.col("v") / F.col("d"))).otherwise(0).cast("int").alias("coverage_pct"))


# a context bundle: the target's text, its neighbours over 0.5 among the first 10 within the running budget, lines that name its source

_NEAR = f"SELECT doc_id, source, score FROM (SELECT * FROM ({_SCORED}) WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10) JOIN documents ON doc_id = vec_id WHERE score > 0.5"
_BUNDLE = rf"""
SELECT 'target' AS part, doc_id, 0::BIGINT AS seq, text[1:200] AS detail, NULL::DOUBLE AS similarity FROM documents WHERE doc_id = 0
UNION ALL SELECT 'semantic_neighbor', doc_id, rank, source, floor(score * 100 + 0.5) / 100 FROM (
  SELECT *, row_number() OVER o AS rank, coalesce(sum(length(source) / 4.0) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ({_NEAR}) WINDOW o AS (ORDER BY score DESC, doc_id)) WHERE used <= 750
UNION ALL SELECT 'reference', doc_id, row_number() OVER (ORDER BY doc_id, line), context, NULL FROM (SELECT * FROM ({_REFS}) ORDER BY doc_id, line LIMIT 10)"""


@query(_BUNDLE)
def context_bundle(spark, d):
    docs = table(spark, d, "documents")
    null = F.lit(None).cast("double").alias("similarity")
    target = docs.where("doc_id = 0").select(F.lit("target").alias("part"), "doc_id", F.lit(0).cast("long").alias("seq"), F.substring("text", 1, 200).alias("detail"), null)
    near = vectors.top_k(_scored(spark, d).where("vec_id <> 0"), 10).where("score > 0.5").withColumnRenamed("vec_id", "doc_id")
    near = F.broadcast(near).join(docs.select("doc_id", "source"), "doc_id").withColumn("cost", F.length("source") / 4.0)
    near = structure.within_budget(near, [], [F.col("score").desc(), F.col("doc_id")], "cost", 750)
    near = near.select(F.lit("semantic_neighbor").alias("part"), "doc_id", F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id")).cast("long").alias("seq"), F.col("source").alias("detail"), T.round_half_up(F.col("score"), 2).alias("similarity"))
    refs = structure.references(docs, QUERY_TEXT, "doc_id", "text", 10)
    refs = refs.select(F.lit("reference").alias("part"), "doc_id", F.row_number().over(Window.orderBy("doc_id", "line")).cast("long").alias("seq"), F.col("context").alias("detail"), null)
    return target.union(near).union(refs)


# the tools, over an index of the documents as Markdown files

_FILE = "'docs/' || doc_id || '.md'"
_PLACE = f"SELECT *, {_FILE} AS file, {_MD} AS md FROM documents"
_SLUG = lambda x: rf"regexp_replace(regexp_replace(lower({x}), '[^0-9A-Za-z_\t\n\f\r\x0b -]', '', 'g'), '[\t\n\f\r\x0b ]+', '-', 'g')[1:80]"


def _project(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n\n"), "text").alias("content"))


def _engine(spark, d, provider=None) -> Engine:
    engine = Engine(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", provider)
    engine.index(_project(spark, d))
    return engine


def _counters(spark, runs: list[dict]) -> DataFrame:
    names = ["indexed", "skipped", "pruned", "symbols", "sections", "vectors"]
    return spark.createDataFrame([(k, *[r[n] for n in names]) for k, r in enumerate(runs)], "run long, " + ", ".join(f"{n} long" for n in names))


@query("""SELECT 0::BIGINT AS run, count(*) AS indexed, 0::BIGINT AS skipped, 0::BIGINT AS pruned, 0::BIGINT AS symbols, 2 * count(*) AS sections, 0::BIGINT AS vectors FROM documents
UNION ALL SELECT 1, 0, count(*), 0, 0, 0, 0 FROM documents
UNION ALL SELECT 2, count(*) FILTER (doc_id % 10 = 0 AND doc_id % 7 <> 0), count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 7 <> 0), count(*) FILTER (doc_id % 7 = 0), 0, 2 * count(*) FILTER (doc_id % 10 = 0 AND doc_id % 7 <> 0), 0 FROM documents""")
def engine_index(spark, d):
    """Counters of a first run, of one without a change, and of one with changed and missing files."""
    engine, source = Engine(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"), _project(spark, d)
    number = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    later = source.where(number % 7 != 0).select("path", F.when(number % 10 == 0, F.concat("content", F.lit("\nmore"))).otherwise(F.col("content")).alias("content"))
    return _counters(spark, [engine.index(source), engine.index(source), engine.index(later, prune=True)])


@query("SELECT count(*) AS total_files, 0::BIGINT AS total_symbols, 2 * count(*) AS total_sections, 0::BIGINT AS total_vectors, 0::BIGINT AS storage_bytes, 'N/A' AS compression_ratio, 0::INT AS coverage_pct, 'unloaded' AS embedding_state FROM documents")
def engine_status(spark, d):
    return _engine(spark, d).status().select("total_files", "total_symbols", "total_sections", "total_vectors", "storage_bytes", "compression_ratio", "coverage_pct", "embedding_state")


_CUT_GET = "(CASE WHEN instr(h, chr(10)) > 0 AND 8000 - instr(reverse(h), chr(10)) > 6400 THEN h[1 : 8000 - instr(reverse(h), chr(10))] ELSE h END) || chr(10) || '... [truncated]'"


@query(f"""SELECT id, 'section' AS type, content, CAST(ceil(length(content) / 4.0) AS INT) AS tokens, truncated FROM (
SELECT id, CASE WHEN length(body) <= 8000 THEN body ELSE {_CUT_GET} END AS content, length(body) > 8000 AS truncated FROM (
SELECT file || '::' || {_SLUG('lang')} || '#2' AS id, '## ' || lang || chr(10) || chr(10) || text AS body, body[1:8000] AS h FROM ({_PLACE}) WHERE doc_id = 3))""")
def engine_get(spark, d):
    engine = _engine(spark, d)
    lang = table(spark, d, "documents").where("doc_id = 3").select(T.slugify(F.col("lang"))).first()[0]
    return engine.get(f"docs/3.md::{lang}#2").select("id", "type", "content", "tokens", "truncated")


@query(f"""SELECT *, count(*) OVER () AS total_sections FROM (
SELECT file || '::' || {_SLUG('source')} || '#1' AS id, source AS name, 'h1' AS kind, 0::INT AS char_start FROM ({_PLACE}) WHERE doc_id = 3
UNION ALL SELECT file || '::' || {_SLUG('lang')} || '#2', lang, 'h2', CAST(length(source) + 4 AS INT) FROM ({_PLACE}) WHERE doc_id = 3)""")
def engine_outline(spark, d):
    engine = _engine(spark, d)
    rows = engine.outline("docs/3.md").select("id", "name", "kind", "char_start")
    return rows.crossJoin(F.broadcast(engine.outline_totals("docs/3.md").select("total_sections")))


_MD_LINES = f"SELECT file, CAST(i AS INT) AS line, l[i] AS content FROM (SELECT file, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT file, string_split(md, chr(10)) AS l FROM ({_PLACE})))"
_MD_REFS = rf"SELECT file, line, regexp_replace(content, '^\s+|\s+$', '', 'g')[1:200] AS context FROM ({_MD_LINES}) WHERE contains(content, '{{name}}')"


@query(f"{_MD_REFS.format(name=QUERY_TEXT)} ORDER BY file, line LIMIT 20")
def engine_references(spark, d):
    return _engine(spark, d).references(QUERY_TEXT)


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS name, * FROM ({_MD_REFS.format(name=n)}) ORDER BY file, line LIMIT 20)" for n in ("the", "tion", "# en")))
def references_many(spark, d):
    names = spark.createDataFrame([("the",), ("tion",), ("# en",), ("",), (None,), ("the",)], "name string")
    return structure.references_of(_project(spark, d), names, "path", "content").withColumnRenamed("path", "file")


@query()
def engine_search(spark, d):
    """Hybrid search over the sections, with hashed embeddings."""
    return _engine(spark, d, HashingProvider(64)).search("en", limit=10).select("rank", "id", "type", "name", "kind", "strategy")


@query()
def engine_context(spark, d):
    """The bundle of a section, and its totals."""
    engine = _engine(spark, d, HashingProvider(64))
    lang = table(spark, d, "documents").where("doc_id = 3").select(T.slugify(F.col("lang"))).first()[0]
    bundle = engine.context(f"docs/3.md::{lang}#2")
    return bundle.crossJoin(F.broadcast(engine.context_totals(bundle))).select("part", "seq", "id", "name", F.round("similarity", 2).alias("similarity"), F.round("total_tokens", 4).alias("total_tokens"))
