"""The seven queries over an indexed project: index, search, get, outline, references, context, status. Each gives a DataFrame."""

from __future__ import annotations

import hashlib
import os
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.embedding import EmbeddingProvider, NoProvider
from ..functions.stemming import stemmed_tokens
from ..functions.text import estimate_tokens, round_half_up, squeeze, symbol_content, truncate_to_budget, was_truncated
from ..operators import fusion, keyword, quantiser, store, structure
from ..sources import code, files, markdown
from ..sources.snapshot import PARTED, TABLES, SnapshotStore, columns, part_of

#: Columns of the keyword index, and of their stems.
INDEXED = ["entity_id", "entity_type", "name", "content"]
STEMS = [f"t_{c}" for c in INDEXED]
GET_TOKENS, CONTEXT_TOKENS, SEARCH_LIMIT, REFERENCE_LIMIT = 2000, 3000, 10, 20


def warehouse_of(root: str, base: str) -> str:
    """One folder a project: its name and 16 hex digits of its path's SHA-256."""
    return f"{base.rstrip('/')}/{os.path.basename(root.rstrip('/'))}-{hashlib.sha256(root.encode()).hexdigest()[:16]}"


def _tokenised(docs: DataFrame) -> DataFrame:
    """Keyword rows with the stems of their columns and how many there are."""
    stems = docs.select(*[c for c in docs.columns if c != "length"], *[stemmed_tokens(F.col(c)).alias(f"t_{c}") for c in INDEXED])
    return stems.withColumn("length", sum((F.size(c) for c in STEMS), F.lit(0)))


def _postings(tokenised: DataFrame) -> DataFrame:
    return keyword.occurrences(tokenised, STEMS, ["entity_id", "entity_type", "file_path"]).select(*columns("postings"))


def _totals(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.groupBy(*keys, "entity_type").agg(F.count("*").alias("docs"), F.sum("length").alias("words"))


class Engine:
    """faithful=True filters types after the keyword limit, as the defaults define it; False filters before, so that results fill up."""

    def __init__(self, spark: SparkSession, folder: str, provider: EmbeddingProvider | None = None, faithful: bool = True, correction: bool = True, parts: int | None = None):
        self.spark, self.store, self.provider = spark, SnapshotStore(spark, folder, parts), provider or NoProvider()
        self.faithful, self.correction, self._cached = faithful, correction, (None, None)

    # index

    def index(self, source: DataFrame | str, subdirectory: str = "", force: bool = False, prune: bool = False) -> dict:
        """Index a directory, or a table of (path, content). Unchanged files are skipped by hash; with prune, files that are gone go. Returns the counters."""
        began = time.monotonic()
        took = lambda: {"duration_ms": int(1000 * (time.monotonic() - began))}
        listed = files.read_directory(self.spark, source, subdirectory) if isinstance(source, str) else files.classified(source)
        stored = self.store.read("files")
        fresh = store.changed(listed, stored, force=force).withColumn("indexed_at", F.current_timestamp()).cache()
        (n_new, size), n_all = fresh.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first(), listed.count()
        gone = stored.select("path").join(listed.select("path"), "path", "left_anti") if prune else None
        n_gone = gone.count() if prune else 0
        counts = {"indexed": n_new, "skipped": n_all - n_new, "pruned": n_gone, "symbols": 0, "sections": 0, "vectors": 0}
        if not n_new and not n_gone:
            return counts | took()
        symbols = code.as_entities(code.parse_symbols(fresh.where(~F.col("is_doc"))))
        sections = markdown.as_entities(markdown.parse_sections(fresh.where("is_doc")))
        symbols, sections = symbols.cache(), sections.cache()
        docs = symbols.select(F.col("id").alias("entity_id"), F.lit("symbol").alias("entity_type"), "file_path", "seq", "name", symbol_content(F.col("name"), F.col("qualified_name"), F.col("kind"), F.col("signature"), F.col("doc_comment")).alias("content"))
        docs = docs.unionByName(sections.select(F.col("id").alias("entity_id"), F.lit("section").alias("entity_type"), "file_path", "seq", F.col("title").alias("name"), F.concat_ws(" ", "title", "summary").alias("content")))
        texts = symbols.select(F.col("id").alias("entity_id"), F.lit("symbol").alias("entity_type"), "file_path", "seq", squeeze(F.col("kind"), F.col("name"), F.col("signature"), F.col("doc_comment")).alias("embedding_text"))
        texts = texts.unionByName(sections.select(F.col("id").alias("entity_id"), F.lit("section").alias("entity_type"), "file_path", "seq", squeeze(F.col("title"), F.col("summary")).alias("embedding_text")))
        vectors = self._vectors(store.last_wins(texts, ["entity_id"], "seq"))
        touched = fresh.select(F.col("path").alias("file_path"))
        touched = touched.union(gone.select("path")) if prune else touched
        n_parts, whole = self.store.parts_for(size)
        # at most n_parts numbers; all else stays where it is
        changed = None if whole else [r[0] for r in touched.select(part_of(F.col("file_path"), n_parts).alias("part")).distinct().collect()]
        keep = lambda name, key="file_path": store.delete_where(self.store.read(name, changed), touched.withColumnRenamed("file_path", key), [key])
        new_symbols, new_sections = store.last_wins(symbols, ["id"], "seq"), store.last_wins(sections, ["id"], "seq")
        # repeated ids of a file are one keyword row, so that a hit isn't counted twice
        docs = store.last_wins(docs, ["entity_id"], "seq").drop("seq")
        kept = keep("search_docs")
        if self.store.schema_version < PARTED:  # nothing is stemmed yet
            docs, kept = docs.unionByName(kept.drop("length")), kept.limit(0)
        docs = _tokenised(docs).cache()
        postings = _postings(docs) if whole else keep("postings").unionByName(_postings(docs))
        all_docs = kept.unionByName(docs.select(*kept.columns))
        merged = {
            "files": keep("files", "path").unionByName(fresh),
            "symbols": keep("symbols").unionByName(new_symbols),
            "sections": keep("sections").unionByName(new_sections),
            "search_docs": all_docs,
            "postings": postings,
            "stats": _totals(all_docs.withColumn("part", part_of(F.col("file_path"), n_parts)), "part"),
            "vectors": keep("vectors").unionByName(vectors),
        }
        counts |= {"symbols": new_symbols.count(), "sections": new_sections.count()}
        self.store.write(merged, n_parts, changed)
        counts["vectors"] = self.store.read("vectors", changed).join(touched.distinct(), "file_path", "left_semi").count()
        for df in (fresh, symbols, sections, docs):
            df.unpersist()
        return counts | took()

    def _vectors(self, texts: DataFrame) -> DataFrame:
        if not self.provider.is_ready():
            return self.spark.createDataFrame([], TABLES["vectors"])
        embedded = self.provider.embed_column(texts, "embedding_text", "embedding")
        made = quantiser.compress(embedded.where("embedding IS NOT NULL"), "entity_id", "embedding", id_type="string")
        named = made.join(texts, "entity_id").withColumn("model_id", F.lit(self.provider.status()["model_id"]))
        return named.select(*[c.split()[0] for c in TABLES["vectors"].split(", ")])

    # entities

    def entities(self) -> DataFrame:
        """Symbols and sections as one table with an explicit type."""
        sym = self.store.read("symbols").select("id", F.lit("symbol").alias("type"), "file_path", "name", "kind", "signature", "line_start", "line_end", "char_start", "char_end", "parent_id", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("summary"), "doc_comment", "seq")
        sec = self.store.read("sections").select("id", F.lit("section").alias("type"), "file_path", F.col("title").alias("name"), F.concat(F.lit("h"), F.col("level").cast("string")).alias("kind"), F.lit(None).cast("string").alias("signature"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), "char_start", "char_end", "parent_id", "level", "summary", F.lit(None).cast("string").alias("doc_comment"), "seq")
        return sym.unionByName(sec)

    # search

    def _keyword(self, query: str, type_: str, limit: int, fuzzy: bool) -> DataFrame:
        docs = self.store.read("search_docs")
        if self.store.schema_version >= PARTED:
            postings, stats = self.store.read("postings"), self.store.read("stats")
        else:
            stems = _tokenised(docs)
            postings, stats = _postings(stems), _totals(stems)
        of_type = lambda df: df if type_ == "all" else df.where(F.col("entity_type") == type_)
        if not self.faithful:
            postings, stats = of_type(postings), of_type(stats)
        # a query with a double quote isn't one that the index can read: nothing matches, so the substring search opens
        wanted = [] if '"' in query else keyword.phrases(query, stemmed=True)
        fts = keyword.bm25_indexed(postings, stats, wanted, ["entity_id", "entity_type"])
        fts = of_type(fts.orderBy(F.col("score").desc(), "entity_id").limit(2 * limit))
        tri = docs.where(F.lit('"' not in query)).select("entity_id", "entity_type", "name")
        tri = keyword.trigram_search(tri, ["entity_id", "name"], query)
        tri = of_type(tri.orderBy(F.col("score").desc(), "entity_id").limit(limit))
        return keyword.with_fallback(fts, tri.drop("name"), "entity_id", limit, fuzzy)

    def _semantic(self, vector: list[float], type_: str, k: int, exclude: str | None = None) -> DataFrame:
        at = self.store.version
        if self._cached[0] != at:
            if self._cached[1] is not None:
                self._cached[1].unpersist()
            self._cached = (at, self.store.read("vectors").cache())
        rows = self._cached[1]
        rows = rows if type_ == "all" else rows.where(F.col("entity_type") == type_)
        rows = rows if exclude is None else rows.where(F.col("entity_id") != exclude)
        scored = quantiser.score_compressed(rows, vector, correction=self.correction).select("entity_id", "score")
        return scored.orderBy(F.col("score").desc(), "entity_id").limit(k)

    def search(self, query: str, type_: str = "all", limit: int = SEARCH_LIMIT, fuzzy: bool = False, semantic: bool = True) -> DataFrame:
        """rank, id, type, name, kind, file_path, signature, score, strategy: keyword and vector hits fused by reciprocal rank."""
        query = query.strip()
        shape = "rank int, id string, type string, name string, kind string, file_path string, signature string, score double, strategy string"
        if not query:
            return self.spark.createDataFrame([], shape)
        kw = self._keyword(query, type_, 2 * limit, fuzzy)
        order = [F.col("score").desc(), F.col("source"), F.col("entity_id")]
        kw = kw.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumnRenamed("entity_id", "id").cache()
        vector = self.provider.embed(query) if semantic and self.provider.is_ready() else None
        sem = self.spark.createDataFrame([], "id string, rank int")
        if vector is not None:
            sem = self._semantic(vector, type_, 2 * limit)
            sem = sem.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "entity_id"))).select(F.col("entity_id").alias("id"), "rank").cache()
        hybrid = vector is not None and sem.limit(1).count() > 0
        fused = fusion.rrf_fuse(kw.select("id", "rank"), sem, limit)
        label = F.lit("hybrid") if hybrid else F.coalesce(F.first("strategy"), F.lit("trigram"))
        strategy = kw.agg(label.alias("strategy"))
        rows = fusion.enrich(fused, self.entities()).crossJoin(F.broadcast(strategy))
        rows = rows if type_ == "all" else rows.where(F.col("type") == type_)
        w = Window.orderBy(F.col("rrf").desc(), "seq_")
        rows = rows.drop("seq").join(fused.select("id", F.col("seq").alias("seq_")), "id")
        return rows.select(F.row_number().over(w).alias("rank"), "id", "type", "name", "kind", "file_path", "signature", F.col("rrf").alias("score"), "strategy").orderBy("rank")

    # get

    def get(self, id_: str, max_tokens: int = GET_TOKENS) -> DataFrame:
        """id, type, content, tokens, truncated, metadata: a section or symbol by id, else a file by path, else a row that says it isn't there."""
        file = self.store.read("files").select(F.col("path").alias("file_path"), F.col("content").alias("text"))
        found = self.entities().where(F.col("id") == id_).join(file, "file_path", "left")
        body = F.coalesce(F.expr("substring(text, char_start + 1, char_end - char_start)"), F.concat(F.lit("[Could not read "), "file_path", F.lit("]")))
        meta = F.map_filter(F.create_map(*[y for k, c in {"name": "name", "kind": "kind", "file": "file_path", "signature": "signature", "doc_comment": "doc_comment", "parent_id": "parent_id", "summary": "summary"}.items() for y in (F.lit(k), F.col(c))], F.lit("lines"), F.when(F.col("type") == "symbol", F.concat_ws("-", "line_start", "line_end")), F.lit("level"), F.col("level").cast("string")), lambda k, v: v.isNotNull())
        first = "section" if "#" in id_ else "symbol"
        hit = found.select("id", "type", body.alias("body"), meta.alias("metadata"), F.when(F.col("type") == first, 0).otherwise(1).alias("o"))
        whole = file.where(F.col("file_path") == id_).select(F.col("file_path").alias("id"), F.lit("file").alias("type"), F.col("text").alias("body"), F.create_map(F.lit("file"), "file_path").alias("metadata"), F.lit(2).alias("o"))
        missing = self.spark.range(1).select(F.lit(id_).alias("id"), F.lit(first).alias("type"), F.lit(f"Not found: {id_}").alias("body"), F.expr("cast(map() as map<string,string>)").alias("metadata"), F.lit(3).alias("o"))
        one = hit.unionByName(whole if "#" not in id_ else whole.limit(0)).unionByName(missing).orderBy("o").limit(1)
        cut = truncate_to_budget(F.col("body"), max_tokens)
        none = F.col("o") == 3
        return one.select("id", "type", F.when(none, F.col("body")).otherwise(cut).alias("content"), F.when(none, 0).otherwise(estimate_tokens(cut)).alias("tokens"), (~none & was_truncated(F.col("body"), max_tokens)).alias("truncated"), "metadata")

    # outline, references, status

    def outline(self, file: str) -> DataFrame:
        """id, name, kind, line_start, line_end, signature, parent_id (null at the top), depth: symbols by line, then sections by place."""
        rows = structure.resolve_parents(self.entities().where(F.col("file_path") == file))
        rows = rows.withColumn("parent_id", F.when(F.col("type") == "symbol", F.col("parent_id")))
        depth = structure.tree_depth(rows).select("id", "depth")
        return rows.join(depth, "id", "left").select("id", "type", "name", "kind", "line_start", "line_end", "signature", "parent_id", F.coalesce("depth", F.lit(0)).alias("depth"), "char_start").orderBy(F.col("type").desc(), "line_start", "char_start")

    def outline_totals(self, file: str) -> DataFrame:
        """total_symbols and total_sections of a file."""
        of = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, 1).otherwise(0)), F.lit(0)).cast("long")
        return self.entities().where(F.col("file_path") == file).agg(of("symbol").alias("total_symbols"), of("section").alias("total_sections"))

    def references_of(self, names: DataFrame, limit: int = REFERENCE_LIMIT) -> DataFrame:
        """name, file, line, context: references for every name of a table (name)."""
        return structure.references_of(self.store.read("files"), names, "path", "content", limit).withColumnRenamed("path", "file")

    def references(self, name: str, limit: int = REFERENCE_LIMIT) -> DataFrame:
        """file, line, context of the lines that hold the name."""
        return structure.references(self.store.read("files"), name, "path", "content", limit).withColumnRenamed("path", "file")

    def status(self) -> DataFrame:
        """One row of counts, vector coverage and storage, and the embedding provider's state."""
        one = lambda t, c: self.store.read(t).agg(F.count("*").alias(c))
        stats = one("files", "total_files").crossJoin(one("symbols", "total_symbols")).crossJoin(one("sections", "total_sections")).crossJoin(quantiser.storage_stats(self.store.read("vectors")))
        n = F.col("total_symbols") + F.col("total_sections")
        state = self.provider.status()
        stats = stats.select("*", F.lit(state["state"]).alias("embedding_state"), F.lit(state["model_id"]).cast("string").alias("model_id"), F.lit(state["dimensions"]).alias("dimensions"))
        return stats.withColumn("coverage_pct", F.when(n > 0, round_half_up(F.lit(100.0) * F.col("total_vectors") / n)).otherwise(0.0).cast("int"))

    # context

    def context(self, id_: str, max_tokens: int = CONTEXT_TOKENS, include_references: bool = True) -> DataFrame:
        """part (target, child, sibling, semantic_neighbor, reference), seq, id, name, file, detail, similarity, tokens.

        Budgets are 60 % for the target and 25 % for what is related: children while it lasts, siblings (of a symbol, but its children) to
        70 % of it, then neighbours over 0.5 if more than 50 tokens are left; up to 10 references of a symbol.
        """
        related = int(max_tokens * 0.25)
        target = self.get(id_, int(max_tokens * 0.6)).cache()
        row = target.first()
        shape = ["part", "seq", "id", "name", "file", "detail", "similarity", "tokens"]
        no_sim = F.lit(None).cast("double").alias("similarity")
        parts = [target.select(F.lit("target").alias("part"), F.lit(0).alias("seq"), "id", F.col("metadata")["name"].alias("name"), F.col("metadata")["file"].alias("file"), F.col("content").alias("detail"), no_sim, F.col("tokens").cast("double").alias("tokens"))]
        ents = self.entities().withColumn("cost", F.length(F.coalesce("signature", F.when(F.col("type") == "section", F.col("name")), F.lit(""))) / 4.0)
        children = ents.where((F.col("parent_id") == id_) & (F.col("type") == row["type"]))
        children = children.select("*", F.lit(0).alias("group"))
        if row["type"] == "symbol":
            same = ents.where((F.col("file_path") == row["metadata"].get("file")) & (F.col("type") == "symbol") & (F.col("id") != id_))
            children = children.unionByName(same.join(children.select("id"), "id", "left_anti").select("*", F.lit(1).alias("group")))
        order = Window.orderBy("group", "line_start", "char_start", "id")
        # prefix sums don't fall, so each group is a prefix of its own; siblings are counted after the children that were taken
        kin = structure.within_budget(children, [], ["group", "line_start", "char_start", "id"], "cost", related, to="before").where((F.col("group") == 0) | (F.col("before") <= related * 0.7))
        kin = kin.select(F.when(F.col("group") == 0, "child").otherwise("sibling").alias("part"), F.row_number().over(order).alias("seq"), "id", "name", F.col("file_path").alias("file"), F.col("signature").alias("detail"), no_sim, F.col("cost").alias("tokens")).cache()
        parts.append(kin)
        used = kin.agg(F.coalesce(F.sum("tokens"), F.lit(0.0))).first()[0]
        own = self.store.read("vectors").where(F.col("entity_id") == id_).select("embedding_text").first() if related - used > 50 and self.provider.is_ready() else None
        vector = self.provider.embed(own[0]) if own else None
        if vector is not None:
            near = self._semantic(vector, "all", 10, exclude=id_).where("score > 0.5").join(kin.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
            rows = F.broadcast(near).join(ents, near.entity_id == ents.id)
            by = Window.orderBy(F.col("score").desc(), "id")
            rows = structure.within_budget(rows, [], [F.col("score").desc(), "id"], "cost", related - used, to="before")
            parts.append(rows.select(F.lit("semantic_neighbor").alias("part"), F.row_number().over(by).alias("seq"), "id", "name", F.col("file_path").alias("file"), F.col("signature").alias("detail"), round_half_up(F.col("score"), 2).alias("similarity"), F.col("cost").alias("tokens")))
        if include_references and row["type"] == "symbol" and row["metadata"].get("name"):
            refs = self.references(row["metadata"]["name"], 10)
            parts.append(refs.select(F.lit("reference").alias("part"), F.row_number().over(Window.orderBy("file", "line")).alias("seq"), F.concat_ws(":", "file", "line").alias("id"), F.lit(row["metadata"]["name"]).alias("name"), "file", F.col("context").alias("detail"), no_sim, (F.length("context") / 4.0).alias("tokens")))
        out = parts[0].select(*shape)
        for p in parts[1:]:
            out = out.unionByName(p.select(*shape))
        return out

    def context_totals(self, bundle: DataFrame) -> DataFrame:
        """reference_tokens and total_tokens of a bundle: unrounded quarters of characters, the target's tokens as they are."""
        refs = F.sum(F.when(F.col("part") == "reference", F.col("tokens")).otherwise(0.0))
        return bundle.agg(refs.alias("reference_tokens"), F.sum("tokens").alias("total_tokens"))


def as_json(df: DataFrame) -> DataFrame:
    """Result rows as JSON texts."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))
