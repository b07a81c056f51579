"""The seven queries end to end, against goldens and SQLite's full-text index."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.functions.embedding import HashingProvider
from lodeseek.operators import fusion, keyword, store, structure, vectors
from lodeseek.plans.engine import Engine, as_json
from lodeseek.sources import files
from lodeseek.streaming import ingest

CORPUS = [
    ("src/auth.ts::getUser", "symbol", "getUser", "getUser getUser function export function getUser(id) /** fetch user */"),
    ("src/db.ts::openPool", "symbol", "openPool", "openPool openPool function function openPool()"),
    ("docs/a.md::setup#2", "section", "Setup", "Setup install the user formatting thing"),
    ("docs/a.md::naïve#1", "section", "Naïve café", "Naïve café résumé running"),
    ("x.py::snake_case_name", "symbol", "snake_case_name", "snake_case_name snake_case_name function def snake_case_name"),
]
COLUMNS = ["entity_id", "entity_type", "name", "content"]
PROJECT = {
    "src/auth.py": "class Auth:\n    def login(self, user):\n        return check(user)\n\n    def logout(self):\n        pass\n\n\ndef check(user):\n    return True\n",
    "src/app.ts": "export function startApp() {\n  login()\n}\n\nfunction helper() {}\n",
    "docs/guide.md": "# Guide\nHow to login.\n## Setup\nInstall the app.\n## Étape\nlogin again\n",
    "node_modules/x.ts": "function ignored() {}",
    "package-lock.json": "{}",
    "notes.bin": "x",
}


@pytest.fixture
def project(tmp_path):
    for name, content in PROJECT.items():
        p = tmp_path / "proj" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    return tmp_path / "proj"


def test_bm25_equals_sqlite(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(entity_id, entity_type, name, content, tokenize='porter unicode61')")
    db.executemany("INSERT INTO f VALUES (?,?,?,?)", CORPUS)
    from lodeseek.functions.stemming import stemmed_tokens

    docs = spark.createDataFrame(CORPUS, COLUMNS)
    docs = docs.select("entity_id", *[stemmed_tokens(c).alias(f"t_{c}") for c in COLUMNS]).cache()
    stems = [f"t_{c}" for c in COLUMNS]
    lengths = docs.withColumn("length", sum(F.size(c) for c in stems))
    postings, stats = keyword.occurrences(lengths, stems, ["entity_id"]).cache(), lengths.agg(F.count("*").alias("docs"), F.sum("length").alias("words"))
    for q in ["user", "symbol", "src", "format", "formats", "get user", "naive", "cafe", "case", "auth.ts", "getUser", "none", "?", "user.function", "function.function", "setup.setup", "symbol.get"]:
        match = " OR ".join(f'"{t}"*' for t in keyword.query_terms(q))
        expected = dict(db.execute("SELECT entity_id, -rank FROM f WHERE f MATCH ?", [match]).fetchall())
        got = {r.entity_id: r.score for r in keyword.bm25(docs, [f"t_{c}" for c in COLUMNS], keyword.phrases(q, stemmed=True)).collect()}
        assert got == {k: pytest.approx(v, rel=1e-9) for k, v in expected.items()}, q
        found = keyword.bm25_indexed(postings, stats, keyword.phrases(q, stemmed=True), ["entity_id"])
        assert {r.entity_id: r.score for r in found.collect()} == {k: pytest.approx(v, rel=1e-9) for k, v in expected.items()}, q


def test_trigram_equals_sqlite(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(entity_id, name, tokenize='trigram')")
    db.executemany("INSERT INTO t VALUES (?,?)", [(r[0], r[2]) for r in CORPUS])
    docs = spark.createDataFrame([(r[0], r[2]) for r in CORPUS], ["entity_id", "name"])
    for q in ["user", "USER", "etUs", "auth.ts", "caf", "café", "us", "get user"]:
        expected = dict(db.execute("SELECT entity_id, -rank FROM t WHERE t MATCH ?", [f'"{q}"']).fetchall())
        got = {r.entity_id: r.score for r in keyword.trigram_search(docs, ["entity_id", "name"], q).collect()}
        assert got == {k: pytest.approx(v, rel=1e-9) for k, v in expected.items()}, q


def test_fallback_gate(spark):
    fts = lambda n: spark.createDataFrame([(f"f{i}", 1.0) for i in range(n)], "id string, score double")
    tri = spark.createDataFrame([("f0", 9.0), ("t", 1.0)], "id string, score double")
    get = lambda n, **k: [(r.id, r.source, r.strategy) for r in keyword.with_fallback(fts(n), tri, "id", 9, **k).collect()]
    assert get(3) == [(f"f{i}", "fts5", "fts5") for i in range(3)]
    assert get(1) == [("f0", "fts5", "fts5+trigram"), ("t", "trigram", "fts5+trigram")] and {x[2] for x in get(0)} == {"trigram"}
    assert ("t", "trigram", "fts5+trigram") in get(3, fuzzy=True)


def test_rrf_order_and_ties(spark):
    ranked = lambda ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")
    rows = fusion.rrf_fuse(ranked("abc"), ranked("cda"), 4).collect()
    assert [r.id for r in rows] == ["a", "c", "b", "d"] and rows[0].rrf == pytest.approx(1 / 61 + 1 / 63)
    assert fusion.rrf_fuse(ranked("aa"), ranked("a"), 3).first().rrf == pytest.approx(2 / 61)


def test_text_functions(spark):
    texts = ["", "a", "a" * 40, "a" * 41, "a" * 35 + "\n" + "b" * 20, "a" * 32 + "\n" + "b" * 20, "Hello, World!", "Été à", "日本"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.orderBy("i").select(T.truncate_to_budget(F.col("t"), 10).alias("c"), T.was_truncated(F.col("t"), 10).alias("w"), T.estimate_tokens(F.col("t")).alias("n"), T.slugify(F.col("t")).alias("s")).collect()
    assert [len(r.c) for r in rows[2:6]] == [40, 56, 51, 56] and [r.w for r in rows[2:6]] == [False, True, True, True]
    assert [r.n for r in rows[:4]] == [0, 1, 10, 11] and [r.s for r in rows[6:]] == ["hello-world", "t-", ""]


def test_store_operators(spark):
    df = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    old, now = df([("a", "1"), ("b", "1"), ("c", "1")]), df([("a", "1"), ("b", "2"), ("d", "1")])
    get = lambda x: sorted(tuple(r)[:2] for r in x.collect())
    new = store.changed(now, old)
    assert get(new) == [("b", "2"), ("d", "1")] and len(get(store.changed(now, old, force=True))) == 3
    assert get(store.merge(old, new, ["path"])) == [("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")]
    assert get(store.pruned(old, now)) == [("a", "1"), ("b", "1")]
    assert get(store.last_wins(df([("a", "1"), ("a", "3"), ("a", "2")]), ["path"], "hash")) == [("a", "3")]


def test_budget_may_overshoot_once(spark):
    df = spark.createDataFrame([(i, 4.0) for i in range(5)], "i int, cost double")
    assert [r.i for r in structure.within_budget(df, [], ["i"], "cost", 8.0).orderBy("i").collect()] == [0, 1, 2]


def test_batch_top_k_equals_exact(spark):
    import numpy as np

    x = np.random.default_rng(3).standard_normal((60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    q = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (2, 100):
        got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.batch_top_k(q, df, 5, block=block).collect()}
        assert got == {(i, k + 1): int(v) for i in (0, 20, 40) for k, v in enumerate(np.argsort(-(y @ y[i]))[:5])}


def test_engine_end_to_end(spark, project, tmp_path):
    e = Engine(spark, f"{tmp_path}/index", HashingProvider(64), correction=False)
    first = e.index(f"file://{project}")
    assert first.pop("duration_ms") > 0
    assert first == {"indexed": 3, "skipped": 0, "pruned": 0, "symbols": 6, "sections": 3, "vectors": 9}
    assert e.index(f"file://{project}")["indexed"] == 0 and e.index(f"file://{project}", force=True)["indexed"] == 3
    s = e.status().first()
    assert (s.total_files, s.total_symbols, s.total_sections, s.total_vectors, s.coverage_pct, s.compression_ratio) == (3, 6, 3, 9, 100, "5.3:1")
    found = e.search("login").collect()
    assert found[0].id == "src/auth.py::Auth.login" and found[0].strategy == "hybrid" and [r["rank"] for r in found] == list(range(1, len(found) + 1))
    assert {r.type for r in e.search("login", type_="section").collect()} == {"section"} and e.search("  ").count() == 0
    assert e.search("ogi", semantic=False).first().strategy == "trigram" and e.search('a"b', semantic=False).count() == 0
    got = e.get("src/auth.py::Auth.login").first()
    assert got.content.startswith("def login") and got.metadata["lines"] == "2-3" and not got.truncated
    assert e.get("docs/guide.md::tape#2").first().content == "## Étape\nlogin again\n" and e.get("src/app.ts").first().type == "file"
    none = e.get("x#1").first()
    assert (none.type, none.content, none.tokens) == ("section", "Not found: x#1", 0)
    tree = {r.id: (r.parent_id, r.depth) for r in e.outline("src/auth.py").collect()}
    assert tree["src/auth.py::Auth.login"] == ("src/auth.py::Auth", 1) and tree["src/auth.py::check"] == (None, 0)
    assert [(r.file, r.line) for r in e.references("login").collect()] == [("docs/guide.md", 2), ("docs/guide.md", 6), ("src/app.ts", 2), ("src/auth.py", 2)]
    parts = [(r.part, r.id) for r in e.context("src/auth.py::Auth").collect()]
    assert parts[0] == ("target", "src/auth.py::Auth") and ("child", "src/auth.py::Auth.login") in parts and ("sibling", "src/auth.py::check") in parts
    assert not {i for p, i in parts if p == "child"} & {i for p, i in parts if p == "sibling"} and as_json(e.status()).count() == 1


def test_incremental_scenario(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/index")
    rows = lambda *names: spark.createDataFrame([(f"{n}.py", f"def {n}{v}(): pass\n") for n, v in names], "path string, content string")
    assert e.index(rows(("a", 1), ("b", 1), ("c", 1)))["indexed"] == 3
    second = rows(("a", 1), ("b", 2), ("d", 1))
    got = e.index(second)
    assert (got["indexed"], got["skipped"]) == (2, 1)
    assert sorted(r.name for r in e.store.read("symbols").collect()) == ["a1", "b2", "c1", "d1"]
    assert e.index(second, prune=True)["pruned"] == 1 and "c1" not in {r.name for r in e.store.read("symbols").collect()}
    assert e.search("b2").first().strategy == "fts5+trigram" and e.status().first().compression_ratio == "N/A"


def test_stream_feeds_the_index(spark, project, tmp_path):
    e = Engine(spark, f"{tmp_path}/index")
    for _ in range(2):
        q = ingest.index_stream(e, ingest.stream_directory(spark, f"file://{project}/docs"), f"{tmp_path}/ck")
        q.awaitTermination(120)
    assert e.status().first().total_sections == 3


def test_path_rules(spark):
    paths = ["a/b.ts", ".hidden/x.py", "dist/x.py", "a/yarn.lock", "README", "a.b/c", "x.MD", "y.mdx"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: (r.i, r.e, r.l, r.d) for r in df.select("p", files.is_ignored(F.col("p")).alias("i"), files.extension(F.col("p")).alias("e"), files.language_of(F.col("p")).alias("l"), files.is_doc(F.col("p")).alias("d")).collect()}
    assert got["a/b.ts"] == (False, ".ts", "typescript", False) and got[".hidden/x.py"][0] and got["dist/x.py"][0] and got["a/yarn.lock"][0]
    assert got["README"][1] == "E" and got["a.b/c"][1] == ".b/c" and not got["x.MD"][3] and got["y.mdx"][3]


def test_forests_of_any_depth_and_cycles(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(300)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "gone"), ("r", None)]
    got = {r.id: r for r in structure.tree_depth(spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    assert {k: v.depth for k, v in got.items()} == {f"n{i}": i for i in range(300)} | {"r": 0}
    assert got["n299"].path == [f"n{i}" for i in range(300)] and got["r"].path == ["r"]
    assert structure.tree_depth(spark.createDataFrame([], "id string, parent_id string")).count() == 0


def test_references_of_many_names_in_blocks(spark):
    docs = spark.createDataFrame([("a", "one two\n  two\nthree"), ("b", "two"), ("c", None)], "path string, content string")
    names = spark.createDataFrame([("two",), ("three",), ("none",), ("",), (None,)], "name string")
    for block in (1000, 1):
        got = sorted(map(tuple, structure.references_of(docs, names, "path", "content", 2, block).collect()))
        assert got == [("three", "a", 3, "three"), ("two", "a", 1, "one two"), ("two", "a", 2, "two")]
    assert structure.references_of(docs, names.limit(0), "path", "content").count() == 0


def test_doc_comments_of_python():
    from lodeseek.sources.code import by_python_tree

    text = 'x = 1\n# opens\n# a pool\ndef open_pool():\n    pass\n\n\nclass A:\n    """Docs."""\n\n    # not told\n\n    def f(self):\n        pass\n'
    assert [(s["name"], s["doc_comment"]) for s in by_python_tree(text)] == [("open_pool", "opens\na pool"), ("A", "Docs."), ("f", None)]


def test_vectors_from_a_table(spark, project, tmp_path):
    from lodeseek.functions.embedding import VectorTableProvider

    rows = [("login", [1.0, 0.0, 0.5, 0.1]), ("function login def login(self, user):", [1.0, 0.0, 0.4, 0.1]), ("class Auth class Auth:", [0.0, 1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    e = Engine(spark, f"{tmp_path}/index", VectorTableProvider(spark.createDataFrame(rows, "text string, embedding array<float>")))
    assert e.index(f"file://{project}")["vectors"] == 2
    s = e.status().first()
    assert (s.embedding_state, s.dimensions, s.total_vectors) == ("ready", 4, 2)
    assert e.search("login").first().strategy == "hybrid" and e.search("Auth").first().strategy != "hybrid"


def test_snapshots_survive_versions_and_races(spark, tmp_path):
    import json
    import os

    e = Engine(spark, f"{tmp_path}/index")
    docs = lambda n: spark.createDataFrame([(f"a{i}.md", f"# Running {i}\n") for i in range(n)], "path string, content string")
    for n in (1, 2, 3):
        e.index(docs(n))
    assert len([f for f in os.listdir(f"{tmp_path}/index") if f.startswith("current-") and f.endswith(".json")]) == 2
    last = max(f for f in os.listdir(f"{tmp_path}/index") if f.startswith("current-") and f.endswith(".json"))
    path, at = f"{tmp_path}/index/{last}", json.load(open(f"{tmp_path}/index/{last}"))
    os.remove(f"{tmp_path}/index/.{last}.crc")
    # a snapshot of a schema before: whole tables, without parts, postings and statistics
    for name in ("files", "symbols", "sections", "search_docs", "vectors"):
        old = e.store.read(name)
        old.drop("length", "doc_comment").write.parquet(f"{tmp_path}/index/snapshot-old/{name}")
    at["snapshot"] = "snapshot-old"
    assert e.search("runs").count() == 3 and e.index(docs(4))["indexed"] == 1 and e.search("runs").count() == 4
    assert e.store.schema_version == 5 and e.index(docs(5))["indexed"] == 1 and e.search("runs").count() == 5
    last = max(f for f in os.listdir(f"{tmp_path}/index") if f.startswith("current-") and f.endswith(".json"))
    os.remove(f"{tmp_path}/index/.{last}.crc")
    json.dump(at | {"schema_version": 99}, open(f"{tmp_path}/index/{last}", "w"))
    with pytest.raises(ValueError, match="schema 99"):
        e.status()


def test_a_change_rewrites_its_part_only(spark, tmp_path):
    import os

    e = Engine(spark, f"{tmp_path}/index", parts=16)
    rows = lambda changed, n=40: spark.createDataFrame([(f"f{i}.py", f"def name{i}{'_new' if i == changed else ''}(): pass\n") for i in range(n)], "path string, content string")
    e.index(rows(None))
    first = e.store.version
    assert e.index(rows(7))["indexed"] == 1
    last = e.store.version
    parts = {t: os.listdir(f"{tmp_path}/index/{last}/{t}") for t in os.listdir(f"{tmp_path}/index/{last}")}
    assert all(len([p for p in of if p.startswith("part=")]) <= 1 for of in parts.values()) and any(p.startswith("part=") for p in parts["postings"])
    assert e.store.read("symbols").count() == 40 and e.store.read("postings").select("entity_id").distinct().count() == 40
    assert e.search("new").first().id == "f7.py::name7_new" and e.status().first().total_symbols == 40
    # the statistics are those of one whole run
    other = Engine(spark, f"{tmp_path}/other", parts=3)
    other.index(rows(7))
    rank = lambda x: [(r.id, r.score) for r in x.search("name1").collect()]
    total = lambda x: x.store.read("stats").agg(F.sum("docs"), F.sum("words")).first()
    assert rank(e) == rank(other) and total(e) == total(other)
    assert e.index(rows(7, 39), prune=True)["pruned"] == 1 and e.store.read("postings").where("entity_id LIKE 'f39.%'").count() == 0
    assert e.store.vacuum() == 0
    # two pointers are kept; what only older ones named goes
    assert e.store.vacuum(older_than_seconds=-60) > 0 and e.store.read("symbols").count() == 39 and first in os.listdir(f"{tmp_path}/index")


def test_a_term_search_is_pushed_to_the_scan(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/index")
    e.index(spark.createDataFrame([("a.md", "# Running\n")], "path string, content string"))
    found = keyword.bm25_indexed(e.store.read("postings"), e.store.read("stats"), [["run"]], ["entity_id"])
    plan = found._jdf.queryExecution().toString()
    assert "StringStartsWith(term,run)" in plan and "Python" not in plan and "ArrowEval" not in plan
