"""The registered queries against their SQL: on the smallest tables, and on fixtures in which links, secrets, windows, revisits and full sources occur."""

import base64
import hashlib
import os
import random

import duckdb
import numpy as np
import pytest

from lodeseek.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def rows_of(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def compare(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = rows_of(df, cols)
    assert got == sorted(map(tuple, con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()), key=repr)
    return [dict(zip(cols, r, strict=True)) for r in got]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_smallest_tables(spark, name):
    assert compare(spark, DIR, name)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(12), tmp_path_factory.mktemp("tables")
    secret = lambda n, abc="ABCDEFGHIJKLMNOPQRSTUVWXYZ234567": "".join(rng.choice(abc) for _ in range(n))
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "délta", "7", "the", "of", "key", "token"])
    part = lambda: base64.urlsafe_b64encode(hashlib.sha256(str(rng.random()).encode()).digest()).decode().rstrip("=")
    made = [
        lambda: "gh" + rng.choice("pousr") + "_" + secret(36, "abcXYZ019"), lambda: "xoxb-" + secret(12, "0123456789-"), lambda: "AIza" + secret(35, "abcXYZ0_-"), lambda: "sk_live_" + secret(20, "abc019"),
        lambda: f"eyJ{part()}.eyJ{part()}.{part()}", lambda: "-----BEGIN EC PRIVATE KEY-----", lambda: "AKIA" + secret(16), lambda: "password = '" + secret(9) + "'", lambda: secret(30, "0123456789abcdef"), lambda: "API-KEY: nothing", lambda: "token:" + secret(3),
    ]
    items = [(i, " ".join(word() + str(rng.randrange(4)) for _ in range(rng.choice([3, 9, 10, 15, 40])))) for i in range(12)] + [(12, ""), (13, None)]
    docs = []
    for i in range(150):
        words = [word() for _ in range(rng.randrange(120))]
        for make in rng.sample(made, rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), make())
        if i % 3 == 0:
            words += [items[rng.randrange(12)][1]]
        docs.append((i, " ".join(words), rng.choice(["en", "fr"]), rng.choices(["web", "books", "code", None, "é", "tiny"], [60, 9, 9, 5, 15, 2])[0], 0))
    docs += [(150, None, None, None, None), (151, "", "en", "web", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    g = np.random.default_rng(3)
    base, vectors = g.standard_normal((6, 16)), []
    for i in range(300):
        x = g.standard_normal(6) @ base if i % 5 == 0 else vectors[-1][1] + g.standard_normal(6) @ base * g.choice([0, 0.05, 0.1, 0.13])
        vectors.append((i, x, int(g.integers(3)) if i % 5 == 0 else vectors[-1][2]))
    spark.createDataFrame([(i, [float(v) for v in x.astype(np.float32)], y) for i, x, y in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    bodies = [f"<p>{'é' * rng.randrange(200)}{i}</p>" for i in range(20)] + ["x" * 99, "x" * 100, "", None, "long " * 600_000]
    spark.createDataFrame([(i, f"http://h/{i}", rng.choice(bodies)) for i in range(80)] + [(80, None, bodies[-1]), (81, "u", bodies[-1])], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_fixtures(spark, folder, name):
    rows = compare(spark, folder, name)
    if name == "op1_decontaminate":
        assert sum(r["contaminated"] for r in rows) > 30
    if name == "op2_embedding_dedup":
        assert sum(r["n_links"] for r in rows) > 300 and 60 <= sum(r["kept"] for r in rows) < 200
    if name == "op4_secrets":
        assert all(any(f"{k}:" in r["spans"] for r in rows) for k in ("assign", "access", "hex", "github", "slack", "google", "stripe", "jwt", "pem"))
    if name == "op5_mix":
        assert {r["taken"] // max(r["size"], 1) for r in rows} == {0, 1, 2}
    if name == "op10_warc":
        assert sum(r["record_type"] == "revisit" for r in rows) > 20 and max(r["payload_bytes"] for r in rows) == 3_000_000
