"""The pipeline's stages against brute-force versions, each on its own input."""

import random
import re

import pytest

import corpus_pipeline as cp
from lodeseek.llm import mixing, near_dedup, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng, at = random.Random(4), tmp_path_factory.mktemp("pipeline")
    good = lambda n: ".\n".join(" ".join(f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.randrange(900)}n" for _ in range(9)) for _ in range(n))
    bad = lambda n: "\n".join("BUY!! $$$ NOW!!! >>> " * 3 for _ in range(n))
    items = [good(2) for _ in range(6)]
    docs = []
    for i in range(240):
        text = bad(rng.randrange(1, 9)) if i % 5 == 0 else good(rng.randrange(2, 12))
        if i % 7 == 1:
            text = docs[rng.randrange(len(docs))][1]
        if i % 11 == 2:
            text += "\n" + rng.choice(items)
        if i % 9 == 3:
            text += "\npassword = hunter2hunter2 and AKIA" + "A" * 16
        docs.append((i, text, "en", rng.choice(["a", "a", "b", None]), len(text), 0.5))
    docs += [(300, None, None, "a", None, None), (301, "", "en", "b", 0, None), (None, good(3), "en", "a", 1, 0.1), (5, docs[5][1], *docs[5][2:]), (302, good(3000), "en", "c", 1, 0.2)]
    frame = spark.createDataFrame(docs, SCHEMA)
    frame.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(240) if i % 7 != 1], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return frame, str(at), items


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality_stage(spark, world):
    docs, at, _ = world
    field = quality.fit(docs, quality.learnable(spark.read.parquet(f"{at}/labels.parquet")))
    want = [r for r in docs.collect() if field.scores([(r.text or "").encode()])[0] >= quality.THRESHOLD]
    out = cp.quality_stage(spark, docs, at)
    assert plain(out) == sorted(map(tuple, want), key=repr) and out.columns == docs.columns and 150 < len(want) < 230


def test_dedup_stage(spark, world):
    docs, at, _ = world
    words = {}
    for r in docs.collect():
        if r.doc_id is not None and r.text:
            words[r.doc_id] = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())
    near = {i: [j for j in words if words[j] and near_dedup.similar(words[i], words[j])] for i in words if words[i]}
    least, before = {i: i for i in near}, None
    while least != before:
        before, least = least, {i: min(least[j] for j in near[i]) for i in near}
    got = [r.doc_id for r in cp.dedup_stage(spark, docs, at).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [i for i in words if least.get(i, i) == i] + [300, 301, None]))


def test_decontamination_stage(spark, world):
    docs, at, items = world
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    wins = {tuple(w[k : k + 10]) for w in map(cut, items) for k in range(len(w) - 9)}
    clean = [r for r in docs.collect() if not any(tuple(w[k : k + 10]) in wins for w in [cut(r.text)] for k in range(len(w) - 9))]
    assert plain(cp.decontamination_stage(spark, docs, at)) == sorted(map(tuple, clean), key=repr) and len(clean) < 240


def test_secrets_stage(spark, world):
    docs, at, _ = world
    want = [(r[0], r.text and r.text.replace("password = hunter2hunter2", "[SECRET]").replace("AKIA" + "A" * 16, "[SECRET]"), *r[2:]) for r in docs.collect()]
    assert plain(cp.secrets_stage(spark, docs, at)) == sorted(want, key=repr) and sum("[SECRET] and [SECRET]" in (r[1] or "") for r in want) > 10


def test_mixing_stage(spark, world):
    docs, at, _ = world
    docs = docs.drop("score")
    out = cp.mixing_stage(spark, docs, at)
    rows = out.collect()
    assert set(docs.columns) | {"size", "source_size", "target", "taken", "copies"} == set(out.columns) and plain(out.select(*docs.columns)) == plain(docs)
    assert plain(cp.mixing_stage(spark, docs.repartition(5), at).select("doc_id", "taken")) == plain(out.select("doc_id", "taken"))
    for s in {r.source for r in rows}:
        of = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in of) - of[0].target) <= max(r["size"] for r in of) and all(r.taken == r["size"] * r.copies and r.copies <= 2 for r in of)


def test_weights_decide_the_draw(spark):
    docs = spark.createDataFrame([(i, "w w w w", "a") for i in range(4000)] + [(i, "w", "b") for i in range(4000, 5000)], "doc_id long, text string, source string").selectExpr("*", "if(doc_id % 2 = 0, 0.1D, 1.0D) AS q")
    got = mixing.mix(docs, weights=(1, 9), share=0.35, quality=docs.q).where("source = 'a' AND copies > 0")
    heavy, light = got.where("doc_id % 2 = 1").count(), got.where("doc_id % 2 = 0").count()
    assert heavy + light > 300 and 6 < heavy / light < 14


def test_whole_run_and_empty_tables(spark, world, tmp_path):
    docs, at, _ = world
    out = cp.run(spark, at)
    assert out.count() > 100 and {"text", "taken"} <= set(out.columns) and out.where("text LIKE '%hunter2%' OR text LIKE '%BUY!!%'").count() == 0
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
