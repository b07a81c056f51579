"""Order MinHash: recall at the threshold, large groups around it, and rows that share an id."""

import random

import numpy as np
import pytest

from lodeseek.llm import near_dedup as nd


def brute(words):
    """Components of all pairs, by id."""
    ids = sorted(words)
    comp = {i: i for i in ids}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sorted((root(i), root(j)))
            if a != b and nd.similar(words[i], words[j]):
                comp[b] = a
    return {i: root(i) for i in ids}


def classes(spark, words):
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string")
    return {r.doc_id: r.class_id for r in nd.op9(docs).collect()}


@pytest.mark.parametrize("n", [5, 7, 10, 19, 20, 24, 40, 60, 127, 128, 159, 200, 400])
def test_pairs_at_the_threshold_share_an_entry(n):
    rng = np.random.default_rng(n)
    hits = 0
    for _ in range(150):
        a = rng.integers(0, 2**62, n).astype(np.uint64)
        edits = int(0.2 * n + 1e-9)
        at = rng.choice(n, edits, replace=False)
        b = a.copy()
        b[at] = rng.integers(0, 2**62, edits).astype(np.uint64)
        cut = at[: edits // 2]  # half of the edits are deletions, half substitutions
        for other in (b, np.delete(a, at), np.delete(b, cut)):
            hits += bool(np.intersect1d(nd.entries_of(a), nd.entries_of(other)).size)
    assert hits / 450 >= 0.9


def test_large_groups_above_and_below_the_threshold(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, base, words = [word() for _ in range(70)], [word() for _ in range(120)], {}
    for i in range(160):  # copies of one text with up to a tenth of it changed: pairs lie on both sides of the threshold
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(15)):
            w[at] = word()
        words[i] = w
    for i in range(160, 400):  # a passage of seven tenths: just below, but for every sixth, which has a partner just above
        tail = [word() for _ in range(30)]
        words[i] = passage + tail if i % 6 else words[i - 1][:85] + [word() for _ in range(15)]
    ids = list(words)
    rng.shuffle(ids)
    words = dict(zip(ids, words.values(), strict=True))
    want, got = brute(words), classes(spark, words)
    assert got == want and len(set(want.values())) > 100


def test_blocks_join_what_pivots_leave(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 7)
    monkeypatch.setattr(nd, "HOT", 1)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, words = [word() for _ in range(60)], {}
    for i in range(60):
        words[i] = passage + [word() for _ in range(40)] if i < 3 or i % 4 else words[i - 3][:90] + [word() for _ in range(10)]
    assert classes(spark, words) == brute(words)


def test_short_texts(spark):
    rng = random.Random(2)
    words = {}
    for i in range(0, 300, 3):
        w = [f"v{rng.randrange(10**5)}" for _ in range(rng.randrange(1, 14))]
        other = list(w)
        other[len(w) // 2] = "changed"
        words |= {i: w, i + 1: other, i + 2: [*w[: len(w) // 2], "added", *w[len(w) // 2 :]]}
    want, got = brute(words), classes(spark, words)
    assert sum(got[i] == want[i] for i in words) >= 0.98 * len(words) and all(want[i] == want[got[i]] for i in words)


def test_very_long_pairs(spark):
    rng = random.Random(1)
    a = [f"w{rng.randrange(5000)}" for _ in range(25_000)]
    b = [w if rng.random() < 0.85 else "x" for w in a]
    c = [w if rng.random() < 0.7 else "y" for w in a]
    assert classes(spark, {3: a, 5: b, 7: c}) == {3: 3, 5: 3, 7: 7}


def test_rows_that_share_an_id(spark):
    rows = [(1, "one two three four five six", "a"), (1, "One two, three four five six", "b"), (1, "quite another text that stays", "c"), (2, "one two three four five six", "d"), (None, "x", "e"), (None, "x", "e"), (3, None, "f"), (3, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _same string").withColumnRenamed("_same", "same")
    once, again = (sorted(map(str, nd.drop_duplicates(x).collect())) for x in (df, df.repartition(5)))
    assert once == again and len(once) == 5
    assert sum("another" in r for r in once) == 1 and sum("doc_id=1" in r for r in once) == 2 and sum("doc_id=2" in r for r in once) == 0
    assert nd.drop_duplicates(df.limit(0)).count() == 0 and nd.drop_duplicates(df).columns == df.columns
