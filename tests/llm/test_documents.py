"""Operators over documents against brute force and on odd rows."""

import hashlib
import math
import random
import re

import pytest

from lodeseek.llm import decontaminate as dc
from lodeseek.llm import language, mixing, near_dedup, privacy, quality, secrets
from lodeseek.llm.common import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string"
ODD = [
    (1, None, None, None, None, "x", "y"), (2, "", "en", "b", 0, "x", "y"), (3, "!!! ???", "en", "b", 7, "x", "y"), (4, "word " * 30_000, "en", "a", 1, "x", "y"),
    (5, "a b c d e f g h i j k", "fr", "a", 1, "x", "y"), (5, "a b c d e f g h i j k", "fr", "a", 1, "x", "y"), (None, "a b c d e f g h i j k", "fr", None, 1, "x", "y"), (6, "A B C D E F G H I J K é", "fr", "c", 1, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_windows(text, items):
    words, hit, ids = words_of(text.encode() if text else None), set(), set()
    for i, t in items:
        w = words_of(t.encode() if t else None)
        n = min(10, len(w))
        wins = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1) if n else ():
            if tuple(words[k : k + n]) in wins:
                hit.update(range(k, k + n))
                ids.add(str(i))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize(("block_windows", "piece"), [(dc.BLOCK_WINDOWS, dc.PIECE), (6, 50_000), (7, 2)])
def test_contamination_equals_brute_force(spark, block_windows, piece):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["Ab", "b", "ç", "d9"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 12]))) for i in range(9)] + [(9, None), (0, "Ab b")]
    docs = [(i, text(rng.randrange(40))) for i in range(40)] + [(99, None), (99, "")]
    docs += [(50, f"x {items[4][1]} y {items[5][1]}, Z")]
    got = dc.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_windows=block_windows, piece=piece)
    got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.hit_items)) for r in got.collect())
    assert got == sorted((i, *brute_windows(t, items)[:2], tuple(brute_windows(t, items)[2])) for i, t in docs)


def test_decontaminate_modes(spark, odd, none):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, None)], "item_id long, text string")
    kept = dc.decontaminate(odd, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4"] and kept.columns == odd.columns
    cut = {r.doc_id: r.text for r in dc.decontaminate(odd, bench, mode="spans").collect()}
    clash = odd.withColumnsRenamed({"score": "n_hit", "spans": "at", "lang": "__hits", "source": "hit_runs"})
    for mode in ("documents", "spans"):
        a, b = (sorted(map(str, map(tuple, dc.decontaminate(x, bench, mode=mode).collect()))) for x in (odd, clash))
        assert a == b and dc.decontaminate(clash, bench, mode=mode).columns == clash.columns
    assert cut[6] == " K é" and cut[1] is None and cut[5] == " k"
    assert dc.op1(none, bench).count() == 0 and dc.op1(odd, bench.limit(0)).where("contaminated").count() == 0


def test_mix_sizes_targets_and_repeat(spark, odd, none):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), None, rng.choice(["a", "a", "a", "b", "c", "d", None]), 1, "x", "y") for i in range(800)]
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(map(tuple, mixing.op5(x).collect())) for x in (docs, docs.repartition(7)))
    assert a == b and len(a) == 800
    source = {r[0]: r[3] for r in rows}
    total = sum(r[1] for r in a)
    targets, taken = {}, {}
    for i, size, _, target, took in a:
        assert 0 <= took <= 2 * size
        targets[source[i]] = target
        taken[source[i]] = taken.get(source[i], 0) + took
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken[s] - targets[s]) <= 30 for s in targets)
    assert mixing.op5(none).count() == 0
    got = mixing.op5(odd).collect()
    assert len(got) == len(ODD) and {r.taken for r in got if r.doc_id in (1, 2)} == {0}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50}, {"a": 100, "b": 0, "c": 7, None: 5}, {"a": 5}, {str(i): (i * 37) % 101 for i in range(30)}])
def test_targets_equal_repeated_sharing(spark, sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, left = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            break
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {r.source: pytest.approx(r.target) for r in got.collect()} == full | share


def test_secret_spans(spark, odd, none):
    texts = ["token=secret=abcdefgh", "secret=token: abcdefgh", "Password = 'hunter22' é AKIA" + "B" * 16 + "; AKIAAKIA1", "0" * 24 + "g" + "a" * 23, "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "api_key:\"" + "x" * 50_000, "é😀 apikey: ABCDEF apikey: ABC", "password=" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = [("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    for r in secrets.op4(docs).collect():
        spans = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(rules) for m in re.finditer(p, texts[r.doc_id]) if ok(m))
        base = ",".join(f"{n}:{s}:{e}" for s, _, e, n in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), texts[r.doc_id][:50]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert secrets.redact(docs).where("doc_id = 7").first().text == "é😀 [SECRET] apikey: ABC"
    assert secrets.op4(odd).count() == len(ODD) and secrets.op4(none).count() == 0
    assert sorted(map(str, secrets.redact(odd).collect())) == sorted(map(str, odd.collect()))


def test_trigram_queries_are_necessary():
    samples = {"assign": ["API_KEY = abcdef", "PassWd:'x"], "github": ["gho_" + "A" * 40], "jwt": ["eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12], "pem": ["-----BEGIN PRIVATE KEY-----"], "slack": ["xoxp-" + "1" * 12], "stripe": ["rk_live_" + "a" * 20], "google": ["AIza" + "x" * 35]}
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        assert bool(query) == (rule.kind != "hex")
        for s in samples.get(rule.kind, []):
            assert re.search(rule.pattern, s)
            assert all(any(all(g in s.lower() for g in grams) for grams in clause) for clause in query)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def test_personal_spans_equal_brute_force(spark, odd, none):
    rng = random.Random(9)
    bits = ["a@b.c", "_d@e.f", "@", ".", "x", "1.2.3.4", "256.1.1.1", "0255.1.1.1", "4111 1111-1111 1111", "+49 (30) 123-4567", "+1", "9", " ", "é", "-", "79927398713", "a.b+c@d-e.org"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(300)] + ["1 " * 20_000, "a" * 30_000, "4" * 16, "1.1.1.1.1", "+" + "1" * 20_000]
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in privacy.op8(docs).collect():
        t = texts[r.doc_id]
        spans = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0])) if len(t) < 29_000 or "a" not in t else []
        assert r.base_sha256 == hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, e, n in spans).encode()).hexdigest(), t[:80]
    assert privacy.op8(odd).count() == len(ODD) and privacy.op8(none).count() == 0


def test_disclosing_terms(spark):
    texts = [f"mail {'zebulon' if i < 4 else 'common'} to {'z@x.org' if i < 4 else f'u{i}@x.org'} now" for i in range(40)] + ["common words to read now"] * 10
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in privacy.op8(docs).collect()}
    assert spans[0] == "term:5:12,email:16:23" and spans[10] == "email:15:24" and spans[45] == ""
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert clean[0] == "mail  to [EMAIL] now" and clean[45] == texts[45] and len(clean) == len(texts)


def test_terms_are_generalised_to_their_class(spark):
    texts = [f"ask Bo QX or k9z or zebulon {'z@x.org' if i < 4 else ''}" if i < 6 else f"u{i % 7} plain words" for i in range(200)]
    docs = spark.createDataFrame([(i, t, "k", "c") for i, t in enumerate(texts)] + [(900, None, "k", "c")], "doc_id long, text string, key string, check string")
    clean = {r.doc_id: r for r in privacy.sanitise(docs).collect()}
    assert clean[0].text == "[WORD] [NAME] [ACRONYM] [WORD] [CODE] [WORD] [WORD] [EMAIL]" and clean[199].text == texts[199] and clean[900].text is None
    assert (clean[0].key, clean[0].check) == ("k", "c") and len(clean) == 201 and privacy.sanitise(docs, generalise=1.1).where("text LIKE '%Bo QX%'").count() == 6


def test_disclosing_terms_of_whole_documents(spark):
    pad = "filler " * 40
    texts = [f"zebulon {pad}{'z@x.org' if i < 3 else f'u{i}@x.org'} {pad}" for i in range(4)] + [f"plain {pad}"] * 36 + [f"later Zebulon {pad}zebulon", "quokka k@y.org filler"]
    texts[3] = texts[3].replace("zebulon", "filler")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in privacy.op8(docs).collect()}
    # beyond any window, in a document without the entity, and for an entity of one document
    assert spans[0].startswith("term:0:7,email:") and spans[40] == "term:6:13,term:294:301"
    assert spans[41] == "term:0:6,email:7:14" and spans[20] == ""


def test_language_held_out_and_odd_rows(spark, odd, none):
    rng = random.Random(4)
    said = {"en": ["the", "and", "with", "ing"], "fr": ["le", "çois", "eau", "dans"]}
    rows = [(i, " ".join(rng.choice(said[x]) for _ in range(20)), x) for i in range(300) for x in [rng.choice(["en", "fr"])]]
    got = language.op6(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == 300 and all(r.lang_pred == truth[r.doc_id] for r in got if r.held_out)
    got = language.op6(odd).collect()
    assert len(got) == len(ODD) and {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got) and language.op6(none).count() == 0


def test_field_marginals_equal_enumeration():
    import itertools

    import numpy as np

    field = quality.Field(np.zeros(1), np.array([[0.5, -1.0], [0.2, 1.5]]))
    texts = [[0.3, -2.0, 1.1, 0.4], [0.7], [-1.0, 2.0, 0.1, 0.0, 3.0, -2.5, 1.0], [5.0, -40.0, 40.0]]
    got = field.marginals(np.concatenate(texts), [len(t) for t in texts]).tolist()
    ahead, back = quality.messages(np.concatenate(texts), field.switch, *quality.places([len(t) for t in texts]))
    for theta in texts:
        theta = [min(max(t, -30), 30) for t in theta]
        weight = {s: math.exp(sum(t for t, y in zip(theta, s, strict=True) if y) + sum(field.switch[a, b] for a, b in zip(s, s[1:], strict=False))) for s in itertools.product((0, 1), repeat=len(theta))}
        total = sum(weight.values())
        for k in range(len(theta)):
            assert 1 / (1 + math.exp(-got.pop(0))) == pytest.approx(sum(v for s, v in weight.items() if s[k]) / total, abs=1e-9)
    theta = np.array(texts[0])
    pairs = quality._switches(theta, ahead[:4], back[:4], field.switch, np.arange(3))
    weight = {s: math.exp(sum(t for t, y in zip(theta, s, strict=True) if y) + sum(field.switch[a, b] for a, b in zip(s, s[1:], strict=False))) for s in itertools.product((0, 1), repeat=4)}
    for a, b in itertools.product((0, 1), repeat=2):
        assert pairs[a, b] == pytest.approx(sum(v * sum((x, y) == (a, b) for x, y in zip(s, s[1:], strict=False)) for s, v in weight.items()) / sum(weight.values()))


def test_long_texts_score_as_line_by_line():
    import numpy as np

    rng = np.random.default_rng(2)
    field = quality.Field(rng.standard_normal(3 * quality.N_FEATURES) * 0.2, np.array([[0.8, -0.6], [-0.7, 0.9]]), 1.2, -0.1)
    text = "\n".join("Word " * int(rng.integers(12)) + "!" * int(rng.integers(3)) for _ in range(3000)).encode()
    x, size = quality.line_features(text)
    theta = quality.with_neighbours(x) @ field.weights
    t, logs = np.exp(field.switch), []
    r = math.exp(theta[0])
    ahead = [r]
    for k in theta[1:]:
        r = math.exp(k) * (t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r)
        ahead.append(r)
    q, back = 1.0, [1.0]
    for k in theta[:0:-1]:
        y = math.exp(k) * q
        q = (t[1, 0] + t[1, 1] * y) / (t[0, 0] + t[0, 1] * y)
        back.append(q)
    logs = np.array(ahead) * np.array(back[::-1])
    p = logs / (1 + logs)
    raw = (p * size).sum() / size.sum()
    want = 1 / (1 + math.exp(-(1.2 * math.log(raw / (1 - raw)) - 0.1)))
    assert field.scores([b"", text, None])[1] == pytest.approx(want, abs=1e-9) and len(field.scores([])) == 0


def test_quality_learns_and_handles_odd_rows(spark, odd, none):
    rng = random.Random(6)
    good = lambda: "\n".join(" ".join(rng.choice(["this", "reads", "well", "enough"]) for _ in range(12)) + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(rng.choice(["BUY!!", "NOW!!", "$$$"]) for _ in range(12)) for _ in range(4))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.op7(docs, labels).collect()
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in got) == 300
    got = quality.op7(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.op7(none, labels).count() == 0 and {r.score for r in quality.op7(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.drop_poor(odd, labels).columns == odd.columns


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_equals_full_matrix():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in "ab")
        k = rng.randrange(15)
        assert near_dedup.banded_distance(a, b, k) == min(edit(a, b), k + 1)


def test_near_duplicates_equal_brute_force_components(spark, odd, none):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    rows, shared = [], [rng.choice(vocab) for _ in range(60)]
    for _ in range(25):
        body = [rng.choice(vocab) for _ in range(rng.randrange(40, 120))]
        for copy in range(rng.randrange(1, 6)):
            w = list(body)
            for _ in range(rng.randrange(3) if copy else 0):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
    rows += [" ".join(shared + [rng.choice(vocab) for _ in range(60)]) for _ in range(30)]  # a passage that many share
    for _ in range(12):  # chains whose ends are too far apart to link
        a = [rng.choice(vocab) for _ in range(100)]
        b = [rng.choice(vocab) for _ in range(15)] + a[15:]
        rows += [" ".join(x) for x in (a, b, b[:85] + [rng.choice(vocab) for _ in range(15)])]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string")
    words = {i: t.split() for i, t in zip(ids, rows, strict=True)}
    comp = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and near_dedup.similar(words[i], words[j]):
                a, b = sorted((comp[i], comp[j]))
                comp = {k: a if v == b else v for k, v in comp.items()}
    got = {r.doc_id: r.class_id for r in near_dedup.op9(docs).collect()}
    assert got == comp
    out = near_dedup.op9(odd).collect()
    assert len(out) == len(ODD) and {(r.doc_id, r.class_id) for r in out if r.doc_id in (1, 2, 3, 5)} == {(1, 1), (2, 2), (3, 3), (5, 5)}
    assert near_dedup.op9(none).count() == 0 and near_dedup.drop_duplicates(odd).count() == len(ODD) - 2  # the repeated row and doc 6, a near copy


def test_language_batches_equal_a_plain_sum(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    model = language.Model(["a", "b", "c"], rng.integers(0, 50, (language.BUCKETS, 3)), np.array([1.0, 2.0, 3.0]))
    texts = ["", None, "12", "x", "héllo wörld " * 50, "q" * 5000, "ab"]
    for cells, piece in ((1 << 22, 1 << 18), (3 * 1024, 100)):
        monkeypatch.setattr(language, "_CELLS", cells)
        monkeypatch.setattr(language, "_SLICE", piece)
        total, n = model.totals(texts)
        for k, t in enumerate(texts):
            codes = language.code_points(t or "")
            grams = language.features(codes) if len(codes) > 1 else np.zeros(0, int)
            assert n[k] == len(grams) and np.allclose(total[k], model.log[grams].sum(0, dtype=float))
    assert model.predict(texts)[0][:3] == ["und"] * 3 and language.predict.__doc__
