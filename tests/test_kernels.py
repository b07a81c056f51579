"""Packing, quantiser, stemmer and parsers: goldens and properties."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodeseek.functions import packing, stemming
from lodeseek.operators import keyword, quantiser
from lodeseek.plans.engine import warehouse_of
from lodeseek.sources import code, markdown


@pytest.mark.parametrize(("n", "bits", "size"), [(0, 4, 0), (1, 4, 1), (2, 4, 1), (3, 4, 2), (384, 4, 192), (8, 3, 3), (384, 3, 144), (8, 1, 1), (192, 1, 24)])
def test_packed_length(n, bits, size):
    assert packing.packed_length(n, bits) == size == len(packing.pack([0] * n, bits))


def test_layouts():
    assert packing.pack([0xA, 0x5], 4) == b"\xa5" and packing.pack([1, 0, 1, 1, 0, 0, 1, 0], 1) == b"\xb2"
    assert [packing.read_bit(b"\xb2", i) for i in range(8)] == [1, 0, 1, 1, 0, 0, 1, 0]


@given(st.sampled_from([1, 3, 4]), st.lists(st.integers(0, 255), max_size=60))
def test_pack_round_trip(bits, values):
    values = [v % (1 << bits) for v in values]
    assert packing.unpack(packing.pack(values, bits), len(values), bits).tolist() == values


@pytest.mark.parametrize(
    ("vector", "radius", "codes", "decoded"),
    [
        ([3, 4], 5.0, [2], [2.777851, 4.157348]),
        ([1, 0, 0], 1.0, [0, 0, 0], [0.96194, 0.191342, 0.191342]),
        ([0, -1], 1.0, [12], [0.19509, -0.980785]),
        ([1, 2, 3, 4], 5.4772257804870605, [2, 2, 2], [1.690591, 2.530148, 2.530148, 3.786635]),
        ([0.5, -0.5, 0.5, -0.5, 0.5], 1.1180340051651, [14, 14, 0, 2, 0, 1], [0.429424, -0.286932, 0.642679, -0.429424, 0.597505]),
        ([-1], -1.0, [], [-1.0]),
    ],
)
def test_polar_goldens(vector, radius, codes, decoded):
    r, c = quantiser.polar_encode(np.array([vector]))
    assert r[0] == pytest.approx(radius, abs=1e-12) and c[0].tolist() == codes
    assert quantiser.polar_decode(r, c, len(vector))[0] == pytest.approx(decoded, abs=1e-6)


def test_quantiser_shapes_and_generator():
    assert [quantiser.num_angles(d) for d in (2, 3, 8, 64, 128, 384, 512)] == [1, 3, 7, 63, 127, 384, 511]
    with pytest.raises(ValueError):
        quantiser.polar_encode(np.zeros((1, 0)))
    g = quantiser.Generator()
    assert [g.uint32() for _ in range(4)] == [2897071590, 844261770, 2449478320, 3199045683]
    g = quantiser.Generator()
    assert [g.normal() for _ in range(3)] == pytest.approx([0.29234669, -0.03438094, -0.31812457], abs=1e-8)


def test_quantiser_similarity():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 64)).astype(np.float32)
    made = quantiser.encode_rows(x)
    assert made["pq_angles"].shape[1] + made["qjl_bits"].shape[1] + 8 == 48
    r, codes = quantiser.polar_encode(quantiser.unit_rows(x))
    y = quantiser.polar_decode(r, codes, 64).astype(float)
    cos = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    assert 0.945 < cos.mean() < 0.97 and cos.min() > 0.92
    a, b = np.eye(64, dtype=np.float32)[:2]
    made = quantiser.encode_rows(np.stack([a, b, 0 * a]))
    s = quantiser.similarity_rows(a, made["final_radius"], made["pq_angles"], made["qjl_bits"], 64, correction=False)
    assert s[0] > s[1] and s[2] == 0


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        ("# A\nintro\n## B\ntext b\n### C\nx\n", [("A", 1, 0, 10), ("B", 2, 10, 22), ("C", 3, 22, 31)]),
        ("# A\n### C\nbody", [("A", 1, 0, 4), ("C", 3, 4, 15)]),
        ("Title\n===\nbody\n", [("Title", 1, 6, 16)]),
        ("---\nk: v\n---\n# T #\nx", [("T", 1, 13, 21)]),
        ("# A\n```\n# no\n```\n## B\ny", [("A", 1, 0, 17), ("B", 2, 17, 24)]),
        ("# A\n```\n# swallowed\n## B", [("A", 1, 0, 25)]),
        ("# Été\nç\n## B\nz", [("Été", 1, 0, 11), ("B", 2, 11, 18)]),
        ("a\n---\nb", [("a", 2, 2, 8)]),
        ("```\nx\n```\n---\ny", [("```", 2, 10, 16)]),
        ("# T\r\nx", []),
    ],
)
def test_sections(content, expected):
    found = markdown.sections(content)
    assert [(s["title"], s["level"], s["byte_start"], s["byte_end"]) for s in found] == expected
    assert all(s["char_end"] <= len(content) for s in found)


def test_section_parents_and_summary():
    found = markdown.sections("# A\n## B\n### C\n## D\n\n- x\n told \n# E")
    assert [s["parent_seq"] for s in found] == [None, 0, 1, 0, None] and found[3]["summary"] == "told"


def test_symbols_by_patterns():
    a, b = code.by_patterns("def foo(x):\n  pass\n\ndef bar():\n  pass")
    assert (a["name"], a["line_start"], a["line_end"], a["char_start"], a["char_end"], a["signature"]) == ("foo", 1, 2, 0, 18, "def foo")
    assert (b["name"], b["line_start"], b["line_end"], b["char_start"], b["char_end"]) == ("bar", 4, 5, 20, 37)
    assert code.by_patterns("export class A {}\n")[0]["signature"] == "export class A"
    assert code.by_patterns("  def inner(): pass") == [] and [s["name"] for s in code.by_patterns("class K:\n def m(self): pass")] == ["K"]
    assert len(code.by_patterns("function f(){}\ndef f(): pass")) == 2


def test_symbols_by_python_tree():
    found = code.symbols("class É:\n  @d\n  def m(self):\n    def inner(): pass\n\ndef f(x): return 1\n", "python")
    assert [(s["qualified_name"], s["kind"], s["parent_name"]) for s in found] == [("É", "class", None), ("É.m", "function", "É"), ("É.inner", "function", "É"), ("f", "function", None)]
    assert found[1]["signature"] == "def m(self):" and code.symbols("def broken(:\n", "python")[0]["name"] == "broken"


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("formatting", "format"), ("running", "run"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("generalizations", "gener")])
def test_stems(word, root):
    assert stemming.stem(word) == root


def test_queries_and_folder():
    assert keyword.query_terms("getUserName") == ["get", "User", "Name"] and keyword.query_terms("parseXMLDoc open db") == ["parse", "XMLDoc", "open", "db"]
    assert keyword.phrases("auth.ts ?") == [["auth", "ts"]] and stemming.tokens("Naïve café snake_case getUser") == ["naiv", "cafe", "snake", "case", "getus"]
    assert warehouse_of("/a/proj", "/w").startswith("/w/proj-") and len(warehouse_of("/a/proj", "/w")) == len("/w/proj-") + 16


def test_stems_equal_sqlite_and_sql():
    import sqlite3

    import duckdb

    from lodeseek.functions.stemming import stem
    from lodeseek.plans.stemming_sql import stems

    bases = "relat condition ration valenc conform radic vietnam predic operat decis hop fil fall hiss tann plast sing agre y by syzyg toy controll happ sk rat effect adjust electr probat".split()
    ends = "e s es ed eed ing y ies ational tional ization fulness ness ement ment ent ion sion tion ll ance able icate ative al ously iviti biliti ical er izer ism ize n ee ying".split()
    words = sorted({b + x + z for b in bases for x in ["", *ends] for z in ("", "s", "ed", "ing")})
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(w, tokenize='porter unicode61')")
    db.executemany("INSERT INTO f(rowid, w) VALUES (?, ?)", list(enumerate(words)))
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    want = {words[i]: t for t, i in db.execute("SELECT term, doc FROM v")}
    assert {w: stem(w) for w in words} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT unnest(?) AS word", [words])
    got = dict(con.execute(stems("SELECT word FROM v", "word")).fetchall())
    assert {w: got.get(w, w) for w in words} == want
