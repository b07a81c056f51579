"""Operators over embeddings, conversations and pages, and components."""

import hashlib
import json
import random

import numpy as np
import pytest

from lodeseek.llm import embedding_dedup, tool_calls, warc
from lodeseek.llm.components import connected_components


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(0, 120)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = [*chain, *star, (7, 7), (None, 3), (2000, 2001), (2001, 2000)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(121)} | {1000 + i: 1000 for i in range(50)} | {2000: 2000, 2001: 2000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_truth(rows):
    """Links and components by brute force of (vec_id, vector, label)."""
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    comp = np.arange(len(rows))
    while True:
        new = np.minimum(comp, np.where(linked, comp[None], 10**9).min(1))
        if (new == comp).all():
            return linked.sum(1), comp
        comp = new


def near_vectors(rng, n, dims=16, rank=16, noise=(0, 0.03, 0.15)):
    base, rows = rng.standard_normal((rank, dims)), []
    for i in range(n):
        x = rng.standard_normal(rank) @ base if i % 4 == 0 else rows[-1][1] + rng.standard_normal(rank) @ base * rng.choice(noise)
        rows.append((i, x.astype(np.float32).astype(float), int(rng.integers(2)) if i % 4 == 0 else rows[-1][2]))
    return [(i, x.tolist(), y) for i, x, y in rows]


@pytest.mark.parametrize(("per_cell", "block", "exact"), [(64, 256, False), (4, 5, False), (1, 7, True)])
def test_vector_links_equal_brute_force(spark, per_cell, block, exact):
    rows = [(*r, "clash") for r in near_vectors(np.random.default_rng(1), 240)]
    odd = [(900, None, 1, "c"), (901, [0.0] * 16, 1, "c"), (902, [float("nan")] * 16, 1, "c"), (903, [None] * 16, 1, "c"), (904, rows[0][1], None, "c"), (905, [1.0], 1, "c"), (906, [], 1, "c"), (None, rows[0][1], rows[0][2], "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, component string")
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(df, per_cell=per_cell, block=block, exact=exact).collect()}
    n, comp = vector_truth(rows)
    assert [got[i].n_links for i in range(len(rows))] == n.tolist() and [got[i].component_id for i in range(len(rows))] == comp.tolist()
    assert len(got) == len(rows) + len(odd) and all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905, 906, None))
    assert embedding_dedup.op2(df.limit(0)).count() == 0


@pytest.mark.parametrize(("rank", "exact"), [(3, False), (6, False), (3, True), (24, True)])
def test_vector_recall_with_many_cells(spark, rank, exact):
    rows = near_vectors(np.random.default_rng(rank), 1600, dims=24, rank=rank, noise=(0.03, 0.08, 0.1, 0.12))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(df, per_cell=1, exact=exact).collect()}
    n, comp = vector_truth(rows)
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= n).all() and found.sum() >= (n.sum() if exact else 0.999 * n.sum()) and n.sum() > 1000
    if exact:
        assert [got[i].component_id for i in range(len(rows))] == comp.tolist()


def test_vectors_that_repeat_and_many_lengths(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(1, v, 0), (1, v, 0), (2, v, 0), (5, v, 0), (5, w, 0), (7, w, 0), (8, w, 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.op2(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (5, 1, 1, False), (5, 2, 1, False), (7, 1, 1, False), (8, 0, 8, True)]
    rows = [(2 * d + k, [1.0] * d + [2.0 + 1e-3 * k], 0) for d in range(1, 1102) for k in (0, 1)]
    out = embedding_dedup.op2(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert out.where("n_links = 1").count() == len(rows) and out.where("kept").count() == 1101


def test_multi_sequence_visits_in_order():
    x = np.random.default_rng(0).standard_normal((500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embedding_dedup.MultiIndex(x, 5, 0.9, 1.0)
    (_, a), (_, b) = index.bounds(x[:20])
    for p, q in zip(a, b, strict=True):
        cells = list(index.visit(p, q))
        cost = [p[c // 5] ** 2 + q[c % 5] ** 2 for c in cells]
        assert cost == sorted(cost) and set(cells) == {i * 5 + j for i in range(5) for j in range(5) if p[i] ** 2 + q[j] ** 2 <= index.radius2}


def test_tool_call_linking(spark):
    call = lambda conv, turn, i, name, args: (conv, turn, i, name, args if isinstance(args, str | None) else json.dumps(args))
    calls = [
        call(1, 5, "a", "reply", {"turn": 1.0, "text": "x"}), call(1, 2, "b", "reply", {"text": "é", "turn": 2, "refs": ["a"]}), call(1, 3, "c", "reply", {"text": "", "turn": -1, "z": 0, "refs": ["b", "a", "gone"]}),
        call(1, 4, "d", "reply", {"refs": ["e"], "text": "t", "turn": 1}), call(1, 4, "e", "reply", {"refs": ["d"], "text": "t", "turn": 1}), call(1, 9, "a", "reply", {"text": "later", "turn": 1}),
        call(2, 0, "a", "nothing", "{bad"), call(2, 0, None, "reply", None), call(None, 0, "q", "reply", "NaN"),
    ]
    results = [(1, 6, "a", "r2"), (1, 1, "a", "r1"), (3, 0, "a", "lost"), (1, 0, None, "n")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    got = {(x.conv_id, x.call_id, x.status): x for x in tool_calls.link(c, r).collect()}
    a = got[1, "a", "linked"]
    assert a.json == '{"arguments":{"text":"x","turn":1},"content":"r1","id":"a","name":"reply"}' and a.valid and a.level == 0
    assert got[1, "b", "unanswered"].level == 1 and got[1, "c", "unanswered"].level == 2
    assert got[1, "c", "unanswered"].errors == ["$.text: minLength", "$.turn: minimum", "$.z: unknown"]
    assert got[1, "d", "cycle"].level is None and got[1, "e", "cycle"].level is None
    assert not got[2, "a", "unanswered"].valid and json.loads(got[2, "a", "unanswered"].json)["arguments"] is None
    assert got[3, "a", "orphan"].json == '{"content":"lost","id":"a"}' and (1, None, "orphan") in got and (None, "q", "unanswered") in got
    assert len(got) == 10 and tool_calls.link(c.limit(0), r.limit(0)).count() == 0


def test_conversations_as_calls_and_written_calls(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'q "1"'), (1, 2, "assistant", "r1"), (1, 3, "user", "q2"), (2, 0, "user", None), (2, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.call_id: x for x in tool_calls.op3(df).collect()}
    assert {k: (v.status, v.valid, v.level) for k, v in got.items()} == {"c1t1": ("linked", True, 0), "c1t3": ("unanswered", True, 1), "c2t0": ("linked", False, 0)}
    text = 'say <tool_call>{"id":"k","name":"reply","arguments":{"turn":1,"text":"x"}}</tool_call>'
    calls, results = tool_calls.extract_events(spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "tool", '<tool_result>{"id":"k","content":"ok"}</tool_result>')], df.schema))
    assert json.loads(tool_calls.link(calls, results).first().json) == {"id": "k", "name": "reply", "arguments": {"turn": 1, "text": "x"}, "content": "ok"}


def test_registered_query_keeps_every_turn_and_written_calls(spark, tmp_path):
    from lodeseek.llm.queries import QUERIES

    text = 'so <tool_call>{"id":"k","name":"reply","arguments":{"turn":1,"text":"x"}}</tool_call>'
    rows = [(1, 0, "system", "é"), (1, 1, "user", "q"), (1, 2, "assistant", text), (1, 3, "tool", '<tool_result>{"id":"k","content":"ok"}</tool_result>'), (1, 4, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op3_tool_calls"](spark, str(tmp_path)).collect()
    assert sorted((r.turn, r.status) for r in got) == [(0, "turn"), (1, "linked"), (2, "linked"), (3, "turn"), (4, "turn")]
    assert [r.json for r in got if r.turn == 0] == ['{"role":"system","text":"é","turn":0}']


def test_levels_of_long_chains_graphs_and_cycles(spark, monkeypatch):
    rng = random.Random(3)
    refs = {0: [], 1: [], 2: [1]}
    for i in range(3, 40):
        refs[i] = rng.sample(range(i), rng.choice([1, 1, 2]))
    refs |= {40: [42], 41: [40], 42: [41], 43: [41, 5], 44: [44], 45: [43]}
    level = {}
    for i in range(40):
        level[i] = max((level[j] + 1 for j in refs[i]), default=0)
    rows = [(1, str(i), [str(j) for j in r]) for i, r in refs.items()]
    cuts = []
    monkeypatch.setattr(tool_calls, "cut", lambda df, name: cuts.append(name) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    df = spark.createDataFrame(rows + [(2, "a", []), (2, "b", ["a", "1"]), (3, "1", ["1"])], "conv_id long, call_id string, refs array<string>")
    for most_refs in (tool_calls.MOST_REFS, 1):
        got = {(r.conv_id, r.call_id): r.level for r in tool_calls.topological_levels(df, most_refs).collect()}
        assert got == {(1, str(i)): x for i, x in level.items()} | {(2, "a"): 0, (2, "b"): 1}
    cuts.clear()
    monkeypatch.setattr(tool_calls.topological_levels, "__defaults__", (10,))
    turns = spark.createDataFrame([(7, t, "user", "q") for t in range(0, 600, 3)], "conv_id long, turn long, role string, text string")
    got = {r.turn: r.level for r in tool_calls.op3(turns).collect()}
    assert got == {3 * i: i for i in range(200)} and cuts.count("moved") <= 10


@pytest.mark.parametrize("chunk", [7, warc.CHUNK])
def test_warc_round_trip(spark, tmp_path, chunk):
    long = "é" * 80
    pages = [(3, "http://a/b c", long), (1, "u", long), (2, "u", long), (4, None, None), (5, "u", ""), (6, "u", "short\r\n\r\nWARC/1.1"), (7, "u", "short\r\n\r\nWARC/1.1"), (None, "u", "z" * 500), (8, "u", "y" * 2_500_000), (9, "u", "y" * 2_500_000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string")
    kinds = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op10(df).collect()}
    data = {i: (h or "").encode() for i, _, h in pages}
    assert kinds == {i: (len(d), hashlib.sha256(d).hexdigest(), *(("revisit", {9: 8}.get(i, 1)) if i in (2, 3, 9) else ("response", None))) for i, d in data.items()}
    if chunk == 7:
        df = df.where("page_id < 8")
    chunks = warc.read_archives(warc.write_archives(warc.chunk_rows(df, chunk), f"file://{tmp_path}/w"), chunk=chunk)
    back = {r.page_id: bytes(r.payload) for r in warc.payloads(chunks).collect()}
    assert all(back[i] == data[i] for i in back if i is not None) and {1, 4, 5, 6, 7} <= set(back)
    assert chunks.agg({"n_bytes": "max"}).first()[0] <= chunk and warc.chunk_rows(df, chunk).selectExpr("max(length(data))").first()[0] <= chunk
    assert warc.op10(df.limit(0)).count() == 0


def test_tool_calls_of_odd_texts(spark):
    long = "word " * 400_000
    calls = [(1, 0, "a", "reply", '{"text": "\\ud800", "turn": 1, "refs": ["\\udfff"], "\\ud801": 1}'), (1, 1, "b", "reply", json.dumps({"text": long, "turn": 1})), (1, 1, "b", "reply", json.dumps({"text": long, "turn": 1})), (1, 2, "c", "reply", "[" * 100_000), (1, 3, "d", "reply", "9" * 6000), (1, 4, "e", "reply", "")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string").selectExpr("*", "turn AS level", "'x' AS status")
    r = spark.createDataFrame([(1, 0, "a", long), (1, 0, "a", long)], "conv_id long, turn long, call_id string, content string").selectExpr("*", "1 AS answered")
    got = {x.call_id: x for x in tool_calls.link(c, r).collect()}
    assert sorted(got) == ["a", "b", "c", "d", "e"] and got["a"].status == "linked" and json.loads(got["a"].json)["arguments"]["text"] == "\ud800"
    assert got["a"].errors == ["$.\\ud801: unknown"] and got["b"].valid and json.loads(got["b"].json)["arguments"]["text"] == long
    assert [got[k].valid for k in "cde"] == [False] * 3 and json.loads(got["c"].json)["arguments"] is None
