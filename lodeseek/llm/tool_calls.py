"""Chat formatting: tool calls are hash-joined to their results by identifier, put in topological order, validated against the
tools' schemas and serialised as canonical JSON."""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, small

#: Tools of the query's conversations.
SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["text", "turn"],
        "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "refs": {"type": "array", "items": {"type": "string"}}},
    }
}
#: Turns of a conversation that are ordered in one piece, and references of one that are levelled in one piece.
SPAN, MOST_REFS = 256, 50_000
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, and one form of each number (3.0 and 3 are 3)."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("JSON has no such number")
            return int(x) if x.is_integer() and abs(x) < 2**53 else x
        return x

    return _encodable(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _encodable(text: str) -> str:
    """The text with lone surrogates, which UTF-8 can't hold, as JSON writes them."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, int | float) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What the value breaks of a JSON Schema: type, enum, const, required, properties, additionalProperties, items, bounds, pattern, anyOf."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not const")
    if "anyOf" in schema and all(violations(value, s, at) for s in schema["anyOf"]):
        out.append(f"{at}: no anyOf")
    size = len(value) if isinstance(value, str | list) else value if _is(value, "number") else None
    least, most = {str: ("minLength", "maxLength"), list: ("minItems", "maxItems")}.get(type(value), ("minimum", "maximum"))
    if size is not None and size < schema.get(least, size):
        out.append(f"{at}: {least}")
    if size is not None and size > schema.get(most, size):
        out.append(f"{at}: {most}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: pattern")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        out += [e for i, v in enumerate(value) for e in violations(v, schema["items"], f"{at}[{i}]")]
    return out


def references(arguments) -> list[str]:
    """Identifiers that the arguments refer to: strings of a key refs, or values {"$ref": id}, anywhere."""
    out = []
    if isinstance(arguments, dict):
        if isinstance(arguments.get("$ref"), str):
            out.append(arguments["$ref"])
        for k, v in arguments.items():
            out += [x for x in v if isinstance(x, str)] if k == "refs" and isinstance(v, list) else references(v)
    elif isinstance(arguments, list):
        for v in arguments:
            out += references(v)
    return out


def extract_events(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls and results written in texts as <tool_call>{id, name, arguments}</tool_call> and <tool_result>{id, content}</tool_result>."""

    def parts(tag: str) -> DataFrame:
        found = F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
        return messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.explode(found).alias("j"))

    of = lambda p: F.get_json_object("j", f"$.{p}")
    calls = parts("tool_call").select("conv_id", "turn", of("id").alias("call_id"), of("name").alias("name"), of("arguments").alias("arguments"))
    return calls, parts("tool_result").select("conv_id", "turn", of("id").alias("call_id"), of("content").alias("content"))


def _validate(calls: DataFrame, schemas: dict) -> DataFrame:
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                bodies, errors, refs = [], [], []
                for name, text in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist(), strict=True):
                    try:
                        value = json.loads(text if text is not None else "null", parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
                        body = canonical(value)
                        wrong = [_encodable(e) for e in violations(value, schemas[name])] if name in schemas else [f"unknown tool {name}"]
                        refs.append(sorted({_encodable(r) for r in references(value)}))
                    except (ValueError, RecursionError) as e:
                        body, wrong = None, [f"not JSON: {type(e).__name__}"]
                        refs.append([])
                    bodies.append(body)
                    errors.append(wrong)
                keep = [batch.column(c) for c in ("conv_id", "turn", "call_id", "name")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(bodies, pa.string()), pa.array(errors, pa.list_(pa.string())), pa.array(refs, pa.list_(pa.string()))], names=["conv_id", "turn", "call_id", "name", "arguments", "errors", "refs"])

    return calls.select("conv_id", "turn", "call_id", "name", "arguments").mapInArrow(run, "conv_id long, turn long, call_id string, name string, arguments string, errors array<string>, refs array<string>")


def levels_of(edges: list[tuple[str, str]]) -> list[tuple[str, int]]:
    """(call, level) of the calls with references (call, ref) of one conversation, without those in or behind a cycle."""
    behind, waits, level = {}, {}, {}
    for call, ref in edges:
        behind.setdefault(ref, []).append(call)
        waits[call] = waits.get(call, 0) + 1
    ready = [x for x in behind if x not in waits]
    while ready:
        x = ready.pop()
        for call in behind.get(x, ()):
            level[call] = max(level.get(call, 0), level.get(x, 0) + 1)
            waits[call] -= 1
            if not waits[call]:
                ready.append(call)
    return [(c, n) for c, n in level.items() if not waits[c]]


def _levels_in_pieces(edges: DataFrame) -> DataFrame:
    """levels_of every conversation; the rows of one lie together and in sequence, and one at a time is held."""

    def run(batches):
        conv, held = None, []

        def done() -> pa.RecordBatch:
            got = levels_of(held)
            return pa.RecordBatch.from_arrays([pa.array([conv] * len(got), pa.int64()), pa.array([c for c, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], names=["conv_id", "call_id", "level"])

        for batch in batches:
            for c, call, ref in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "call_id", "ref")), strict=True):
                if c != conv:
                    if held:
                        yield done()
                    conv, held = c, []
                held.append((call, ref))
        if held:
            yield done()

    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = edges.select("conv_id", "call_id", "ref").repartition(n, "conv_id").sortWithinPartitions("conv_id")
    return rows.mapInArrow(run, "conv_id long, call_id string, level long")


def topological_levels(calls: DataFrame, most_refs: int = MOST_REFS) -> DataFrame:
    """(conv_id, call_id, level): 0 without references to calls of the conversation, else one more than the greatest level referred to.

    Calls in or behind a cycle are left out. A conversation of at most most_refs references is levelled in one pass. A longer one is never gathered:
    there an open call is the greatest of a base and of its references' levels plus a weight. In a round, a reference to a call whose level is known
    goes into the base, and one to a call that has a single reference itself jumps over that call, by joins on the identifiers. A chain's or a
    tree's rounds grow with the logarithm of its length; where calls have several references each that stay open, a round may resolve one level only.
    """
    known = calls.select("conv_id", "call_id").distinct()
    edges = calls.select("conv_id", "call_id", F.explode("refs").alias("ref")).distinct()
    edges = cut(edges.join(known.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"]).select("conv_id", "call_id", "ref", F.lit(1).cast("long").alias("w"), F.lit(0).cast("long").alias("base")), "edges")
    done = known.join(edges.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).cast("long").alias("level"))
    long = cut(edges.groupBy("conv_id").count().where(F.col("count") > most_refs).select("conv_id"), "long")
    n_long = long.count()
    done = cut(done.union(_levels_in_pieces(edges.join(small(long, n_long), "conv_id", "left_anti"))), "levels")
    if not n_long:
        return done.select("conv_id", "call_id", F.col("level").cast("int").alias("level"))
    held, edges = edges, cut(edges.join(small(long, n_long), "conv_id", "left_semi"), "edges")
    forget(held)
    # a path without a cycle weighs no more than there are calls with references
    most = edges.select("conv_id", "call_id").distinct().count()
    while True:
        single = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("m"), F.first("ref").alias("next"), F.first("w").alias("far"), F.first("base").alias("low")).where("m = 1")
        none = F.lit(None)
        ends = done.select("conv_id", F.col("call_id").alias("ref"), none.cast("string").alias("next"), none.cast("long").alias("far"), F.col("level").alias("low"))
        ends = ends.union(single.select("conv_id", F.col("call_id").alias("ref"), "next", "far", "low"))
        met = edges.join(ends, ["conv_id", "ref"], "left")
        to = F.when(F.col("low").isNull(), F.col("ref")).otherwise(F.col("next"))
        base = F.greatest("base", F.col("low") + F.col("w"))
        moved = cut(met.select("conv_id", "call_id", to.alias("ref"), (F.col("w") + F.coalesce("far", F.lit(0))).alias("w"), base.alias("base"), F.col("low").isNotNull().alias("hit")), "moved")
        if not moved.where("hit").limit(1).count():
            forget(moved)
            return done.select("conv_id", "call_id", F.col("level").cast("int").alias("level"))
        bases = moved.groupBy("conv_id", "call_id").agg(F.max("base").alias("base"), F.count("ref").alias("m"))
        done = done.union(cut(bases.where("m = 0").select("conv_id", "call_id", F.col("base").alias("level")), "levels"))
        left = moved.where("ref IS NOT NULL").groupBy("conv_id", "call_id", "ref").agg(F.max("w").alias("w")).where(F.col("w") <= most)
        grown = cut(left.join(bases.where("m > 0").drop("m"), ["conv_id", "call_id"]).select("conv_id", "call_id", "ref", "w", "base"), "edges")
        forget(edges)
        forget(moved)
        edges = grown


def link(calls: DataFrame, results: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One row per call and per result without a call: conv_id, turn, call_id, status, level, valid, errors, json.

    calls: conv_id, turn, call_id, name, arguments (JSON); results: conv_id, turn, call_id, content. Joined by (conv_id, call_id); of
    several results the earliest turn counts (then the smaller content), of calls that repeat an identifier the earliest (then the smallest name and arguments),
    the others are left out. status: linked, unanswered, orphan (a result whose call is missing or has a null
    identifier), or cycle. (level, turn, call_id) is a topological order within a conversation. json is canonical and holds id, name, arguments and,
    if linked, content; arguments that aren't JSON are null there and invalid. Null identifiers never
    link; an empty table gives an empty result; other columns are ignored.
    """
    checked = _validate(calls.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("call_id").cast("string"), F.col("name").cast("string"), F.col("arguments").cast("string")), schemas or SCHEMAS)
    first = checked.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").isNull().alias("o"), "turn", "name", "arguments", "errors", "refs")).alias("c")).select("conv_id", "call_id", "c.*").drop("o")
    loose = checked.where("conv_id IS NULL OR call_id IS NULL")
    first = cut(first, "calls")
    of = results.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("call_id").cast("string"), F.col("content").cast("string"))
    answer = of.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").isNull().alias("o"), F.col("turn").alias("answer_turn"), "content")).alias("r")).select("conv_id", "call_id", "r.answer_turn", "r.content", F.lit(True).alias("answered"))
    levels = topological_levels(first)
    joined = first.withColumn("asked", F.lit(True)).join(answer, ["conv_id", "call_id"], "full").join(levels, ["conv_id", "call_id"], "left")
    status = F.when(F.col("asked").isNull(), "orphan").when(F.col("level").isNull(), "cycle").when(F.col("answered"), "linked").otherwise("unanswered")
    cols = ["conv_id", "turn", "call_id", "name", "arguments", "errors", "content", "status", "level"]
    rows = joined.select("conv_id", F.coalesce("turn", "answer_turn").alias("turn"), "call_id", "name", "arguments", "errors", "content", status.alias("status"), "level")
    empty = F.lit(None).cast("string")
    rows = rows.union(loose.select("conv_id", "turn", "call_id", "name", "arguments", "errors", empty.alias("content"), F.lit("unanswered"), F.lit(0)))
    rows = rows.union(of.where("conv_id IS NULL OR call_id IS NULL").select("conv_id", "turn", "call_id", empty, empty, F.lit(None).cast("array<string>"), "content", F.lit("orphan"), F.lit(None).cast("int")))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = []
                for call, name, args, content, state in zip(*(batch.column(c).to_pylist() for c in ("call_id", "name", "arguments", "content", "status")), strict=True):
                    value = {"id": call}
                    if state != "orphan":
                        value |= {"name": name, "arguments": json.loads(args) if args is not None else None}
                    if state in ("linked", "orphan"):
                        value["content"] = content
                    out.append(canonical(value))
                valid = [state != "orphan" and not e for state, e in zip(batch.column("status").to_pylist(), batch.column("errors").to_pylist(), strict=True)]
                keep = [batch.column(c) for c in ("conv_id", "turn", "call_id", "status", "level")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(valid, pa.bool_()), batch.column("errors"), pa.array(out, pa.string())], names=["conv_id", "turn", "call_id", "status", "level", "valid", "errors", "json"])

    return rows.toDF(*cols).mapInArrow(run, "conv_id long, turn long, call_id string, status string, level int, valid boolean, errors array<string>, json string")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The test conversations are plain turns: a user turn becomes a call of the tool reply, an assistant turn the result of the turn before it.
    Every call of a conversation refers to the one before it."""
    ident = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("t"), t.cast("string"))
    # the call before is looked for among SPAN turns, then in the last span before that has one
    asked = conversations.where("role = 'user'").select("conv_id", "turn", "text", F.floor(F.col("turn") / F.lit(SPAN)).alias("span"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rangeBetween(Window.unboundedPreceding, -1)
    spans = asked.groupBy("conv_id", "span").agg(F.max("turn").alias("last")).withColumn("last", F.max("last").over(earlier("conv_id", "span")))
    asked = asked.withColumn("before", F.max("turn").over(earlier("conv_id", "span", "turn"))).join(spans, ["conv_id", "span"], "left").withColumn("before", F.coalesce("before", "last"))
    refs = F.when(F.col("before").isNotNull(), F.array(ident(F.col("before"))))
    calls = asked.select("conv_id", "turn", ident(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("turn", "text", refs.alias("refs"))).alias("arguments"))
    results = conversations.where("role = 'assistant'").select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op3(conversations: DataFrame) -> DataFrame:
    return link(*turns_as_calls(conversations))


def plain_turns(conversations: DataFrame) -> DataFrame:
    """A row of link's form, with status turn and no call, for each turn that is neither a user's nor an assistant's (a null role too); json holds role, turn and text."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = [canonical({"role": r, "turn": t, "text": x}) for r, t, x in zip(*(batch.column(c).to_pylist() for c in ("role", "turn", "text")), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(out, pa.string())], names=["conv_id", "turn", "json"])

    rest = conversations.where("role IS NULL OR role NOT IN ('user', 'assistant')").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    none = lambda kind: F.lit(None).cast(kind)
    rows = rest.mapInArrow(run, "conv_id long, turn long, json string")
    return rows.select("conv_id", "turn", none("string").alias("call_id"), F.lit("turn").alias("status"), none("int").alias("level"), none("boolean").alias("valid"), none("array<string>").alias("errors"), "json")


def op3_whole(conversations: DataFrame) -> DataFrame:
    """The registered query: turns as calls and results, calls and results written in any turn's text, and the other turns as they are."""
    calls, results = turns_as_calls(conversations)
    written, answers = extract_events(conversations)
    return link(calls.unionByName(written), results.unionByName(answers)).unionByName(plain_turns(conversations))
