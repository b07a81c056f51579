"""Secret scans over a trigram inverted index.

Each rule's regex is turned into a Boolean query over the trigrams that any match must hold. The index is a table of postings (trigram,
document) laid out by trigram, for every trigram that some query names; a rule's query reads the postings of its trigrams, intersects
them and so finds the rule's candidates, which are then joined to their texts and verified with the regex. Rules without
mandatory trigrams scan all documents. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, kinded, match_spans, small, spans_text

_parser = re._parser  # the standard library's own regex parser


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Fewest characters of the measured group (0: the match); shorter matches are dropped but not searched again.
    group: int = 0
    least: int = 0


BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run of these characters shorter than the minimum never holds a longer match, so the minimum can be in the regex
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
]
RULES = [*BASE, *MORE]
#: Alternatives a regex part may spell out before its trigrams are taken.
MOST_EXACT = 64
#: Candidates, and documents with spans, that are broadcast to the texts; more meet them in a shuffle.
FEW = 400_000

#: A query: a conjunction of clauses, each a disjunction of trigram sets that must all be there.
Query = list[list[frozenset[str]]]


def _clause(strings: set[str]) -> list[list[frozenset[str]]]:
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if not sets or frozenset() in sets:
        return []
    # a set that holds another one adds nothing to the disjunction
    return [sorted((a for a in sets if not any(b < a for b in sets)), key=sorted)]


def _walk(parts, exact: set[str]) -> tuple[set[str], Query]:
    """Extend the exact strings by the parts; what can't be spelled out ends them, leaving a clause behind."""
    query: Query = []

    def flush(new: set[str]) -> None:
        nonlocal exact
        query.extend(_clause(exact))
        exact = new

    for op, arg in parts:
        name = str(op)
        if name == "LITERAL":
            options = {chr(arg).lower()}
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in arg) and len(arg) <= 8:
            options = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            inner, more = _walk(arg[3], {""})
            query += more
            options = inner if not more else None
            if more:
                flush({""})
                query.extend(_clause(inner))
                continue
        elif name == "BRANCH":
            sides = [_walk(side, {""}) for side in arg[1]]
            if any(more for _, more in sides):
                flush({""})
                continue
            options = set().union(*(s for s, _ in sides))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            said, more = _walk(inner, {""})
            if (low, high) == (0, 1) and not more:
                options = said | {""}
            else:
                flush({""})
                if low:
                    query += more + _clause(said)
                continue
        else:
            flush({""})
            continue
        grown = {a + b for a in exact for b in options}
        if len(grown) > MOST_EXACT:
            flush(options)
        else:
            exact = grown
    return exact, query


def trigram_query(pattern: str) -> Query:
    """What every match must hold, in lower case (a superset test: case is left to the regex). [] if nothing is mandatory."""
    exact, query = _walk(_parser.parse(pattern), {""})
    return query + _clause(exact)


def index_trigrams(docs: DataFrame, trigrams: list[str], key: Column, text: Column) -> DataFrame:
    """The postings (key, trigram number) of the given trigrams over the lower-cased texts, written with a folder a trigram.

    A frequent trigram's postings are dealt over several tasks. Null keys or texts have no postings."""
    low = docs.select(key.alias("key"), F.lower(text).alias("low"))
    there = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)]))
    rows = low.select("key", F.explode(there).alias("trigram"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartition(n, "trigram", F.pmod("key", F.lit(max(1, n // 4)))), "postings", by="trigram")


def candidates(postings: DataFrame, queries: list[Query], trigrams: list[str]) -> DataFrame:
    """(key, rules): bit r of rules is set if the document satisfies query r.

    The postings of each alternative's trigrams are intersected: a key is left if it is in all of them (60 at most: fewer only let more through).
    What the alternatives leave is then joined by or within a clause and by and over the clauses. Only postings that a query names are read."""
    number = {t: k for k, t in enumerate(trigrams)}
    sets = sorted({g for q in queries for clause in q for g in clause}, key=sorted)
    of = {g: k for k, g in enumerate(sets)}
    rows = [(number[t], k, 1 << bit, (1 << min(60, len(g))) - 1) for g, k in of.items() for bit, t in enumerate(sorted(g)[:60])]
    wanted = F.broadcast(postings.sparkSession.createDataFrame(rows, "trigram int, alternative int, bit long, whole long"))
    lists = postings.where(F.col("trigram").isin(sorted(number.values()))).join(wanted, "trigram")
    met = lists.groupBy("alternative", "key").agg(F.bit_or("bit").alias("bits"), F.max("whole").alias("whole")).where("bits = whole")
    words = range(len(sets) // 60 + 1)
    held = met.groupBy("key").agg(*[F.coalesce(F.bit_or(F.when(F.floor(F.col("alternative") / 60) == w, F.expr("shiftleft(1L, cast(alternative % 60 as int))"))), F.lit(0).cast("long")).alias(f"w{w}") for w in words])
    holds = lambda g: F.col(f"w{of[g] // 60}").bitwiseAND(F.lit(1 << of[g] % 60).cast("long")) != 0
    rules = F.lit(0).cast("long")
    for r, query in enumerate(queries):
        if query:
            yes = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [holds(g) for g in clause]) for clause in query])
            rules = rules + F.when(yes, F.lit(1 << r)).otherwise(0)
    return held.select("key", rules.alias("rules")).where("rules <> 0")


def _long_enough(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda x: F.length(x["m"]) >= least)


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text", to: str = "secret_spans") -> DataFrame:
    """docs with `to` added: array<struct<s, k, e>> in code points, k the rule's place in rules.

    Null texts are empty. Documents are matched to their postings by a hash of doc_id and text; a collision only adds a
    candidate, which the regex then turns down. The few candidates are joined to the texts and verified; what they hold is joined to the rows.
    Spans of a rule are leftmost and don't overlap; rows that repeat get the same spans; a column of the added name is
    replaced, all others stay; an empty table gives an empty result.
    """
    if len(rules) > 60:
        raise ValueError("at most 60 rules at a time")
    names = [c for c in docs.columns if c.lower() != to.lower()]
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for clause in q for g in clause for t in g})
    key = free_name(docs, "key")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.xxhash64(F.col(doc_id), body).alias("key"), body.alias("body"))
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")

    def spans(k: int, t: Column) -> Column:
        rule = rules[k]
        return kinded(_long_enough(match_spans(t, rule.pattern, rule.group), rule.least) if rule.least else match_spans(t, rule.pattern), k)

    scanned = [spans(k, body) for k, q in enumerate(queries) if not q]
    rows = docs.select(*names, F.xxhash64(F.col(doc_id), body).alias(key), (F.concat(*scanned) if scanned else none).alias(to))
    if not trigrams:
        return rows.drop(key)
    found = cut(candidates(index_trigrams(keyed, trigrams, F.col("key"), F.col("body")), queries, trigrams), "candidates")
    texts = keyed.join(small(found, found.count(), FEW), "key")
    told = [F.when(F.col("rules").bitwiseAND(F.lit(1 << k).cast("long")) != 0, spans(k, F.col("body"))).otherwise(none) for k, q in enumerate(queries) if q]
    told = cut(texts.select("key", F.concat(*told).alias("told")).where("size(told) > 0").dropDuplicates(["key"]), "told").withColumnRenamed("key", key)
    mark = free_name(rows, "told")
    return rows.join(small(told.withColumnRenamed("told", mark), told.count(), FEW // 4), key, "left").select(*names, F.concat(to, F.coalesce(mark, none)).alias(to))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", **how) -> DataFrame:
    """docs, with the same columns and rows, with every span replaced by the mark; overlapping spans are replaced as one.

    Null and empty texts stay as they are, so do texts without spans; an empty table gives an empty result."""
    names, t, to = docs.columns, F.col(text), free_name(docs, "secret_spans")
    marked = find_secrets(docs, text=text, to=to, **how)
    some = F.aggregate(
        F.array_sort(to),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.when(x["e"] <= acc["at"], acc)
        .when(x["s"] < acc["at"], F.struct(acc["out"].alias("out"), x["e"].alias("at")))
        .otherwise(F.struct(F.concat(acc["out"], t.substr(acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)).alias("out"), x["e"].alias("at"))),
        lambda acc: F.concat(acc["out"], t.substr(acc["at"] + 1, F.length(t))),
    )
    clean = F.when(F.size(to) > 0, some).otherwise(t)
    return marked.select(*[clean.alias(c) if c == text else F.col(c) for c in names])


def op4(documents: DataFrame) -> DataFrame:
    found = find_secrets(documents.select("doc_id", "text"))
    base = F.filter("secret_spans", lambda x: x["k"] < len(BASE))
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["k"] == k)).cast("long")
    kinds = [r.kind for r in RULES]
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(base, kinds).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("secret_spans"), kinds).alias("spans"))
