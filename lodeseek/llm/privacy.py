"""Personal data: pattern entities, and information-theoretic sanitisation of the terms that give them away.

Entities (mail, network and card numbers, telephone) are protected. A term in a document with an entity discloses it as far as their pointwise mutual
information, estimated from whole documents, reaches the entity's own information: PMI(t; e) / -log p(e). Terms over the
first threshold are generalised to their class, over the second removed. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, kinded, match_spans, small, spans_text

KINDS = ["email", "ip", "card", "phone", "term"]
#: Documents a term must share with an entity (all of its documents if there are fewer), and the disclosure from
#: which a term is generalised and from which it is removed.
SUPPORT, GENERALISE, REMOVE = 2, 0.7, 0.95
#: Terms of more than a FREQUENT-th of the documents are told apart by broadcasts: there are at most FREQUENT times a document's mean number of terms.
FREQUENT = 2000

# The contract's regexes in a form that takes linear time: runs are possessive, and a match starts where a run starts or the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}[\p{L}\p{N}]+"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of 10."""
    digits = F.reverse(_digits(x))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, digits.substr(i, F.lit(1)).cast("int")).otherwise(digits.substr(i, F.lit(1)).cast("int") * 2 - F.when(digits.substr(i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
    )
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def _octets(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


def entity_spans(text: Column) -> Column:
    """array<struct<k, s, e, m>> of the entities; m is the value without its notation."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    has = lambda c, x: F.when(F.contains(text, F.lit(c)), x).otherwise(none)
    email = has("@", match_spans(text, EMAIL))
    ip = has(".", F.filter(match_spans(text, IP), lambda x: _octets(x["m"])))
    card = F.filter(match_spans(text, CARD), lambda x: _luhn(x["m"]))
    phone = has("+", F.filter(match_spans(text, PHONE), lambda x: F.length(_digits(x["m"])).between(9, 15)))
    named = lambda a, k, value: F.transform(a, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), value(x["m"]).alias("m")))
    return F.concat(named(email, 0, F.lower), named(ip, 1, lambda m: m), named(card, 2, _digits), named(phone, 3, _digits))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda m: F.lower(m)))


def disclosing_terms(found: DataFrame, docs: DataFrame, n_docs: int, generalise: float = GENERALISE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(term, disclosure) of the terms that give some entity away, with the greatest disclosure over the entities, and (term) of
    the frequent terms that give none away: few terms, most of the words.

    found has (key, entities, words) of the documents with entities, docs has (key, text) of all. Counts are of distinct documents, whole ones:
    of all for the term, of those that name it for the entity, of those that hold both. An entity and a term seen together in fewer than
    support documents show nothing, unless the entity itself has no more documents: then all of its documents are asked for.
    """
    n = float(n_docs)
    of_entity = found.select("key", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    of_entity = cut(of_entity.where(F.col("n_entity") < n), "entity_counts")
    of_term = cut(docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")), "term_counts")
    # n_both <= n_entity, so a disclosure of at least generalise needs n_term <= n ** (1 - generalise) * n_entity ** generalise: exact, with room for rounding
    most = lambda c: F.lit(n ** (1 - generalise) * (1 + 1e-9)) * F.pow(c.cast("double"), F.lit(generalise))
    widest = of_entity.agg(F.max(most(F.col("n_entity")))).first()[0] or 0.0
    # few terms are in so many documents; without them no term gathers a large share of the rows
    common = F.broadcast(of_term.where(F.col("n_term") > max(widest, n / FREQUENT)).select("term"))
    near = found.select("key", F.explode("words").alias("term")).join(common, "term", "left_anti").join(of_term.where(F.col("n_term") <= widest), "term")
    named = found.select("key", F.explode("entities").alias("entity")).distinct().join(of_entity, "entity")
    both = named.join(near, "key").where(F.col("n_term") <= most(F.col("n_entity"))).select("entity", "n_entity", "term", "n_term", "key").distinct()
    both = both.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    info = F.ln(F.lit(n) / F.col("n_entity"))
    # rows that repeat count once in n_both, so n_term >= n_both
    pmi = F.ln(F.col("n_both") * F.lit(n) / (F.col("n_entity") * F.col("n_term")))
    pairs = both.where(F.col("n_both") >= F.least(F.lit(support), "n_entity")).select("term", (pmi / info).alias("disclosure")).where(F.col("disclosure") >= generalise)
    terms = cut(pairs.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "disclosing")
    return terms, of_term.where(F.col("n_term") > n / FREQUENT).join(terms, "term", "left_anti").select("term")


def _forms(text: Column) -> Column:
    """The distinct forms, as they stand, of the terms of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _term_spans(text: Column, marks: Column) -> Column:
    """array<struct<s, e, disclosure>> of every occurrence of the forms of marks (map of form to disclosure).

    The forms of a document make one regex, so that only what is marked is ever put into an array. A term is what is left of a run of letters and
    digits without the digits at its start."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\p{N}*+(?:"), F.array_join(F.map_keys(marks), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    form = lambda x: F.regexp_replace(x["m"], r"^\p{N}+", "")
    return F.transform(match_spans(text, pattern, some=True), lambda x: F.struct((x["e"] - F.length(form(x))).alias("s"), x["e"].alias("e"), F.element_at(marks, form(x)).alias("disclosure")))


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", generalise: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, key, check, base, terms) for each row of docs: base are entity spans, terms spans with a disclosure.

    Every occurrence of a disclosing term (two letters or digits at least, the first a letter) in any document is a span; those that overlap
    an entity are left out. Null texts are empty. key and check are two hashes of doc_id and text: rows that repeat get the same spans and count as one
    document, and spans are handed to a row only where both agree. An empty table gives an empty result; other columns are ignored.
    """
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    body = body.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("check", F.xxhash64(F.lit("check"), "text", "doc_id"))
    spans = body.select("doc_id", "key", "check", "text", entity_spans(F.col("text")).alias("base"))
    entities = F.array_distinct(F.transform("base", lambda x: F.concat(x["k"].cast("string"), F.lit(":"), x["m"])))
    found = cut(spans.select("doc_id", "key", "check", "base", entities.alias("entities"), F.when(F.size("base") > 0, _terms(F.col("text"))).alias("words")), "entities")
    n = found.count()
    terms, plain = disclosing_terms(found.where(F.size("base") > 0).select("key", "entities", "words"), body, n, generalise, support)
    n_terms = terms.count()
    seen = body.select("key", F.explode(_forms(F.col("text"))).alias("form")).withColumn("term", F.lower("form"))
    # most forms are their term: they go through the shuffle once
    seen = seen.join(F.broadcast(plain), "term", "left_anti").select("key", "term", F.when(F.col("form") != F.col("term"), F.col("form")).alias("form"))
    marked = seen.join(small(terms, n_terms), "term").select("key", F.struct(F.coalesce("form", "term").alias("form"), "disclosure").alias("mark"))
    grouped = marked.groupBy("key").agg(F.map_from_entries(F.collect_set("mark")).alias("marks"))
    marked = body.select("key", "check", "text").join(cut(grouped, "marks"), "key").select("key", "check", _term_spans(F.col("text"), F.col("marks")).alias("terms")).dropDuplicates(["key", "check"])
    none = F.expr("cast(array() as array<struct<s:int,e:int,disclosure:double>>)")
    out = found.select("doc_id", "key", "check", "base").join(marked, ["key", "check"], "left")
    clear = F.filter(F.coalesce("terms", none), lambda t: ~F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    return out.select("doc_id", "key", "check", "base", clear.alias("terms"))


def term_class(word: Column) -> Column:
    """What a term is generalised to, by its form where it stands."""
    return F.when(F.rlike(word, F.lit(r"\p{N}")), "[CODE]").when(F.rlike(word, F.lit(r"^\p{Lu}+$")), "[ACRONYM]").when(F.rlike(word, F.lit(r"^\p{Lu}")), "[NAME]").otherwise("[WORD]")


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", remove: float = REMOVE, **how) -> DataFrame:
    """docs, with the same columns and rows: entities become their kind in brackets, disclosing terms their class ([CODE] with a digit, [ACRONYM] all
    upper case, [NAME] capitalised, else [WORD]), and from `remove` on nothing. Null texts stay null."""
    names, held = docs.columns, free_name(docs, "marks")
    key, check = free_name(docs, "key"), free_name(docs, "check")
    found = find_personal(docs, doc_id, text, **how).dropDuplicates(["key", "check"])
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.lit(None).cast("string")
    marks = F.concat(
        F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(label, x["k"] + 1).alias("by"))),
        F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["disclosure"] >= remove, "").otherwise(none).alias("by"))),
    )
    keyed = docs.withColumns({key: F.xxhash64(F.col(doc_id), t), check: F.xxhash64(F.lit("check"), t, F.col(doc_id))})
    body = keyed.join(found.select(F.col("key").alias(key), F.col("check").alias(check), marks.alias(held)), [key, check], "left")
    some = F.aggregate(
        F.array_sort(held),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.when(x["e"] <= acc["at"], acc)
        .when(x["s"] < acc["at"], F.struct(acc["out"].alias("out"), x["e"].alias("at")))
        .otherwise(F.struct(F.concat(acc["out"], t.substr(acc["at"] + 1, x["s"] - acc["at"]), F.coalesce(x["by"], term_class(t.substr(x["s"] + 1, x["e"] - x["s"])))).alias("out"), x["e"].alias("at"))),
        lambda acc: F.concat(acc["out"], t.substr(acc["at"] + 1, F.length(t))),
    )
    clean = F.when(F.size(held) > 0, some).otherwise(F.col(text))
    return body.select(*[clean.alias(c) if c == text else F.col(c) for c in names])


def op8(documents: DataFrame) -> DataFrame:
    found = find_personal(documents)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    spans = F.array_distinct(F.concat(base, kinded(F.col("terms"), len(KINDS) - 1)))
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(spans_text(base, KINDS).cast("binary"), 256).alias("base_sha256"), spans_text(spans, KINDS).alias("spans"))
