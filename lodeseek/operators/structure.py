"""Forests, line search and running budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import cut
from ..functions.text import clip_line


def resolve_parents(entities: DataFrame, scope: str = "file_path") -> DataFrame:
    """parent_id set to null where no such entity stands in the same scope."""
    ids = entities.select(F.col("id").alias("parent_id"), F.col(scope).alias("__scope")).distinct().withColumn("__there", F.lit(True))
    joined = entities.join(ids, (entities.parent_id == ids.parent_id) & (entities[scope] == ids["__scope"]), "left")
    return joined.select(*[F.when(F.col("__there"), entities.parent_id).alias("parent_id") if c == "parent_id" else entities[c] for c in entities.columns])


def _rooted(nodes: DataFrame, with_path: bool) -> DataFrame:
    """(id, parent_id, up, depth, path) with up null where the root is reached: each round jumps over the ancestor found so far, so rounds grow with
    the logarithm of the depth. What is still open after as many rounds as the node count has binary digits is in or behind a cycle, or has no root."""
    at_root = F.col("parent_id").isNull()
    path = F.array("id") if with_path else F.lit(None).cast("int")
    state = cut(nodes.select("id", "parent_id", F.col("parent_id").alias("up"), F.when(at_root, 0).otherwise(1).alias("depth"), path.alias("path")), "forest")
    for _ in range(max(1, nodes.count()).bit_length() + 1):
        left = state.where("up IS NOT NULL")
        if not left.limit(1).count():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("path").alias("before"))
        joined = F.concat("before", "path") if with_path else F.col("path")
        moved = left.join(above, "up").select("id", "parent_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), joined.alias("path"))
        state = cut(state.where("up IS NULL").unionByName(moved), "forest")
    return state.where("up IS NULL")


def tree_depth(nodes: DataFrame) -> DataFrame:
    """(id, parent_id, depth, path) of a forest of any size and depth; path runs from the root. Nodes in or behind a cycle and below a missing
    parent are left out; ids are unique."""
    rooted = cut(_rooted(nodes, False).select("id", "parent_id"), "rooted")
    return _rooted(rooted, True).select("id", "parent_id", "depth", "path")


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, content): lines from 1."""
    return docs.select(F.col(key), F.posexplode(F.split(text, "\n", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)


def references(docs: DataFrame, name: str, key: str, text: str, limit: int | None = 20) -> DataFrame:
    """(key, line, context): lines that hold the name, in key and line order. Documents without it never explode."""
    hits = lines_of(docs.where(F.contains(F.col(text), F.lit(name))), key, text).where(F.contains("content", F.lit(name)))
    out = hits.select(key, "line", clip_line(F.col("content")).alias("context"))
    return out if limit is None else out.orderBy(key, "line").limit(limit)


def references_of(docs: DataFrame, names: DataFrame, key: str, text: str, limit: int | None = 20, block: int = 1000) -> DataFrame:
    """(name, key, line, context): for every name of a table (name) the first `limit` lines that hold it, in key and line order.

    Names go to the lines as literals, a block at a time, so lines are never joined with names; null and empty names hold nowhere.
    """
    found, edges = None, names.where("name <> ''").select("name").distinct()
    n = -(-edges.count() // block)
    for k in range(n):
        part = [r.name for r in edges.where(F.pmod(F.xxhash64("name"), F.lit(n)) == k).collect()] if n > 1 else [r.name for r in edges.collect()]
        if not part:
            continue
        held = lambda x, part=part: F.filter(F.array(*[F.lit(p) for p in sorted(part)]), lambda p: F.contains(x, p))
        lines = lines_of(docs, key, text).withColumn("names", held(F.col("content"))).where(F.size("names") > 0)
        rows = lines.select(F.explode("names").alias("name"), key, "line", clip_line(F.col("content")).alias("context"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.select(F.lit("").alias("name"), key, F.lit(1).alias("line"), F.lit("").alias("context")).limit(0)
    w = Window.partitionBy("name").orderBy(key, "line")
    return found if limit is None else found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def within_budget(df: DataFrame, partition: list[str], order: list, cost: str, budget: float, to: str = "used") -> DataFrame:
    """Rows taken while what was used before them is within the budget, so that the last may overshoot; `to` is what was used before."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn(to, before).where(F.col(to) <= budget)


def siblings(nodes: DataFrame, target: str | int, scope: str) -> DataFrame:
    """Nodes of the target's scope but itself."""
    of = nodes.where(F.col("id") == target).select(scope)
    return nodes.join(F.broadcast(of), scope, "left_semi").where(F.col("id") != target)
