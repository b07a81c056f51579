"""Connected components of an edge table by joins and partial aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest node reached.

    Parent pointers are hooked onto the smallest grandparent of a neighbour and then halved, so that chains
    take a number of rounds that grows as the logarithm of their length. A node with very many edges never
    meets in one task: minima are pre-aggregated before each shuffle, and the joins are plain equi-joins whose
    skewed partitions Spark splits. Each round is written to the shared folder; nothing goes to the driver but
    the count of changes. Self-loops and repeated edges are allowed; null ends are ignored; an empty table
    gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = cut(pairs.union(pairs.select("v", "u")).distinct(), "edges")
    state = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("parent")), "parents")
    while True:
        grand = state.alias("x").join(state.alias("y"), F.col("x.parent") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("x.parent").alias("parent"), F.col("y.parent").alias("grand"))
        grand = cut(grand, "grand")
        heard = both.join(grand.select(F.col("node").alias("v"), "grand"), "v").groupBy("u").agg(F.min("grand").alias("m"))
        heard = heard.join(grand.select(F.col("node").alias("u"), "parent"), "u")
        offers = heard.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("m").alias("to")), F.struct(F.col("parent").alias("node"), F.col("m").alias("to")))).alias("o")).select("o.*")
        offers = offers.union(grand.select("node", F.col("grand").alias("to"))).groupBy("node").agg(F.min("to").alias("to"))
        after = cut(grand.select("node", "parent", "grand").join(offers, "node").select("node", F.least("parent", "grand", "to").alias("parent"), (F.least("grand", "to") < F.col("parent")).alias("moved")), "parents")
        moved = after.where("moved").limit(1).count()
        forget(grand)
        forget(state)
        state = after.select("node", "parent")
        state._cut_path = after._cut_path
        if not moved:
            forget(both)
            return state.select("node", F.col("parent").alias("component"))
