"""Connected components of a graph given as edges between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likerec.llm.common import stash


def _sums(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
    return row["n"], row["h"]


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but roots themselves; root is the component's least node.

    Alternates two rounds: every node links its larger neighbours to its least one, then its smaller neighbours
    and itself to the least one, until all edges end in roots. The number of rounds grows with the logarithm of
    the longest chain. Each round is one stored table; a node with very many neighbours is met by aggregates that
    combine before the shuffle and joins that Spark can split. Loops and repeated edges do no harm; an empty table
    has no labels.
    """
    pair = F.when(F.col("a") > F.col("b"), F.struct(F.col("a").alias("u"), F.col("b").alias("v"))).otherwise(
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    current = stash(edges.where("a <> b").select(pair.alias("e")).select("e.u", "e.v").distinct(), "component-edges")
    before = None
    while before != (now := _sums(current)):
        before = now
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        linked = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = linked.groupBy("u").agg(F.min("v").alias("m"))
        linked = linked.join(least, "u")
        moved = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stash(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "component-edges")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
