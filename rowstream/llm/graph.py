"""Connected components by repeated contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowstream.llm.common import Tables

#: The mapping is written after so many rounds, so that its plan stays short.
WRITE_EVERY = 4


def components(tables: Tables, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (x, y); a component is named by its least node.

    Each round maps every node to the least of itself and its neighbours and replaces edge ends by what they map to. An
    edge between a node and its image stays between their images, so nothing falls apart; stars contract in one round.
    """
    left = tables.write(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    mapping = nodes.select("node", F.col("node").alias("component"))
    turn = 0
    while not left.isEmpty():
        turn += 1
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = tables.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "least")
        mapping = mapping.join(least, F.col("component") == F.col("a"), "left").select("node", F.coalesce("to", "component").alias("component"))
        if turn % WRITE_EVERY == 0:
            mapping = tables.write(mapping, "mapping")
        moved = left.join(least.select("a", F.col("to").alias("a2")), "a").join(least.select(F.col("a").alias("b"), F.col("to").alias("b2")), "b")
        left = tables.write(moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    return tables.write(mapping, "mapping")


def joined(tables: Tables, mapping: DataFrame, edges: DataFrame) -> DataFrame:
    """``mapping`` after its components, or nodes it does not know yet, were linked by ``edges`` (x, y)."""
    new = components(tables, edges)
    to = new.select(F.col("node").alias("__node"), F.col("component").alias("__to"))
    old = mapping.join(to, F.col("component") == F.col("__node"), "left").select("node", F.coalesce("__to", "component").alias("component"))
    return tables.write(old.union(new.join(mapping, "node", "left_anti")), "mapping")
