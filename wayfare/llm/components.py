"""Connected components of a link table, by contraction in random order.

In a round every node adopts the smallest node of its closed neighbourhood, under an order that is random and differs
from round to round, and the links are rewritten to the adopted nodes. Each round removes a constant share of the nodes
in expectation, so the rounds grow with the logarithm of the number of nodes, even for long chains.

Every round's tables are written to the shared folder. Joins therefore read two plain tables, so that adaptive execution can split
the rows of a hub, and a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.tables import hold


def _ranked(node: Column, turn: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("rank"), node.alias("node"))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (``node`` long, ``value``) with ``component``: the smallest value among the nodes that links reach.

    ``links`` has columns ``a`` and ``b``; repeats and loops do no harm. Nodes without links are their own component.
    Null values count for nothing unless a component has no other.
    """
    current = hold(links.select("a", "b").where("a <> b").distinct(), "links")
    steps: list[DataFrame] = []
    while not current.isEmpty():
        turn = len(steps)
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min(_ranked(F.col("b"), turn)).alias("low"))
        adopted = lowest.select(F.col("a").alias("node"), F.least("low", _ranked(F.col("a"), turn))["node"].alias("to"))
        adopted = hold(adopted, "adopted")
        steps.append(adopted)
        left = adopted.select(F.col("node").alias("a"), F.col("to").alias("a_to"))
        right = adopted.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        moved = current.join(left, "a").join(right, "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        current = hold(moved.where("a <> b").distinct(), "links")
    if not steps:
        return nodes.withColumn("component", F.col("value"))
    placed = steps[0]
    for step in steps[1:]:
        then = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        placed = placed.join(then, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    placed = hold(nodes.join(placed, "node", "left").withColumn("to", F.coalesce("to", "node")), "placed")
    lowest = hold(placed.groupBy("to").agg(F.min("value").alias("component")), "component")
    return placed.join(lowest, "to").select("node", "value", "component")
