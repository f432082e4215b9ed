"""Connected components and pointer chains as joins; nothing is gathered on the driver.

Both sides of every join are checkpointed rows, not aggregations, so adaptive
execution can split the tasks of a node that very many others point at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage


def moved(rows: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by what it points at, where it does."""
    at = pointers.select(F.col("node").alias("_node"), F.col("to").alias("_to"))
    met = rows.join(at, F.col(column) == F.col("_node"), "left")
    return met.withColumn(column, F.coalesce("_to", column)).drop("_node", "_to")


def follow(pointers: DataFrame) -> DataFrame:
    """(node, to) with every pointer followed to its end by doubling.

    ``pointers`` has one row a node and no cycle but a node that points at
    itself, its end. A chain of n steps takes log2(n) rounds.
    """
    now = cut_lineage(pointers.select("node", "to"))
    while True:
        on = now.filter("node <> to").select(F.col("node").alias("_node"), F.col("to").alias("_to"))
        met = now.join(on, F.col("to") == F.col("_node"), "left")
        now = cut_lineage(met.select("node", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("_open")))
        if now.filter("_open").isEmpty():
            return now.drop("_open")
        now = now.drop("_open")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that has an edge; the root is a component's smallest node.

    ``edges`` has ``a`` and ``b``. Every round lets each node point at its
    smallest neighbour, follows the pointers and contracts the edges, so at most
    half of the nodes of a component are left.
    """
    def once(df: DataFrame) -> DataFrame:
        return cut_lineage(df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    now, found = once(edges), None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        ends = follow(least.select("node", F.least("node", "to").alias("to")))
        found = ends if found is None else cut_lineage(moved(found, "to", ends))
        now = once(moved(moved(now, "a", ends), "b", ends))
        if now.isEmpty():
            return found.select("node", F.col("to").alias("root"))
