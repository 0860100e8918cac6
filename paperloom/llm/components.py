"""Connected components of an edge table.

Every edge points from its larger node to its smaller one. In a round each node keeps its smallest
lower neighbour; its other lower neighbours are linked to that one instead. When no node has two
lower neighbours left, the edges are a forest whose roots are the smallest nodes of their
components, and pointer jumping brings every node to its root. Rounds are settled in the shared
folder; the driver sees one number a round. A node with very many members is the smaller end of its
edges; where members are joined to it, they are dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.scratch import forget, settle
from paperloom.llm.skew import join_dealt


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node that each linked node can reach.

    Nodes without a link to another node are not listed; roots are. Null ends are ignored.
    """
    down = edges.filter("a != b").select(F.greatest("a", "b").cast("long").alias("hi"), F.least("a", "b").cast("long").alias("lo")).distinct()
    now = None
    while True:
        kept = F.min("lo").over(Window.partitionBy("hi"))
        before, now = now, settle(down.withColumn("m", kept), "edges")
        if before is not None:
            forget(before)
        moved = now.filter("lo != m")
        if moved.isEmpty():
            break
        # (hi, m) stays; another lower neighbour lo is linked to m
        down = now.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).distinct()
    parent = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    total = parent.count()
    while True:
        up = parent.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        jumped = join_dealt(parent, up, "component", parent.groupBy("component").agg(F.count("*").alias("n")), total, ["node"], "left")
        before, now = now, settle(jumped.select("node", F.coalesce("higher", "component").alias("component"), F.col("higher").isNotNull().alias("moved")), "parents")
        forget(before)
        parent = now.select("node", "component")
        if now.filter("moved").isEmpty():
            break
    return parent.unionByName(parent.select(F.col("component").alias("node"), "component").distinct())
