"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lagwise.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) -> (node, root): root is the smallest node that links reach.

    Every round each node takes the smallest label around it, then the label of that label, so the
    rounds grow with the logarithm of a component's width. Each round is a written table; only
    the count of changes comes to the driver. Null ends, self-links and repeated links do no harm.
    """
    both = edges.filter("a is not null and b is not null and a != b").select("a", "b")
    both = scratch.save(both.union(both.select("b", "a")).distinct(), "links")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        # A node takes the smallest label among its neighbours' and its own label's: one exchange of both.
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), F.col("root").alias("to"))
        jump = labels.select("node", F.col("root").alias("mid")).join(labels.select(F.col("node").alias("mid"), F.col("root").alias("to")), "mid").select("node", "to")
        moved = Observation()
        step = near.select("node", "to", F.lit(None).cast("long").alias("old")).unionByName(jump.select("node", "to", F.lit(None).cast("long").alias("old"))).unionByName(labels.select("node", F.col("root").alias("to"), F.col("root").alias("old")))
        step = step.groupBy("node").agg(F.min("to").alias("root"), F.max("old").alias("old")).observe(moved, F.count_if(F.col("root") != F.col("old")).alias("n"))
        before, labels = labels, scratch.save(step.select("node", "root", "old"), "labels").select("node", "root")
        scratch.drop(before)
        if not moved.get["n"]:
            scratch.drop(both)
            return labels
