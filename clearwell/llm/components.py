"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, written

#: Rounds after which something must be wrong: a path of a million nodes takes some 20.  More is an error, never a result.
ROUNDS = 500


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b); root is the smallest node of the component.

    In each round a node takes the smallest label of its neighbours, the root of
    a tree of labels the smallest that any node of its tree has taken, and then
    each node the label of its label, until nothing changes.  Labels are written
    to the shared folder, not collected.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "labels")
    for _ in range(ROUNDS):
        offers = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("offer"))
        taken = labels.join(offers, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "offer").alias("new"))
        taken = written(taken, "labels")
        hooks = taken.groupBy(F.col("old").alias("node")).agg(F.min("new").alias("hook"))
        hooked = taken.join(hooks, "node", "left").select("node", "old", F.least("new", "hook").alias("new"))
        above = hooked.select(F.col("node").alias("new"), F.col("new").alias("next"))
        jumped = hooked.join(above, "new", "left").select("node", "old", F.coalesce("next", "new").alias("root"))
        before, labels = labels, written(jumped, "labels")
        drop_table(before)
        drop_table(taken)
        if labels.where("root <> old").isEmpty():
            drop_table(both)
            return labels.select("node", "root")
        labels = labels.select("node", "root")
    raise RuntimeError(f"labels still change after {ROUNDS} rounds")
