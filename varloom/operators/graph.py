"""Connected components of graphs that are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.cluster import materialize


def components(edges: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """(*keys, node, component): the smallest node that ``edges`` (*keys, a, b) lead to, for every node with an edge.

    Edges never leave a key.  Labels fall to the smallest neighbour's and then to their label's label until nothing changes, so
    a chain takes about as many rounds as its length has digits; each round is a table.
    """
    back = edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    both = materialize(edges.select(*keys, "a", "b").unionByName(back).distinct(), folder, "edges")
    labels = both.groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("m")).select(*keys, "node", F.least("node", "m").alias("component"))
    labels, k = materialize(labels, folder, "labels-0"), 0
    while True:
        k += 1
        near = both.join(labels.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("m"))
        low = labels.join(near, [*keys, "node"]).select(*keys, "node", F.least("component", "m").alias("to"), F.col("component").alias("was"))
        low = materialize(low, folder, f"low-{k}")
        up = low.select(*keys, F.col("node").alias("to"), F.col("to").alias("top"))
        new = low.join(up, [*keys, "to"], "left").select(*keys, "node", F.least("to", F.coalesce("top", "to")).alias("component"), "was")
        new = materialize(new, folder, f"labels-{k}")
        if not new.filter("component <> was").limit(1).count():
            return new.select(*keys, "node", "component")
        labels = new.select(*keys, "node", "component")
