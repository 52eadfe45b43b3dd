"""Connected components of a graph given by its edges, by repeated contraction.

In each round every node points to the neighbour (or itself) that comes first in a hashed order,
pointers are doubled once, and the edges are rewritten between the nodes pointed to. Hubs are
grouped by a minimum, which is combined before the shuffle, so that no task holds a node's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); the same root within a component.

    Self-loops and repeated edges do no harm; an empty table gives an empty one.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    left = stored(edges.where("a <> b").select("a", "b").distinct(), "edges", few=True)
    labels = None
    while left.head(1):
        both = left.union(left.select("b", "a")).toDF("node", "other")
        first = both.groupBy("node").agg(F.min(order("other")).alias("m")).select("node", F.least(F.col("m"), order("node"))["v"].alias("next"))
        first = stored(first, "pointers", few=True)
        again = first.select(F.col("node").alias("next"), F.col("next").alias("root"))
        to = stored(first.join(again, "next", "left").select("node", F.coalesce("root", "next").alias("root")), "roots", few=True)
        of = lambda c, name: to.select(F.col("node").alias(c), F.col("root").alias(name))
        labels = to if labels is None else stored(labels.join(of("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels", few=True)
        left = stored(left.join(of("a", "ra"), "a").join(of("b", "rb"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges", few=True)
        released(edges.sparkSession)
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
