"""Connected components of a link table, without collecting it.

Alternating rounds (large star, small star) of Kiveris et al., "Connected Components in MapReduce and Beyond": every
round is two aggregations on the node id, and the number of rounds grows with the logarithm of the longest chain.
Each round is written to the shared folder, so lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _least(pairs: DataFrame) -> DataFrame:
    """(a, m): the least neighbour of each node, written down: the join that follows then has a plain exchange on
    either side, so that Spark can broadcast a small one and split a node with very many neighbours."""
    return staged(pairs.groupBy("a").agg(F.min("b").alias("m")), "least")


def connected_components(links: DataFrame) -> DataFrame:
    """`links`: columns a, b (orderable, not null). Returns node, component (the least node reachable).

    Nodes without links are absent. Self links and repeated links are allowed. No links give no rows.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both)
        # large star: each node links its larger neighbours to the least of itself and all neighbours
        large = staged(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "large-star")
        discard(least)
        # small star: each node links itself and its smaller neighbours to the least of them
        least = _least(large)
        moved = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        small = large.join(least, "a").select(moved.alias("e")).select("e.*").where("a <> b").distinct()
        after = staged(small, "links")
        same = edges.join(after, ["a", "b"], "left_anti").isEmpty() and after.count() == edges.count()
        for table in (least, large, edges):
            discard(table)
        edges = after
        if same:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
