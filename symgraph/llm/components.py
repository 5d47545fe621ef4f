"""Connected components of a distributed link table.

Alternating large-star and small-star rounds: every round is two grouped minima
and two equi-joins, so no component, however large, has to fit in a task, and
a popular node's links are only ever reduced by partial aggregation or joined
(where adaptive execution may split them).  Rounds grow with the logarithm of
the longest shortest path.  Lineage is cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.storage import checkpointed


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node in ``links`` (columns a, b of one type) that is not itself the root.

    The root is the smallest node of the component.  A pair of a node with
    itself and nulls link nothing; pairs may repeat and come either way round.
    An empty table gives an empty table.
    """
    links = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(links)
    if not before[0]:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_rounds):
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        links = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of u and u itself are linked to the smallest of them
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        rest = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = checkpointed(rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = _signature(links)
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("the components did not settle")
