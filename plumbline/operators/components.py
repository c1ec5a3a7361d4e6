"""Connected components by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .joins import hot_join

MOST_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that a link names; root is the smallest node of its component.

    Rounds point neighbours to the smallest node they know, the larger ones first, then the smaller ones; their number grows
    with the logarithm of the nodes. Minima are combined before the shuffle, and the edges of a hub meet its minimum where
    they are (see hot_join), so a hub is no hot group.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    edges = stored(links.filter(F.col(a) != F.col(b)).select(*pair(a, b)).distinct(), "links")
    total, before = 2 * edges.count(), None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = hot_join(both.filter("v > u"), low, "u", "c", total, "inner").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = hot_join(large, low, "u", "c", total, "inner").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).select(*pair("u", "v")).distinct(), "round")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        total = 2 * now[0]
        if now == before:
            roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = now
    raise RuntimeError("components did not settle")
