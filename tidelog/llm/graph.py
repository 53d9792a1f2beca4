"""Connected components of link tables of any size, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_checked


def _least(edges: DataFrame) -> DataFrame:
    """a and m, the smallest node that a links to: combined before the shuffle, written, and so broadcast or split by whoever joins it."""
    return cut(edges.groupBy("a").agg(F.min("b").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node that it knows. Only nodes with a smaller neighbour know another than themselves."""
    least = _least(edges).withColumnRenamed("a", "b")
    return cut(join_checked(edges, least, ["b"], "left").select("a", F.coalesce("m", "b").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    met = join_checked(edges, _least(edges), ["a"], "inner")
    both = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return cut(met.select(F.explode(both).alias("e")).select("e.*").filter("a > b").distinct())


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node with a link; links has bigint columns a and b.

    Star steps (Kiveris et al., Connected Components in MapReduce and Beyond,
    2014) over edges a > b, until nothing changes. A hub's links are never brought
    together: its minimum is combined before the shuffle, and the join that hands
    it out is a broadcast, or one that AQE splits. Links to itself and repeated
    links change nothing; no links give no rows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not now[0] or now == mark:
            break
        mark = now
        edges = _small_star(_large_star(edges))
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
