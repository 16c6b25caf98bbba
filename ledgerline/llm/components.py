"""Connected components of a graph of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): the least node that it reaches.

    Each round every node hands its larger neighbours to its least one, then its smaller ones; rounds grow with the
    logarithm of the nodes. Links of a node to itself and repeated links are dropped. Rounds end in written tables.
    """
    edges = settle(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, edges = edges, settle(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(old)
    nodes = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))
    return edges.select(F.explode(nodes).alias("x")).select("x.*").distinct()


def stars(edges: DataFrame) -> bool:
    """Whether every node hangs from one other that hangs from none: then all components are found."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")), F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    by_node = edges.select(F.explode(ends).alias("x")).groupBy("x.node").agg(F.sum("x.hangs").alias("hangs"), F.max("x.holds").alias("holds"))
    return by_node.where("hangs + holds > 1").agg(F.count("*")).first()[0] == 0
