"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``edges(a, b)``; the component is its smallest node.

    Large-star links every larger neighbour of a node to the smallest neighbour, small-star links the node and its smaller
    neighbours to the smallest. Each step only groups by one node, never lists a group, and repeats until every component is a
    star; every round is written, so lineage stays short. A hub is one sum per task before the shuffle, and its
    edges are spread by the join.
    """
    edges = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # A node below two others, or both below and above some, is not in a star yet.
        roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
        roles = roles.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if not roles.where("below > 1 or (below > 0 and above > 0)").limit(1).count():
            break
        # Large-star: for every node u, each larger neighbour v gets the edge (v, min of u's neighbours and u).
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.join(lowest, both["a"] == lowest["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small-star: a node and its smaller neighbours link to the smallest of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(lowest, large["a"] == lowest["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.unionAll(lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
