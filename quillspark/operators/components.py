"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import Scratch, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, cut: Callable = materialize) -> DataFrame:
    """Label every node of an undirected edge table with the smallest node of its component.

    Returns ``(node, component)``, one row for each node that has an edge; edges with a null end are
    ignored and self-loops name their node. Each round hangs the larger neighbours of a node on the smallest of its
    neighbourhood and then the smaller ones too (Kiveris et al.), until every component is a star: paths of any order of
    names are halved, so the rounds grow with the logarithm of the longest path. There are never more edges than at first.
    Nothing is sent to the driver but one count a round; the tables of the rounds go when the last one ends.
    """
    links = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    with Scratch(edges.sparkSession) as own:
        step = own if cut is materialize else cut
        pairs = step(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
        stars = pairs.where("u <> v")
        for _ in range(max_rounds):
            both = stars.union(stars.select("v", "u"))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
            large = step(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "cc-large")
            low = large.groupBy("u").agg(F.min("v").alias("low"))
            small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
            stars = step(small.union(low).distinct(), "cc-small")
            # a star: every node hangs on one node, and that one on none
            above = stars.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(2))
            left = stars.select("u", F.lit(1).alias("n")).union(above).groupBy("u").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("least = 1 and n > 1")
            if not left.limit(1).count():
                break
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        return cut(nodes.join(stars.toDF("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "cc-labels")
