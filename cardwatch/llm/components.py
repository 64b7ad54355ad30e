"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.shared import stage


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """links(u, v) -> (node, component): the smallest node reachable, for linked nodes.

    Large-star and small-star steps in turn: each node hangs its neighbours on the
    smallest of them, until every component is a star. Each step is one aggregation and
    one join on a node, whose other side is one row per node; each round is written to
    the shared folder. Rounds grow with the logarithm of a component's size. No side is
    broadcast: written links are small files but many times that in a driver's memory.
    """
    edges = links.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = stage(edges.distinct(), "links")
    before = _digest(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        low = low.select("u", F.least("u", "low").alias("low"))
        large = both.join(low.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = stage(large.distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        hung = large.join(low.hint("merge"), "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = stage(hung.union(low.select("u", F.col("low").alias("v"))).distinct(), "small-star")
        after = _digest(edges)
        if after == before:
            break
        before = after
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)
