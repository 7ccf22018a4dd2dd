"""Connected components of a table of links, by alternating star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import dropped, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each end of a link (a, b) the least node that links reach. Nulls and self links say nothing.

    A round joins each node's neighbours to the least of them, first the larger ones, then the smaller ones; both are
    minima with partial aggregation and joins that split where they are skewed, so a node with very many links is no
    hot key. The rounds grow with the logarithm of the longest path.
    """
    edges = written(links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high <> low").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(edges.select(F.col("low").alias("node"), F.col("high").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
        larger = both.join(least, "node").where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other")).distinct()
        least = larger.groupBy("node").agg(F.min("other").alias("least"))
        smaller = larger.join(least, "node").where("other <> least").select(F.col("other").alias("high"), F.col("least").alias("low"))
        before, edges = edges, written(smaller.unionByName(least.select(F.col("node").alias("high"), F.col("least").alias("low"))).distinct(), "stars")
        dropped(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point within {most_rounds} rounds")
    top = edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(top)
