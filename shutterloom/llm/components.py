"""Connected components of a link table, by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


def components(links: DataFrame, tables: Tables, most_rounds: int = 60) -> DataFrame:
    """(id, component): for each end of a link the smallest id that links reach; links has columns a, b.

    Each step groups by node (with partial aggregation, so a node with very many links is no hot key) and joins the
    minimum back, which adaptive execution splits when skewed. Rounds are logarithmic in the longest path.
    Nulls and self links are ignored; an empty table gives an empty table.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = tables.put(e, "links")
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, tables.put(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        tables.drop(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"no fixed point within {most_rounds} rounds")
    top = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(top)
