"""Vectors as array columns; sums run in double precision inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    """The inner product, 0 where either is null."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(total, F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Inner product by norms, with a trace added so that zero vectors give 0."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(TINY))


def centroids(df: DataFrame, by: list[str], vector: str = "emb", name: str = "centroid") -> DataFrame:
    """Per group the mean vector scaled to length one. Dimensions are averaged apart, so partial sums combine before the shuffle."""
    parts = df.select(*by, F.posexplode(vector).alias("dim", "x"))
    means = parts.groupBy(*by, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("v"))
    mean = F.transform("v", lambda p: p["m"])
    rows = rows.select(*by, mean.alias("mean"))
    return rows.select(*by, F.transform("mean", lambda m: m / (norm(F.col("mean")) + F.lit(TINY))).alias(name))
