"""Ranks, buckets, runs and chunks: window operators that always break ties by position."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .relational import small


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """1, 2, ... in each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def buckets(df: DataFrame, by: Sequence[str], score: str, position: str, best: int | None = None) -> DataFrame:
    """The lowest scores are ng, the best of the others final_selected, the rest other_passing; columns rank and bucket."""
    best = scores.checked_count(best)
    group = Window.partitionBy(*by)
    df = df.withColumn("rank", F.row_number().over(group.orderBy(F.desc(score), position))).withColumn("_n", F.count("*").over(group))
    passing = F.col("_n") - scores.rejected_tail(F.col("_n"))
    wanted = scores.recommended_best(F.col("_n")) if best is None else F.lit(best)
    bucket = F.when(F.col("rank") > passing, "ng").when(F.col("rank") <= wanted, "final_selected").otherwise("other_passing")
    return df.withColumn("bucket", bucket).drop("_n")


def first_of(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each group in an order."""
    return numbered(df, by, order, "_first").where("_first = 1").drop("_first")


def backups(df: DataFrame, by: Sequence[str], score: str, position: str, most: int = 0) -> DataFrame:
    """Rows after the best, numbered from 2; `most` of them, 0 for all."""
    out = numbered(df, by, [F.desc(score), position], "backup_rank").where("backup_rank > 1")
    return out.where(F.col("backup_rank") <= most + 1) if most else out


def portrait_ranks(df: DataFrame, by: Sequence[str], score: str, bad: str, position: str) -> DataFrame:
    """Good ones by score, then bad ones as they come."""
    return numbered(df, by, [bad, F.when(~F.col(bad), -F.col(score)), position])


def islands(df: DataFrame, by: Sequence[str], position: str, goes_on: Column, name: str = "island") -> DataFrame:
    """A new run wherever `goes_on` is false; the first row of a group starts run 1."""
    order = Window.partitionBy(*by).orderBy(position)
    start = F.when(F.lag(F.lit(1)).over(order).isNull() | ~F.coalesce(goes_on, F.lit(True)), 1).otherwise(0)
    return df.withColumn("_start", start).withColumn(name, F.sum("_start").over(order)).drop("_start")


def chunks(df: DataFrame, by: Sequence[str], position: str, size: int, name: str = "chunk") -> DataFrame:
    """Groups of `size` rows in order, from 0."""
    return numbered(df, by, [position], "_n").withColumn(name, F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")


def sized_groups(df: DataFrame, by: Sequence[str], position: str, sizes: Sequence[int], name: str = "chunk") -> DataFrame:
    """Groups of the given sizes in order, what remains in one more."""
    bounds = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    passed = F.lit(0)
    for b in bounds:
        passed = passed + (F.col("_n") > b).cast("int")
    return numbered(df, by, [position], "_n").withColumn(name, passed).drop("_n")


def chunk_texts(df: DataFrame, by: Sequence[str], position: str, text: str, size: int = 18) -> DataFrame:
    """The texts of each chunk in one, a line each."""
    rows = chunks(df, by, position, size)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda r: r[text])
    return rows.groupBy(*by, "chunk").agg(F.count("*").alias("rows"), F.array_join(lines, "\n").alias("text"))


def group_numbers(df: DataFrame, by: Sequence[str], group: str, position: str, name: str = "number") -> DataFrame:
    """Groups numbered by their first position, 1, 2, ..."""
    first = df.groupBy(*by, group).agg(F.min(position).alias("_at"))
    first = first.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("_at", group))).drop("_at")
    return df.join(first, [*by, group])


def segments(separators: DataFrame, by: Sequence[str], index: str, total: Column) -> DataFrame:
    """From each separator to the next, the last to `total`; columns start and stop, stop excluded."""
    order = Window.partitionBy(*by).orderBy(index)
    return separators.withColumn("stop", F.coalesce(F.lead(index).over(order), total)).withColumnRenamed(index, "start")


def last_known(df: DataFrame, by: Sequence[str], position: str, value: str, name: str = "previous") -> DataFrame:
    """The last non-null value before each row."""
    before = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(before))


def balanced_order(df: DataFrame, by: Sequence[str], bucket: str, score: str, position: str) -> DataFrame:
    """One of each bucket per round, small buckets first; the exact form is in selection.select()."""
    own = Window.partitionBy(*by, bucket)
    df = df.withColumn("round", F.row_number().over(own.orderBy(F.desc(score), position))).withColumn("bucket_size", F.count("*").over(own))
    return numbered(df, by, ["round", "bucket_size", bucket], "pick")


def least_tier(df: DataFrame, by: Sequence[str], tiers: Sequence[Column]) -> DataFrame:
    """rows of the lowest tier that a group has a row in; a row's tier is the first condition that holds."""
    tier = F.lit(len(tiers))
    for k in range(len(tiers) - 1, -1, -1):
        tier = F.when(F.coalesce(tiers[k], F.lit(False)), k).otherwise(tier)
    df = df.withColumn("tier", tier)
    return df.withColumn("_least", F.min("tier").over(Window.partitionBy(*by))).where("tier <= _least").drop("_least")


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """(by, quantiles): exact percentiles of each group with interpolation, as an array beside `shares`; nulls do not count.

    A sketch brackets each percentile; only values between the brackets are counted one by one, the others are just
    counted, so no task holds a large group. Groups of up to ten times `accuracy` values are looked at whole.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    step = 2.0 / accuracy
    ends = [max(0.0, p - step) for p in shares] + [min(1.0, p + step) for p in shares]
    groups = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_b"))
    whole = F.col("_n") <= 10 * accuracy
    low = [F.when(whole | F.lit(p <= step), F.lit(float("-inf"))).otherwise(F.col("_b")[i]) for i, p in enumerate(shares)]
    high = [F.when(whole | F.lit(p >= 1 - step), F.lit(float("inf"))).otherwise(F.col("_b")[len(shares) + i]) for i, p in enumerate(shares)]
    # A missing column that all groups share, so that no grouping is one group.
    every = list(by) or ["_all"]
    groups = groups.select(*by, F.lit(0).alias("_all"), "_n", F.array(*low).alias("_low"), F.array(*high).alias("_high"))
    met = rows.withColumn("_all", F.lit(0)).join(small(groups), [*by, "_all"])
    below = met.groupBy(*every).agg(F.max("_n").alias("_n"), *[F.count_if(F.col("_v") < F.col("_low")[i]).alias(f"_below{i}") for i in range(len(shares))])
    inside = F.filter(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: (F.col("_v") >= F.col("_low")[i]) & (F.col("_v") <= F.col("_high")[i]))
    counted = met.select(*every, "_v", F.explode(inside).alias("_i")).groupBy(*every, "_i", "_v").agg(F.count("*").alias("_c"))
    counted = counted.join(below, every)
    upto = F.sum("_c").over(Window.partitionBy(*every, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    before = F.element_at(F.array(*[F.col(f"_below{i}") for i in range(len(shares))]), F.col("_i") + 1)
    place = F.element_at(F.array(*[F.lit(float(p)) for p in shares]), F.col("_i") + 1) * (F.col("_n") - 1)
    counted = counted.select(*every, "_i", "_v", (before + upto).alias("_upto"), place.alias("_place"))
    at = counted.groupBy(*every, "_i").agg(
        F.min(F.when(F.col("_upto") > F.floor("_place"), F.col("_v"))).alias("_a"), F.min(F.when(F.col("_upto") > F.ceil("_place"), F.col("_v"))).alias("_b"), F.max(F.col("_place") - F.floor("_place")).alias("_share"),
    )
    each = F.array_sort(F.collect_list(F.struct("_i", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")).alias("q"))))
    return at.groupBy(*every).agg(F.transform(each, lambda x: x["q"]).alias("quantiles")).select(*by, "quantiles")


def _bounds_below(value: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending bounds are below a long, by halving."""
    places = np.array(bounds, np.int64)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.searchsorted(places, batch.to_numpy(np.int64), "left").astype(np.int32))

    return F.pandas_udf(run, "int", F.PandasUDFType.SCALAR_ITER)(value)


def numbered_in_all(df: DataFrame, order: Sequence[Column | str], lead: Column, name: str = "rank", ranges: int = 200) -> DataFrame:
    """1, 2, ... over the whole table without one task that sees all rows. `lead` is a long that ascends with `order`.

    Rows are dealt to ranges of `lead`, numbered there, and moved on by the number of rows in the ranges before.
    """
    rows = df.withColumn("_lead", lead)
    bounds = sorted(set(rows.select(F.percentile_approx("_lead", [k / ranges for k in range(1, ranges)], 4 * ranges)).first()[0] or []))
    rows = rows.withColumn("_range", _bounds_below(F.coalesce("_lead", F.lit(-(1 << 63))), bounds) if bounds else F.lit(0))
    counts = rows.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per range
    rows = rows.join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    return numbered(rows, ["_range"], order, name).withColumn(name, F.col(name) + F.col("_before")).drop("_lead", "_range", "_before")


def text_lead(text: Column, kind: Column) -> Column:
    """A long that ascends with a small non-negative number and then with a text: the number and the text's first seven bytes."""
    head = F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return F.shiftleft(kind.cast("long"), 56) + F.coalesce(head, F.lit(0))
