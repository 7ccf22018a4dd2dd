"""First-fit clustering of events of any length: the fold is cut where no rule can reach across."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written
from . import clustering
from .components import components
from .relational import small

#: Added to the widest gap in seconds, for what double precision takes from times of microseconds.
MARGIN = 0.001
#: Groups that rows of an event with neither time nor number are dealt to; no rule reaches them.
LONE = 64
#: Rows of an event that is folded whole, at most.
WHOLE = 2000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a time as it is written, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts.cast("timestamp_ntz"))


def stretches(rows: DataFrame, by: str, value: Column, reach: float, kind: str) -> tuple[DataFrame, Column]:
    """Cells of width `reach` with the stretch each belongs to, as (by, _cell, node); and the cell of a row.

    Values in one cell are within reach of each other, those of neighbouring cells are linked if the least of the upper
    one is within reach of the largest of the lower one, and others are out of reach: so stretches follow from the ends
    of cells, of which a window sees one row each.
    """
    cell = F.floor(value / F.lit(reach)).cast("long")
    cells = rows.where(value.isNotNull()).select(by, cell.alias("_cell"), value.alias("_v")).groupBy(by, "_cell").agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    order = Window.partitionBy(by).orderBy("_cell")
    gap = F.col("low") - F.lag("high").over(order) > reach
    first = F.last(F.when(F.coalesce(gap, F.lit(True)), F.col("_cell")), ignorenulls=True).over(order)
    cells = cells.withColumn("cut", gap).withColumn("first", first)
    return written(cells.select(by, "_cell", F.xxhash64(F.lit(kind), by, "first").alias("node")), f"stretches-{kind}"), cell


def with_islands(rows: DataFrame, by: str, seconds: float, steps: float) -> DataFrame:
    """`rows` (by, id, ts, seq, ...) with `island`: rows of an event in different islands are farther apart than both
    `seconds` and `steps`, or their gaps are unknown.

    Islands are the components of stretches in time and stretches of numbers, linked by the rows that lie in both.
    Two islands could share a hash and so be one; that joins what need not be joined and splits nothing. A row with
    neither time nor number is reached by no rule.
    """
    out = rows
    for kind, value, reach in (("time", micros(F.col("ts")), (seconds + MARGIN) * 1e6), ("step", F.col("seq").cast("double"), float(steps))):
        if reach <= 0:
            out = out.withColumn(f"_{kind}", F.lit(None).cast("long"))
            continue
        cells, cell = stretches(rows, by, value, reach, kind)
        cells = cells.select(F.col(by).alias("_by"), F.col("_cell").alias("_at"), F.col("node").alias(f"_{kind}"))
        met = out.withColumn("_cell", cell)
        out = met.join(small(cells), met[by].eqNullSafe(cells["_by"]) & (met["_cell"] == cells["_at"]), "left").drop("_cell", "_by", "_at")
    out = written(out, "met")
    links = out.where("_time IS NOT NULL AND _step IS NOT NULL").select(F.col("_time").alias("a"), F.col("_step").alias("b")).distinct()
    found = components(links)
    lone = F.xxhash64(F.lit("lone"), by, F.pmod(F.xxhash64("id"), F.lit(LONE)))
    node = F.coalesce("_time", "_step", lone)
    met = out.withColumn("node", node).join(small(found), "node", "left")
    return met.withColumn("island", F.coalesce("component", "node")).drop("node", "component", "_time", "_step")


def first_fit_clusters(photos: DataFrame, by: str, rules: Sequence[tuple] = clustering.SERVICE_RULES, whole: int = WHOLE) -> DataFrame:
    """C01 over photos of events of any length: those of more than `whole` rows are cut into islands. See first_fit_islands."""
    events = photos.groupBy(by).count().where(F.col("count") > whole).select(F.col(by).alias("_by"))
    events = written(events, "long")
    if events.isEmpty():
        return clustering.first_fit_clusters(photos, by, rules)
    same = F.col(by).eqNullSafe(F.col("_by"))
    short = clustering.first_fit_clusters(photos.join(small(events), same, "left_anti"), by, rules)
    return short.unionByName(first_fit_islands(photos.join(small(events), same, "left_semi"), by, rules))


def first_fit_islands(photos: DataFrame, by: str, rules: Sequence[tuple] = clustering.SERVICE_RULES) -> DataFrame:
    """C01 over photos (by, id, name, ts, seq, emb, focus), in order of time, unknown first, name and id: (by, id, pos, cluster).

    Clusters are those of the fold over a whole event, numbered in the order in which they open, but a task folds one
    island. Positions and numbers are counted within cells of time and moved on by the counts of the cells before. Rows
    of an event without a time are one cell. Null times and numbers are unknown; a null event is an event. An empty
    table gives an empty table.
    """
    seconds, steps = max(r[1] for r in rules), max((r[2] or 0) for r in rules)
    rows = with_islands(photos.select(by, "id", "name", "ts", "seq", "emb", "focus"), by, seconds, steps)

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["ts", "name", "id"], kind="stable", na_position="first").reset_index(drop=True)
        own = clustering.first_fit(clustering._matrix(p.emb), clustering._seconds(p.ts), p.seq.to_numpy(float), p.focus.to_numpy(float), rules)
        own = pd.Series(own, dtype="int64")
        return pd.DataFrame({by: p[by], "id": p.id, "name": p["name"], "ts": p.ts, "island": p.island, "own": own, "opens": (~own.duplicated()).astype("int64")})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (by, "id", "name", "ts")}
    folded = rows.groupBy(by, "island").applyInPandas(fold, ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()) + ", island long, own long, opens long")
    cell = F.floor(micros(F.col("ts")) / F.lit((seconds + MARGIN) * 1e6)).cast("long")
    folded = written(folded.withColumn("_cell", cell), "folded")
    inside = Window.partitionBy(by, "_cell").orderBy("ts", "name", "id")
    before = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = folded.groupBy(by, "_cell").agg(F.count("*").alias("rows"), F.sum("opens").alias("opened"))
    cells = cells.select(F.col(by).alias("_by"), F.col("_cell").alias("_at"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("rows", "opened")])
    placed = folded.withColumn("in_cell", F.row_number().over(inside)).withColumn("opened", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(small(cells), F.col(by).eqNullSafe(F.col("_by")) & F.col("_cell").eqNullSafe(F.col("_at")))
    placed = placed.select(by, "id", "island", "own", "opens", (F.col("rows_before") + F.col("in_cell") - 1).cast("int").alias("pos"), (F.col("opened_before") + F.col("opened") - 1).cast("int").alias("number"))
    placed = written(placed, "placed")
    numbers = placed.where("opens = 1").select(F.col(by).alias("_by"), F.col("island").alias("_island"), F.col("own").alias("_own"), F.col("number").alias("cluster"))
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("island") == F.col("_island")) & (F.col("own") == F.col("_own"))
    return placed.drop("number").join(numbers, same).select(by, "id", "pos", "cluster")
