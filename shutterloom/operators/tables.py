"""Small table operators that the pipelines share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as fixed

EVALUATION_COLUMNS = "file string, club string, formality double, beauty double, expression double, emotion double, people_count double, gesture_penalty double, is_ng boolean, ng_reason string, comment string"
RULES = "event string, tag_groups array<array<string>>, landmarks int, cheering struct<least: int, most: int>, transit_most int, by_class boolean, by_day boolean, ball boolean"


def empty_evaluations(spark: SparkSession) -> DataFrame:
    """H11."""
    return spark.createDataFrame([], EVALUATION_COLUMNS)


def united(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def public(df: DataFrame) -> DataFrame:
    """Without columns whose names start with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def club_items(df: DataFrame) -> DataFrame:
    """Rows with an item id of club and file, and a link."""
    return df.withColumn("item_id", F.concat_ws("::", "club", "file")).withColumn("link", F.concat(F.lit("/preview?path="), F.url_encode("file")))


def event_rules(spark: SparkSession) -> DataFrame:
    """The rules as a table."""
    return spark.createDataFrame([(k, *v) for k, v in fixed.EVENT_RULES.items()], RULES)


def with_rules(df: DataFrame, event: str = "event") -> DataFrame:
    """Rows with the rules of their event, those of general if it is unknown."""
    known = F.when(F.col(event).isin(*fixed.EVENT_RULES), F.col(event)).otherwise("general")
    return df.withColumn("_event", known).join(F.broadcast(event_rules(df.sparkSession).withColumnRenamed("event", "_event")), "_event").drop("_event")


def preview(cells: DataFrame, rows: int = 100) -> DataFrame:
    """The header and the first `rows` rows of each sheet, with the cells in order."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("v")))), lambda x: x["v"])
    return cells.where(F.col("row") <= rows + 1).groupBy("sheet", "row").agg(line.alias("cells")).orderBy("sheet", "row")


def on_layer(items: DataFrame, name: str, other: str | None = None) -> DataFrame:
    """Items of a layer, or of the other one."""
    return items.where(F.col("layer").isin(*[n for n in (name, other) if n]))


def overridden(base: Column, changes: Sequence[Column]) -> Column:
    """A map with changes written over it, the last one winning."""
    def merge(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return reduce(merge, changes, base)


def corrected(rows: DataFrame, corrections: DataFrame, key: str, name: str) -> DataFrame:
    """Values entered by hand over those found."""
    found = corrections.select(key, F.col(name).alias("_by_hand")).dropDuplicates([key])
    return rows.join(found, key, "left").withColumn(name, F.coalesce("_by_hand", name)).drop("_by_hand")


def resolved_numbers(log: DataFrame) -> DataFrame:
    """One map from picture to number of all resolved reviews of a folder."""
    return log.where("status = 'resolved'").groupBy("folder").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("image_path", "number")))).alias("numbers"))


def as_list(value: Column, kind: str) -> Column:
    """Null as an empty list."""
    return F.coalesce(value, F.array().cast(f"array<{kind}>"))


def existing(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths that are in the listing."""
    return paths.join(listing.select("path").distinct(), "path", "left_semi")


def resolved_file(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """For each name the file with that relative path, in the order of roots, else one of that bare name."""
    exact = wanted.join(files.select(F.col("rel").alias("name"), "path", F.lit(0).alias("tier"), "root"), "name")
    bare = wanted.join(files.select(F.regexp_extract("rel", r"([^/]*)$", 1).alias("name"), "path", F.lit(1).alias("tier"), "root"), "name")
    return exact.unionByName(bare).groupBy("name").agg(F.min_by("path", F.struct("tier", "root", "path")).alias("path"))


def top_shown(df: DataFrame, score: str, position: str, n: int) -> DataFrame:
    """H17."""
    return df.orderBy(F.desc(score), position).limit(n)


def report_order(df: DataFrame) -> DataFrame:
    """Clusters in order, representatives first, then by file."""
    return df.orderBy("cluster", F.desc("representative"), "file")


def catalog_order(name: Column, first: Sequence[str] = ("summary.csv", "ranking.csv")) -> Column:
    """Named files first, then by name."""
    place = F.array_position(F.array(*[F.lit(n) for n in first]), name)
    return F.struct(F.when(place > 0, place).otherwise(len(first) + 1).alias("place"), name.alias("name"))


def placeholder(path: Column, absent: Column, picture: str = "absent.png") -> Column:
    """The marker picture for those absent."""
    return F.when(absent, picture).otherwise(path)


def fitted(image_w: Column, image_h: Column, frame_w: Column, frame_h: Column, scale: Column, dx: Column, dy: Column) -> Column:
    """struct(x, y, w, h) of a picture that fills a frame, is scaled around the frame's centre by percent and shifted."""
    # Wide pictures multiply before they divide, as the SQL of H26 does: the last bits decide ties of rounding.
    wide = image_w / image_h > frame_w / frame_h
    w = F.when(wide, frame_h * image_w / image_h).otherwise(frame_w) * scale / 100
    h = F.when(wide, frame_h).otherwise(frame_w / (image_w / image_h)) * scale / 100
    return F.struct(((frame_w - w) / 2 + dx).alias("x"), ((frame_h - h) / 2 + dy).alias("y"), w.alias("w"), h.alias("h"))


def rounded_points(landmarks: Column, first: int, last: int) -> Column:
    """H33."""
    return F.transform(F.slice(landmarks, first + 1, last - first + 1), lambda p: F.struct(F.round(p["x"], 1).alias("x"), F.round(p["y"], 1).alias("y")))


def pages_by_way(rows_per_page: DataFrame, least: int = 8) -> DataFrame:
    """The choice of M11 by page: pages with at least `least` text rows go the text way, others the picture way."""
    return rows_per_page.groupBy("file", "page").agg(F.count("row").alias("n")).withColumn("way", F.when(F.col("n") >= least, "text").otherwise("picture"))


def numbered_files(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Portraits of a person named by rank, the first being the best shot."""
    order = Window.partitionBy(*by).orderBy("is_ng", F.desc("score"), "pos")
    out = df.withColumn("rank", F.row_number().over(order))
    return out.withColumn("best", F.col("rank") == 1).withColumn("folder", F.when(F.col("matched"), "matched").otherwise("unmatched"))
