"""Layout geometry: guides in frames, canonical offsets and guide ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from . import clustering, relational

#: Distance in mm inside which a guide stands for a wanted height, and cells for joining guides with frames.
REACH, CELL = 5.0, 25.0
SCALE_CLAMP = (100.0, 400.0)


def bounds(top: Column, left: Column, bottom: Column, right: Column) -> Column:
    """struct(top, left, bottom, right, width, height)."""
    return F.struct(top.alias("top"), left.alias("left"), bottom.alias("bottom"), right.alias("right"), (right - left).alias("width"), (bottom - top).alias("height"))


def _guides_at(guides: DataFrame, by: str) -> DataFrame:
    """Distinct heights of guides (by, y) with the number of guides there."""
    return guides.groupBy(by, "y").agg(F.count("*").alias("_guides"))


def canonical_offsets(frames: DataFrame, guides: DataFrame, by: str) -> DataFrame:
    """Per page the usual offsets of a frame's first guide and of later ones: (by, top_offset, bottom_offset).

    frames: by, frame, top, bottom, each frame once; guides: by, y. Guides count strictly inside a frame by half a
    millimetre; lower ones from 5 mm below the first. Frames of equal edges and guides of equal height meet once, with
    their numbers, so pairs grow with the different heights of a page.
    """
    spans = frames.groupBy(by, "top", "bottom").agg(F.count("*").alias("_frames")).withColumn("low", F.col("top") + 0.5).withColumn("high", F.col("bottom") - 0.5)
    first = relational.ends_within(guides, spans, [by], "y", "low", "high").select(by, "low", "high", "first")
    spans = spans.join(first, [by, "low", "high"])
    inside = relational.within_bands(_guides_at(guides, by), spans, [by], "y", "low", "high", CELL)
    inside = inside.withColumn("offset", F.col("y") - F.col("top")).withColumn("_rows", F.col("_guides") * F.col("_frames"))
    tops = clustering.modal_values(inside.where("y = first"), by, "offset", rows_of="_rows").withColumnRenamed("offset", "top_offset")
    lower = clustering.modal_values(inside.where(F.col("y") > F.col("first") + 5), by, "offset", rows_of="_rows").withColumnRenamed("offset", "bottom_offset")
    return tops.drop("n").join(lower.drop("n"), by)


def guide_ratios(frames: DataFrame, guides: DataFrame, canonical: DataFrame, by: str) -> DataFrame:
    """Per frame the guides nearest to the canonical offsets, within REACH, as shares of its height; null if one is missing."""
    rows = frames.select(by, "top", "bottom").distinct().join(relational.small(canonical), by)
    wanted = rows.select(by, "top", "bottom", F.explode(F.array(F.struct(F.lit("top").alias("kind"), (F.col("top") + F.col("top_offset")).alias("target")), F.struct(F.lit("bottom").alias("kind"), (F.col("top") + F.col("bottom_offset")).alias("target")))).alias("t"))
    wanted = wanted.select(by, "top", "bottom", "t.*").withColumn("low", F.col("target") - REACH - 1e-9).withColumn("high", F.col("target") + REACH + 1e-9)
    near = relational.within_bands(_guides_at(guides, by), wanted, [by], "y", "low", "high", CELL)
    near = near.select(by, F.col("top").alias("_top"), F.col("bottom").alias("_bottom"), "kind", "y", "target")
    best = near.groupBy(by, "_top", "_bottom").pivot("kind", ["top", "bottom"]).agg(F.min_by("y", F.struct(F.abs(F.col("y") - F.col("target")), "y")))
    best = best.select(by, F.col("_top").alias("top"), F.col("_bottom").alias("bottom"), F.col("top").alias("top_y"), F.col("bottom").alias("bottom_y"))
    height = F.col("bottom") - F.col("top")
    both = F.col("top_y").isNotNull() & F.col("bottom_y").isNotNull()
    share = lambda c: F.when(both, F.round((F.col(c) - F.col("top")) / height, 4))
    return frames.join(best, [by, "top", "bottom"], "left").select(by, "frame", share("top_y").alias("top_ratio"), share("bottom_y").alias("bottom_ratio"))


def strict_ratios(frames: DataFrame, guides: DataFrame, by: str) -> DataFrame:
    """Per frame (by, frame, top, bottom) the first and last guide strictly inside, as shares of its height; null with fewer than two."""
    ends = relational.ends_within(guides, frames, [by], "y", "top", "bottom").where("n >= 2")
    share = lambda c: F.round((F.col(c) - F.col("top")) / (F.col("bottom") - F.col("top")), 3)
    return frames.join(ends, [by, "top", "bottom"], "left").select(by, "frame", share("first").alias("top_ratio"), share("last").alias("bottom_ratio"))


def own_guides(guides: DataFrame, student_frames: DataFrame, canonical: DataFrame, by: str, reach: float = 1.5) -> DataFrame:
    """Guides that are not where a student row has its guides, for frames outside the grid."""
    rows = student_frames.select(by, "top").distinct().join(relational.small(canonical), by)
    taken = rows.select(by, F.explode(F.array(F.col("top") + F.col("top_offset"), F.col("top") + F.col("bottom_offset"))).alias("at")).distinct()
    bands = taken.withColumn("low", F.col("at") - reach - 1e-9).withColumn("high", F.col("at") + reach + 1e-9)
    hit = relational.within_bands(_guides_at(guides, by), bands, [by], "y", "low", "high", CELL).select(by, "y").distinct()
    return guides.join(hit, [by, "y"], "left_anti")


def manifest_offsets(entries: DataFrame, roles: DataFrame, fallback: tuple[float, float, float] = (-3.5, 12.0, 127.0)) -> DataFrame:
    """P20: entries (role, image_w, image_h, center_x, chin_y, eye_dist) with offsets and the way they were found.

    roles: role, frame_w, frame_h, top_ratio, bottom_ratio. Without a face, or with an unknown role, the fallback stands.
    """
    rows = entries.join(F.broadcast(roles), "role", "left")  # a handful of roles
    face = {n: F.col(n) for n in ("image_w", "image_h", "center_x", "chin_y", "eye_dist")}
    eyes = scores.target_eye_distance(F.col("top_ratio"), F.col("bottom_ratio"), F.col("frame_w"), F.col("frame_h"))
    placed = scores.placement(face, F.col("frame_w"), F.col("frame_h"), F.coalesce("bottom_ratio", F.lit(0.86)), eyes, *SCALE_CLAMP)
    method = F.when(F.col("frame_w").isNull(), "no_frame").when(F.col("chin_y").isNull() | F.col("eye_dist").isNull(), "no_face").when(F.col("bottom_ratio").isNull(), "default_guides").otherwise("guides")
    fixed = F.struct(*[F.lit(v).alias(n) for n, v in zip(("offset_x", "offset_y", "scale"), fallback, strict=True)])
    out = F.when(method.isin("no_frame", "no_face"), fixed).otherwise(placed)
    return rows.select(*entries.columns, out.alias("_o"), method.alias("method")).select(*entries.columns, "_o.offset_x", "_o.offset_y", "_o.scale", "method")
