"""Scores of photos and faces as column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# The flags that reject a group photo, in the strict tier.
HARD_FLAGS = (
    "has_hand_gesture has_exaggerated_expression eyes_closed face_obscured subject_falling eating_or_mouth_full "
    "strange_obscene_posing bad_pose visible_underwear severe_framing_issue"
).split()
OLD_HARD_FLAGS = HARD_FLAGS[:4]


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Between the bounds; an unknown value stays unknown, where greatest and least alone would make it a bound."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def between_extremes(value: Column, by: Sequence[Column | str] = ()) -> Column:
    """Place between the group's minimum and maximum, a half where these are as good as equal."""
    over = Window.partitionBy(*by)
    low, high = F.min(value).over(over), F.max(value).over(over)
    flat = F.abs(high - low) <= F.lit(1e-9) * F.greatest(F.abs(high), F.abs(low))
    return F.when(flat, F.lit(0.5)).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def snap_score(focus: Column, brightness: Column, composition: Column, rarity: Column) -> Column:
    """P01 from normalised parts; medium brightness is best."""
    return F.lit(0.30) * focus + F.lit(0.25) * (1 - F.abs(brightness - 0.55)) + F.lit(0.25) * composition + F.lit(0.20) * rarity


def exposure_balance(brightness: Column) -> Column:
    """P15."""
    return F.greatest(F.lit(0.0), 1 - F.abs(brightness - 128) / 128)


def orientation(width: Column, height: Column) -> Column:
    """P16."""
    return F.when(width > height, "horizontal").when(width < height, "vertical").otherwise("square")


def within_percentiles(value: Column, low: Column, high: Column) -> Column:
    """A05 given the 5th and 95th percentile: clipped place between them, a half where they are equal or unknown."""
    return F.when(high > low, clipped((value - low) / (high - low))).otherwise(0.5)


def representative_quality(focus: Column, brightness: Column, contrast: Column, resolution: Column, width: Column, height: Column) -> Column:
    """P03 from normalised focus, contrast and resolution; very long shapes lose a little."""
    ratio = width / F.greatest(height, F.lit(1))
    odd = F.when((ratio > 2.5) | (ratio < 0.40), 0.06).otherwise(0.0)
    return F.lit(0.48) * focus + F.lit(0.22) * exposure_balance(brightness) + F.lit(0.15) * contrast + F.lit(0.15) * resolution - odd


def redundancy_penalty(similar: Column, duplicate: Column, burst: Column) -> Column:
    return F.lit(0.15) * similar.cast("int") + F.lit(0.10) * burst.cast("int") + F.lit(0.20) * duplicate.cast("int")


def integrated_quality(technical: Column, expression: Column, composition: Column, rarity: Column) -> Column:
    return F.lit(0.30) * technical + F.lit(0.25) * expression + F.lit(0.25) * composition + F.lit(0.20) * rarity


def integrated_total(quality: Column, event: Column, grade: Column, penalty: Column, is_ng: Column) -> Column:
    """Rejected photos score 0."""
    return F.when(is_ng, 0.0).otherwise((F.lit(0.80) * quality + F.lit(0.15) * event + F.lit(0.05) * grade) * (1 - penalty))


def club_weighted(formality: Column, beauty: Column, expression: Column, emotion: Column, people: Column) -> Column:
    return formality * F.lit(0.30) + beauty * F.lit(0.25) + expression * F.lit(0.15) + emotion * F.lit(0.10) + people * F.lit(0.20)


def club_score(weighted: Column, gesture: Column, closed: Column) -> Column:
    """P05."""
    return F.round(weighted - gesture - closed * F.lit(0.75), 3)


def club_rejected(is_ng: Column, eyes_closed: Column, closed: Column) -> Column:
    """Rejected by the model, or closed eyes that both model and detector saw."""
    return F.coalesce(is_ng, F.lit(False)) | (F.coalesce(eyes_closed, F.lit(False)) & (closed > 0))


def fallback_evaluation(people: Column, closed: Column) -> Column:
    """What stands in for a missing model answer."""
    eight = F.greatest(F.lit(0), F.lit(8) - closed)
    return F.struct(
        eight.alias("formality"), F.lit(7).alias("beauty"), eight.alias("expression"), F.lit(7).alias("emotion"), F.least(F.lit(10), F.greatest(F.lit(1), people)).alias("people_count"),
        (closed > 0).alias("eyes_closed"), (people == 0).alias("is_ng"), F.when(people == 0, "no face detected").otherwise("").alias("ng_reason"),
    )


def rule_penalty(gesture: Column, hand: Column, exaggerated: Column) -> Column:
    """P07."""
    return gesture * F.lit(0.7) + hand.cast("int") * F.lit(2.0) + exaggerated.cast("int") * F.lit(1.5)


def club_weighted_old(formality: Column, beauty: Column, expression: Column, emotion: Column) -> Column:
    """P08."""
    return formality * F.lit(0.35) + beauty * F.lit(0.30) + expression * F.lit(0.20) + emotion * F.lit(0.15)


def any_flag(flags: Sequence[str] = HARD_FLAGS) -> Column:
    """whether one of the flag columns is set; null counts as unset."""
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(F.col(f), F.lit(False))
    return out


def portrait_composite(suitability: Column, beauty: Column, expression: Column, is_ng: Column) -> Column:
    """P09."""
    return F.when(is_ng, -1.0).otherwise(F.round(F.lit(0.50) * suitability + F.lit(0.30) * beauty + F.lit(0.20) * expression, 4))


def portrait_model_score(suitability: Column, expression: Column, beauty: Column, fallback: Column) -> Column:
    """The model's parts if all are there, else the local score."""
    return F.coalesce(F.round(F.lit(0.50) * suitability + F.lit(0.30) * expression + F.lit(0.20) * beauty, 2), fallback)


def eye_ratio(landmarks: Column, first: int, last: int) -> Column:
    """Height by width of the points first..last (from 0); 0 where they are less than one wide, null where points are missing."""
    points = F.slice(landmarks, first + 1, last - first + 1)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    width, height = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    return F.when(F.size(landmarks) > last, F.when(width < 1, 0.0).otherwise(height / F.greatest(width, F.lit(1.0))))


def eye_ratio_or_null(landmarks: Column, first: int, last: int) -> Column:
    """As X07 to four places, null where the points are less than one wide."""
    ratio = eye_ratio(landmarks, first, last)
    return F.round(F.nullif(ratio, F.lit(0.0)), 4)


LEFT_EYE, RIGHT_EYE, CLOSED_BELOW = (33, 42), (87, 96), 0.24


def eyes_closed(left: Column, right: Column, limit: float = CLOSED_BELOW) -> Column:
    """either eye at or below the limit; unknown unless both are known."""
    return F.when(left.isNotNull() & right.isNotNull(), (left <= limit) | (right <= limit))


def eye_penalty(left: Column, right: Column) -> Column:
    """0 from a mean ratio of .30 on, 1 up to .16, 0 if unknown."""
    return F.coalesce(clipped((F.lit(0.30) - (left + right) / 2) / F.lit(0.30 - 0.16)), F.lit(0.0))


def pose_parts(pitch: Column, yaw: Column, roll: Column) -> list[tuple[str, Column]]:
    return [
        ("pitch-down", F.when(pitch > 18, clipped((pitch - 18) / 20))),
        ("pitch-up", F.when(pitch < -15, clipped((-pitch - 15) / 20) * 0.5)),
        ("yaw", F.when(F.abs(yaw) > 25, clipped((F.abs(yaw) - 25) / 25))),
        ("roll", F.when(F.abs(roll) > 20, clipped((F.abs(roll) - 20) / 20) * 0.6)),
    ]


def pose_penalty(pitch: Column, yaw: Column, roll: Column) -> Column:
    """Ramps added up, 1 at most."""
    total = F.lit(0.0)
    for _, part in pose_parts(pitch, yaw, roll):
        total = total + F.coalesce(part, F.lit(0.0))
    return F.least(F.lit(1.0), total)


def pose_flags(pitch: Column, yaw: Column, roll: Column) -> Column:
    """Names of the ramps that apply."""
    return F.array_compact(F.array(*[F.when(part.isNotNull(), name) for name, part in pose_parts(pitch, yaw, roll)]))


def frontal_score(box: Column, image_width: Column) -> Column:
    """Shape and centring of a face box struct(x, y, w, h); .2 without a face."""
    shape = clipped((box["w"] / F.greatest(box["h"], F.lit(1)) - 0.45) / F.lit(0.90 - 0.45))
    middle = clipped(1 - F.abs((box["x"] + box["w"] / 2) / image_width - 0.5) / 0.30)
    return F.when(box.isNull(), 0.2).otherwise(shape * 0.6 + middle * 0.4)


def portrait_local(det: Column, pose: Column, eye: Column, sharp: Column, bright: Column, gesture: Column) -> Column:
    """P10: the score with a face model; penalties as inputs."""
    raw = F.least(det, F.lit(1.0)) * 10 * 0.10 + (1 - pose) * 10 * 0.30 + (1 - eye) * 10 * 0.30 + F.least(sharp / 200, F.lit(1.0)) * 10 * 0.15 + (1 - F.abs(bright - 140) / 140) * 10 * 0.15
    return F.round(raw * (1 - gesture * 0.80), 2)


def portrait_fallback(sharp: Column, bright: Column, face_share: Column, frontal: Column, gesture: Column) -> Column:
    """P10: the score without a face model."""
    raw = F.least(sharp / 200, F.lit(1.0)) * 10 * 0.25 + (1 - F.abs(bright - 140) / 140) * 10 * 0.20 + F.least(face_share / 0.08, F.lit(1.0)) * 10 * 0.20 + frontal * 10 * 0.35
    return F.round(raw * (1 - gesture * 0.80), 2)


def recommended_best(n: Column, share: float = 0.30) -> Column:
    """That share of n, half to even, one at least; 0 of nothing."""
    return F.when(n < 1, 0).otherwise(F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("int")))


def rejected_tail(n: Column, share: float = 0.05) -> Column:
    """That share of n, half to even, one at least, but never all; 0 of one or none."""
    return F.when(n <= 1, 0).otherwise(F.least(F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("int")), n.cast("int") - 1))


def checked_count(count: int | None, most: int = 200) -> int | None:
    """a requested number of photos, a whole number from 1 to `most`."""
    if count is None:
        return None
    if isinstance(count, bool) or not isinstance(count, int) or not 1 <= count <= most:
        raise ValueError(f"the count must be a whole number from 1 to {most}")
    return count


def final_rank(value: Column) -> Column:
    """a rank from 1 to 999; words for exclusion give null, anything else fails."""
    word = F.lower(F.trim(value))
    number = word.try_cast("int")
    out = F.when(value.isNull() | word.isin("", "exclude", "excluded", "none", "除外"), F.lit(None).cast("int")).when((number >= 1) & (number <= 999), number)
    return out.otherwise(F.raise_error(F.concat(F.lit("not a rank: "), word)).cast("int"))


def final_name(method: Column, confidence: Column, roster: Column, card: Column) -> Column:
    """struct(name, source): the card for an exact match, the roster for a sure reading, else the card; unmatched by hand."""
    return (
        F.when(method == "none", F.struct(F.lit(None).cast("string").alias("name"), F.lit("manual").alias("source")))
        .when(method == "exact", F.struct(card.alias("name"), F.lit("card").alias("source")))
        .when(confidence >= 0.90, F.struct(roster.alias("name"), F.lit("roster").alias("source")))
        .otherwise(F.struct(card.alias("name"), F.lit("card").alias("source")))
    )


# --- placement geometry -----------------------------------------------------------------------------------------


def target_eye_distance(top_ratio: Column, bottom_ratio: Column, width: Column, height: Column) -> Column:
    """eyes' distance as a share of the frame's width, from .16 to .32; .22 without guides."""
    return F.coalesce(clipped(F.round((bottom_ratio - top_ratio) * height * 0.55 / width, 3), 0.16, 0.32), F.lit(0.22))


def rounded_away(x: Column, places: int) -> Column:
    """Rounded as SQL engines round doubles: scaled, halves away from zero, scaled back. F.round() goes by the shortest decimal instead."""
    scaled = x * float(10**places)
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / float(10**places)


def filled(image_w: Column, image_h: Column, frame_w: Column, frame_h: Column) -> Column:
    """struct(w, h, x, y) of a picture that fills a frame, centred."""
    shape, frame = image_w / image_h, frame_w / frame_h
    h = F.when(shape > frame, frame_h).otherwise(frame_w / shape)
    w = F.when(shape > frame, frame_h * shape).otherwise(frame_w)
    return F.struct(w.alias("w"), h.alias("h"), ((frame_w - w) / 2).alias("x"), ((frame_h - h) / 2).alias("y"))


def placement(face: dict[str, Column], frame_w: Column, frame_h: Column, chin: Column, eyes: Column, low: float, high: float, center: float = 0.5) -> Column:
    """struct(offset_x, offset_y, scale) that brings chin and face centre to their targets, scaled around the frame's centre.

    `face` has image_w, image_h, center_x, chin_y and eye_dist, the last three as shares of the picture.
    """
    fit = filled(face["image_w"], face["image_h"], frame_w, frame_h)
    span = face["eye_dist"] * fit["w"]
    scale = F.when(span > 0, clipped(eyes * frame_w / F.nullif(span, F.lit(0.0)) * 100, low, high)).otherwise(clipped(F.lit(100.0), low, high))
    chin_at = frame_h / 2 + (fit["y"] + face["chin_y"] * fit["h"] - frame_h / 2) * scale / 100
    face_at = frame_w / 2 + (fit["x"] + face["center_x"] * fit["w"] - frame_w / 2) * scale / 100
    return F.struct(F.round(F.lit(center) * frame_w - face_at, 2).alias("offset_x"), F.round(chin * frame_h - chin_at, 2).alias("offset_y"), F.round(scale, 1).alias("scale"))
