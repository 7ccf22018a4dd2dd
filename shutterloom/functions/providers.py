"""Models behind one protocol: a provider makes a JSON answer of a picture or a text, once loaded per worker.

The engine holds no image or language model. TableProvider answers from stored results, FunctionProvider from a function.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scalars, scores


class Provider(Protocol):
    def load(self) -> Callable[[str], str | None]:
        """Called once per worker; the result answers one prompt, null if it fails."""


class FunctionProvider:
    def __init__(self, answer: Callable[[str], str | None]):
        self.answer = answer

    def load(self) -> Callable[[str], str | None]:
        return self.answer


def asked(rows: DataFrame, prompt: Column, provider: Provider, name: str = "answer", attempts: int = 1, usable: Callable[[str], bool] = lambda _: True) -> DataFrame:
    """H14, H15 and the call of M01 to M10, M12 to M15: `rows` with the provider's answer. Failures give null; each row is tried `attempts` times.

    What an answer or its lack means is in evaluation(), club_evaluation(), eye_judgement(), same_group(), unified_read(), card_read(), staff_records(), card_reading() and teacher_read(). A null prompt is not sent,
    and an answer that is not `usable` is a failure. The call is not deterministic, so filters meant to spare calls must come before it in the plan.
    """

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = provider.load()

        def once(text: str | None) -> str | None:
            if text is None:
                return None
            for _ in range(attempts):
                try:
                    got = answer(text)
                except Exception:
                    got = None
                if got is not None and usable(got):
                    return got
            return None

        for batch in batches:
            yield pd.Series([once(None if pd.isna(text) else text) for text in batch], index=batch.index, dtype=object)

    call = F.pandas_udf(answers, "string", F.PandasUDFType.SCALAR_ITER).asNondeterministic()
    return rows.withColumn(name, call(prompt))


def holds_object(answer: str) -> bool:
    """Whether there is a JSON object in an answer, also with text around it."""
    try:
        return isinstance(json.loads(answer[answer.index("{") : answer.rindex("}") + 1]), dict)
    except ValueError:
        return False


def answered_from(rows: DataFrame, answers: DataFrame, key: str, name: str = "answer") -> DataFrame:
    """The table-backed provider: answers (key, answer) computed elsewhere, joined."""
    return rows.join(answers.select(key, F.col("answer").alias(name)).dropDuplicates([key]), key, "left")


EVALUATION = (
    "is_ng string, ng_reason string, technical double, expression double, composition double, rarity double, event_relevance double, target_grade_relevance double, "
    "shot_type_tags array<string>, class_hint string, day_hint string, person_signature string, landmark_visible string, ball_visible string, cheering_shot string, face_visible string"
)


def evaluation(answer: Column) -> Column:
    """An answer as typed fields with defaults; no answer rejects the photo. F08: closed eyes alone do not, unless they are a main person's."""
    e = scalars.json_object(answer, f"{EVALUATION}, protagonist_eyes_closed string", "technical")
    flag = lambda n: scalars.as_boolean(e[n])
    about_eyes = F.coalesce(e["ng_reason"], F.lit("")).rlike("(?i)eye|目")
    rejected = flag("is_ng") & (~about_eyes | flag("protagonist_eyes_closed"))
    return F.struct(
        F.when(e.isNull(), True).otherwise(F.coalesce(rejected, F.lit(True))).alias("is_ng"), F.when(e.isNull(), "evaluation failed").otherwise(F.coalesce(e["ng_reason"], F.lit(""))).alias("ng_reason"),
        *[F.coalesce(e[n], F.lit(0.0)).alias(n) for n in ("technical", "expression", "composition", "rarity")],
        *[F.coalesce(e[n], F.lit(5.0)).alias(n) for n in ("event_relevance", "target_grade_relevance")],
        F.coalesce(e["shot_type_tags"], F.array().cast("array<string>")).alias("tags"), scalars.class_hint(e["class_hint"]).alias("class_hint"),
        *[flag(n).alias(n) for n in ("landmark_visible", "ball_visible", "cheering_shot", "face_visible")],
    )


#: Pixels of a face's shorter side under which M04, and M05, judge without a call.
LEAST_FACE, LEAST_NOTEBOOK_FACE = 30, 40


def eye_judgement(answer: Column, width: Column, height: Column, least: int = LEAST_FACE) -> Column:
    """struct(has_clear_face, eyes_closed, confidence); a face under `least` pixels, or no answer, is false, false, low."""
    e = scalars.json_fields(answer, "has_clear_face string, eyes_closed string, confidence string")
    judged = F.coalesce((width >= least) & (height >= least), F.lit(False)) & e.isNotNull()
    flag = lambda n: judged & scalars.as_boolean(e[n])
    return F.struct(
        flag("has_clear_face").alias("has_clear_face"), flag("eyes_closed").alias("eyes_closed"),
        F.when(judged, F.coalesce(e["confidence"], F.lit("medium"))).otherwise("low").alias("confidence"),
    )


def judged_eyes(faces: DataFrame, request: Column, provider: Provider, least: int = LEAST_FACE, attempts: int = 1) -> DataFrame:
    """M04, and M05 with LEAST_NOTEBOOK_FACE and two attempts: `faces` (width, height, ...) with `eyes`; those under `least` pixels are not sent."""
    large = (F.col("width") >= least) & (F.col("height") >= least)
    rows = asked(faces, F.when(large, request), provider, "_answer", attempts, holds_object)
    return rows.withColumn("eyes", eye_judgement(F.col("_answer"), F.col("width"), F.col("height"), least)).drop("_answer")


def same_group(answer: Column) -> Column:
    """struct(same_group, confidence, adjusted); a split of low confidence counts as the same group, and so does no answer."""
    e = scalars.json_fields(answer, "same_group string, confidence string")
    said, sure = scalars.as_boolean(e["same_group"], True), F.lower(F.coalesce(e["confidence"], F.lit("low")))
    weak = ~said & (sure == "low")
    return F.struct(
        F.when(e.isNull(), True).otherwise(said | weak).alias("same_group"), F.when(e.isNull(), "low").otherwise(sure).alias("confidence"), F.when(e.isNull(), True).otherwise(weak).alias("adjusted"),
    )


def adjacent_groups(photos: DataFrame, folder: str, position: str, photo: str, request: Callable[[Column, Column], Column], provider: Provider) -> DataFrame:
    """`photos` with `boundary`, the decision on the photo before in its folder (null for the first), and `group`, counted from 0."""
    order = Window.partitionBy(folder).orderBy(position)
    rows = photos.withColumn("_first", F.row_number().over(order) == 1).withColumn("_before", F.lag(photo).over(order))
    rows = asked(rows, F.when(~F.col("_first"), request(F.col("_before"), F.col(photo))), provider, "_answer")
    rows = rows.withColumn("boundary", F.when(~F.col("_first"), same_group(F.col("_answer"))))
    splits = F.sum(F.when(F.col("boundary.same_group"), 0).when(F.col("_first"), 0).otherwise(1))
    return rows.withColumn("group", splits.over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_first", "_before", "_answer")


def card_reading(answer: Column, grade: Column) -> Column:
    """struct(accepted, class_id, student_number, reason) of a card reader's answer."""
    a = scalars.json_object(answer, "has_card string, label string, confidence double", "label")
    label = scalars.card_label(a["label"], grade)
    clear = scalars.as_boolean(a["has_card"], True) & (F.coalesce(a["confidence"], F.lit(1.0)) >= 0.5)
    reason = F.when(a.isNull(), "openai_error").when(~clear, "no clear card visible").when(label.isNull(), "invalid_or_uncertain_label").otherwise("")
    return F.struct((reason == "").alias("accepted"), label["class_id"].alias("class_id"), label["student_number"].alias("student_number"), reason.alias("reason"))


CLUB_SCORES = ("formality_score", "beauty_score", "expression_score", "emotion_score", "people_count_score", "gesture_expression_penalty")


def club_evaluation(answer: Column, people: Column, closed: Column) -> Column:
    """A club photo's evaluation; without an object in the answer the rule of P06 stands in, field by field nothing does.

    struct(formality, beauty, expression, emotion, people_count, gesture_penalty, eyes_closed, is_ng, ng_reason, from_model).
    """
    e = scalars.json_fields(answer, ", ".join(f"{n} double" for n in CLUB_SCORES) + ", eyes_closed string, is_ng string, ng_reason string")
    rule = scores.fallback_evaluation(people, closed)
    fields = dict(zip(CLUB_SCORES, ("formality", "beauty", "expression", "emotion", "people_count"), strict=False))
    known = e.isNotNull()
    return F.struct(
        *[F.when(known, F.coalesce(e[n], F.lit(0.0))).otherwise(rule[f].cast("double")).alias(f) for n, f in fields.items()],
        F.when(known, F.coalesce(e["gesture_expression_penalty"], F.lit(0.0))).otherwise(0.0).alias("gesture_penalty"),
        F.when(known, scalars.as_boolean(e["eyes_closed"])).otherwise(rule["eyes_closed"]).alias("eyes_closed"),
        F.when(known, scalars.as_boolean(e["is_ng"])).otherwise(rule["is_ng"]).alias("is_ng"),
        F.when(known, F.coalesce(e["ng_reason"], F.lit(""))).otherwise(rule["ng_reason"]).alias("ng_reason"), known.alias("from_model"),
    )


CARD = "name string, subject string, confidence double, uncertain_chars string"
PORTRAIT = "suitability_score double, beauty_score double, expression_score double, is_ng string, ng_reason string, short_comment string"
#: Confidence under which a card is read again.
SURE_READ = 0.70


def card_read(answer: Column) -> Column:
    """struct(name, subject, confidence, uncertain_chars, error, raw); an answer without an object is an error and kept as it came."""
    c = scalars.json_fields(answer, CARD)
    lost = c.isNull()
    return F.struct(
        c["name"].alias("name"), c["subject"].alias("subject"), c["confidence"].alias("confidence"), F.when(~lost, F.coalesce(c["uncertain_chars"], F.lit(""))).alias("uncertain_chars"),
        F.when(lost, "no JSON object").alias("error"), F.when(lost, answer).alias("raw"),
    )


def unified_read(answer: Column) -> Column:
    """struct(image_type, card fields, portrait fields, composite_score, error, raw) of an answer that is of a card or of a portrait.

    Without an image type it is a portrait; P09 gives the portrait's composite, and missing scores count 0.
    """
    o = scalars.json_fields(answer, f"image_type string, card struct<{CARD.replace(' ', ': ').replace(',:', ',')}>, portrait struct<{PORTRAIT.replace(' ', ': ').replace(',:', ',')}>")
    lost, kind = o.isNull(), F.coalesce(o["image_type"], F.lit("portrait"))
    card, portrait = ~lost & (kind == "card"), ~lost & (kind != "card")
    score = lambda n: F.coalesce(o["portrait"][n], F.lit(0.0))
    is_ng = scalars.as_boolean(o["portrait"]["is_ng"])
    composite = scores.portrait_composite(score("suitability_score"), score("beauty_score"), score("expression_score"), is_ng)
    return F.struct(
        F.when(~lost, kind).alias("image_type"), F.when(card, F.coalesce(o["card"]["name"], F.lit(""))).alias("name"), F.when(card, F.coalesce(o["card"]["subject"], F.lit(""))).alias("subject"),
        F.when(card, F.coalesce(o["card"]["confidence"], F.lit(0.0))).alias("confidence"), F.when(card, F.coalesce(o["card"]["uncertain_chars"], F.lit(""))).alias("uncertain_chars"),
        *[F.when(portrait, score(n)).alias(n) for n in ("suitability_score", "beauty_score", "expression_score")], F.when(portrait, composite).alias("composite_score"),
        F.when(portrait, is_ng).alias("is_ng"), F.when(portrait, o["portrait"]["ng_reason"]).alias("ng_reason"), F.when(portrait, F.coalesce(o["portrait"]["short_comment"], F.lit(""))).alias("short_comment"),
        F.when(lost, "no JSON object").alias("error"), F.when(lost, answer).alias("raw"),
    )


def read_twice(rows: DataFrame, request: Column, again: Callable[[Column], Column], provider: Provider, name: str = "card") -> DataFrame:
    """M07, M08 with A34: cards read once, and again with `again(first reading)` where the first was not sure; the surer reading stays."""
    first = asked(rows, request, provider, "_first").withColumn("_first", card_read(F.col("_first")))
    doubtful = F.col("_first.error").isNull() & (F.coalesce("_first.confidence", F.lit(0.0)) < SURE_READ)
    both = asked(first, F.when(doubtful, again(F.col("_first"))), provider, "_again")
    second = F.when(F.col("_again").isNotNull(), card_read(F.col("_again")))
    better = second["error"].isNull() & second.isNotNull() & (F.coalesce(second["confidence"], F.lit(0.0)) >= F.coalesce("_first.confidence", F.lit(0.0)))
    return both.withColumn(name, F.when(F.coalesce(better, F.lit(False)), second).otherwise(F.col("_first"))).withColumn("retried", doubtful).drop("_first", "_again")


RECORDS = (
    "teacher_name string, surname string, given_name string, subjects array<string>, role_tags array<string>, classes_or_grades array<string>, confidence double, source_type string, notes string"
)


def staff_records(answers: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """The records of answers, one row each with `keys` and its place; an answer without an object, or without records, has none."""
    nested = ", ".join(f"{n}: {t}" for n, t in (c.split(" ", 1) for c in RECORDS.split(", ")))
    found = answers.select(*keys, scalars.json_fields(F.col(answer), f"records array<struct<{nested}>>")["records"].alias("_records"))
    return found.select(*keys, F.posexplode("_records").alias("place", "_r")).where("_r is not null").select(*keys, "place", "_r.*")


def repaired_rows(rows: DataFrame, by: list[str], position: str, text: str, request: Callable[[Column, Column], Column], provider: Provider, size: int = 18) -> DataFrame:
    """Rows of a page, `size` at a time, put right by a model: staff_records() with `by` and chunk. `request` gets chunk number and text."""
    from ..operators import ranking

    chunks = ranking.chunk_texts(rows, by, position, text, size)
    return staff_records(asked(chunks, request(F.col("chunk") + 1, F.col("text")), provider), [*by, "chunk"])


TEACHER = "name string, family_name string, given_name string, class_label string, role string"


def teacher_read(first: Column, second: Column) -> Column:
    """M15 with A33: struct(name, class_label, role, confidence) of two answers; null if either has no object, or if neither name nor class is read.

    Of family and given names that differ the longer counts, the first of two; a class or role missing in the first comes
    from the second; the name as a whole is the first answer's, if it gives one.
    """
    a, b = scalars.json_fields(first, TEACHER), scalars.json_fields(second, TEACHER)
    text = lambda x, n: F.coalesce(x[n], F.lit(""))
    same = (text(a, "family_name") == text(b, "family_name")) & (text(a, "given_name") == text(b, "given_name"))
    longer = lambda n: F.when(F.length(text(b, n)) > F.length(text(a, n)), text(b, n)).otherwise(text(a, n))
    either = lambda n: F.when(text(a, n) != "", text(a, n)).otherwise(text(b, n))
    name = F.when(text(a, "name") != "", text(a, "name")).otherwise(F.trim(F.concat_ws(" ", longer("family_name"), longer("given_name"))))
    read = F.struct(name.alias("name"), either("class_label").alias("class_label"), either("role").alias("role"), F.when(same, 0.97).otherwise(0.90).alias("confidence"))
    return F.when(a.isNotNull() & b.isNotNull() & ((name != "") | (either("class_label") != "")), read)


def prompt(event: Column, grade: Column, folder: Column) -> Column:
    """The evaluation request for a photo of an event."""
    return F.format_string("Rate this %s photo (folder %s, grade %s). Answer with one JSON object.", event, folder, grade)


# --- picture features over raw pixels: height, width and bytes of RGB -----------------------------------------------

FEATURES = "focus double, focus_mean double, brightness double, contrast double, thirds double, sharpness double"


def pixel_features(rgb: np.ndarray) -> tuple[float, ...]:
    """E01 to E05 and E13 of one picture: edge energy of luma and of the channel mean, mean and spread of luma, edge
    energy around the four third points, Laplacian variance."""
    x = rgb.astype(np.float64)
    luma, mean = x @ np.array([0.299, 0.587, 0.114]), x.mean(2)

    def edges(channel: np.ndarray) -> np.ndarray:
        gy, gx = np.gradient(channel)
        return np.sqrt(gx * gx + gy * gy)

    energy = edges(luma)
    h, w = luma.shape
    ry, rx = max(1, h // 12), max(1, w // 12)
    spots = [energy[max(0, y - ry) : y + ry + 1, max(0, c - rx) : c + rx + 1].mean() for y in (h // 3, 2 * h // 3) for c in (w // 3, 2 * w // 3)]
    inner = luma[1:-1, 1:-1]
    laplace = luma[:-2, 1:-1] + luma[2:, 1:-1] + luma[1:-1, :-2] + luma[1:-1, 2:] - 4 * inner
    return float(energy.var()), float(edges(mean).var()), float(luma.mean()), float(luma.std()), float(np.mean(spots)), float(laplace.var()) if laplace.size else 0.0


def photo_features(pictures: DataFrame) -> DataFrame:
    """`pictures` (id, height, width, rgb) as (id, FEATURES, failure); an unreadable picture has a failure and no features."""
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    picture = np.frombuffer(r.rgb, np.uint8).reshape(int(r.height), int(r.width), 3)
                    rows.append((r.id, *pixel_features(picture), None))
                except (TypeError, ValueError) as e:
                    rows.append((r.id, *[None] * len(names), type(e).__name__))
            yield pd.DataFrame(rows, columns=["id", *names, "failure"])

    kind = pictures.schema["id"].dataType.simpleString()
    return pictures.select("id", "height", "width", "rgb").mapInPandas(run, f"id {kind}, {FEATURES}, failure string")


def skin_gesture(rgb: np.ndarray, box: tuple[int, int, int, int] | None) -> float:
    """How much skin shows outside the face and neck in the upper 70 % of a picture, 0 to 1: by area, and by the largest blob."""
    x = rgb.astype(np.int32)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    mask = (r > 95) & (g > 40) & (b > 20) & (r > g) & (r > b) & (x.max(2) - x.min(2) > 15) & (r - g > 15)
    h, w = mask.shape
    if box is not None:
        left, top, wide, high = box
        mask[max(0, top - int(0.20 * high)) : top + high + int(0.80 * high), max(0, left - int(0.40 * wide)) : left + wide + int(0.40 * wide)] = False
    view = mask[: int(h * 0.70)]
    total = max(view.size, 1)
    area = min(1.0, max(0.0, (view.sum() / total - 0.02) / 0.06))
    biggest = largest_blob(view)
    blob = min(0.70, biggest / total / 0.03 * 0.70) if max(int(total * 0.003), 50) <= biggest <= total * 0.25 else 0.0
    return float(max(area, blob))


def largest_blob(mask: np.ndarray) -> int:
    """Pixels of the largest region whose pixels touch, corners included, by spreading labels until they rest."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        padded = np.pad(labels, 1)
        spread = np.max([padded[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)], axis=0)
        spread = np.where(mask, spread, 0)
        if (spread == labels).all():
            break
        labels = spread
    counts = np.bincount(labels.ravel())[1:]
    return int(counts.max()) if counts.size else 0
