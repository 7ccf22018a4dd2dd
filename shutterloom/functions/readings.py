"""What text readers and face detectors return, as columns. Readers and detectors are injected; their answers are decided here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTS = "text string, confidence double"
FACES = "face_index int, x1 int, y1 int, x2 int, y2 int, det_score double, emb array<float>, pose array<double>, landmarks array<struct<x: double, y: double>>"


def read_texts(pictures: DataFrame, load: Callable[[], Callable[[object], list[tuple[str, float]]]], key: str = "id") -> DataFrame:
    """One row per text that the reader finds: (key, pos, TEXTS). `load` is called once per worker; a failing picture has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = load()
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    found = read(r)
                except Exception:
                    found = []
                rows += [(getattr(r, key), k, t, float(p)) for k, (t, p) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "pos", "text", "confidence"])

    return pictures.mapInPandas(run, f"{key} {pictures.schema[key].dataType.simpleString()}, pos int, {TEXTS}")


def detect_faces(pictures: DataFrame, load: Callable[[], Callable[[object], list[dict]]], key: str = "id") -> DataFrame:
    """One row per face that the detector finds, with what it knows of it: (key, FACES)."""
    names = [c.split(":")[0].split()[0] for c in ("face_index int", "x1 int", "y1 int", "x2 int", "y2 int", "det_score double", "emb", "pose", "landmarks")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = load()
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    found = detect(r)
                except Exception:
                    found = []
                rows += [(getattr(r, key), k, *[face.get(n) for n in names[1:]]) for k, face in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return pictures.mapInPandas(run, f"{key} {pictures.schema[key].dataType.simpleString()}, {FACES}")


def largest_face(faces: DataFrame, key: str = "id") -> DataFrame:
    """The face with the largest box, the first of two."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return faces.groupBy(key).agg(F.max_by(F.struct(*[c for c in faces.columns if c != key]), F.struct(area, -F.col("face_index"))).alias("face")).select(key, "face.*")


def separators(texts: DataFrame, key: str = "id") -> DataFrame:
    """(key, grade, class_number, label, student_number) where a text reads like 3-1 with a grade to 6 and a class to 20.

    The first such text counts; the student number is the least number to 50 in the other texts.
    """
    grade, number = F.regexp_extract("text", r"(\d)\s*[-–－]\s*(\d{1,2})", 1).try_cast("int"), F.regexp_extract("text", r"(\d)\s*[-–－]\s*(\d{1,2})", 2).try_cast("int")
    rows = texts.withColumn("g", grade).withColumn("c", number)
    rows = rows.withColumn("valid", F.coalesce(F.col("g").between(1, 6) & F.col("c").between(1, 20), F.lit(False)))
    numbers = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"(?<!\d)(\d{1,2})(?!\d)"), 1), lambda n: n.cast("int")), lambda n: n.between(1, 50))
    rows = rows.withColumn("least", F.when(~F.col("valid"), F.array_min(numbers)))
    out = rows.groupBy(key).agg(F.min_by(F.struct("g", "c"), F.when(F.col("valid"), F.col("pos"))).alias("s"), F.min("least").alias("student_number")).where("s is not null")
    return out.select(key, F.col("s.g").alias("grade"), F.col("s.c").alias("class_number"), F.concat_ws("-", "s.g", "s.c").alias("label"), "student_number")


def teacher_card(texts: DataFrame, key: str = "id") -> DataFrame:
    """(key, class_label, role, name) of cards with a homeroom word: the class, the office, and the longest text left that is a name."""
    line = F.regexp_replace("text", r"\s+", "")
    rows = texts.where("confidence >= 0.10").withColumn("line", line)
    gate = F.max(F.col("line").rlike("担任|副担|先生|教諭|講師"))
    role = F.max(F.when(F.col("line").contains("副担"), "副担任").when(F.col("line").contains("担任"), "担任"))
    label = F.min(F.nullif(F.regexp_extract("line", r"(\d-\d{1,2})", 1), F.lit("")))
    name = F.regexp_replace("line", "担任|副担任|副担|先生|教諭|講師|クラス|組|年|[0-9０-９:：\\-]", "")
    usable = name.rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]{2,8}$")
    return rows.groupBy(key).agg(gate.alias("gate"), label.alias("class_label"), role.alias("role"), F.max_by(F.when(usable, name), F.when(usable, F.struct(F.length(name), -F.col("pos")))).alias("name")).where("gate").drop("gate")


def agreed(a: Column, b: Column) -> Column:
    """struct(value, confidence) of two reads: the same value is surer; else the longer one, the first of two."""
    same = F.coalesce(a == b, F.lit(False))
    longer = F.when(F.coalesce(F.length(b), F.lit(0)) > F.coalesce(F.length(a), F.lit(0)), b).otherwise(a)
    return F.struct(F.when(same, a).otherwise(longer).alias("value"), F.when(same, 0.97).otherwise(0.90).alias("confidence"))


def better_read(first: Column, second: Column, least: float = 0.75) -> Column:
    """The first reading if it is sure enough, else the surer one, the second of two; each struct has confidence."""
    retry = F.coalesce(second["confidence"] >= first["confidence"], F.lit(False))
    return F.when(first["confidence"] >= least, first).when(retry, second).otherwise(first)
