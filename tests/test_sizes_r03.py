"""Findings of the third round about size: what is left out beforehand changes nothing, what is batched stays whole."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shutterloom.operators import ranking, review, selection
from shutterloom.sources import zips


def test_photos_that_cannot_be_chosen_change_nothing(spark, monkeypatch):
    draw = random.Random(2)
    tags = ["landmark, group shot", "athlete oath", "lunch", "plain", "start"]
    folders = ["sports_festival 1", "school trip 2", "marathon 3", "day 4"]
    rows = [
        (f, f"p{k:05d}", False, draw.randrange(30) / 3, draw.randrange(3) * 1.0, 5.0, draw.choice(tags), f"3年{draw.randrange(3)}組", f"day {draw.randrange(3)}", f"p{draw.randrange(4)}", True, draw.random() < 0.3, draw.random() < 0.2, draw.random() < 0.2, draw.random() < 0.1)
        for f in folders for k in range(900)
    ]
    df = spark.createDataFrame(rows, "folder string, path string, is_ng boolean, total double, event_relevance double, grade_relevance double, tags string, class_hint string, day_hint string, person_signature string, face_visible boolean, has_burst boolean, landmark_visible boolean, cheering_shot boolean, ball_visible boolean")
    seen = []
    real = selection.can_be_chosen
    monkeypatch.setattr(selection, "can_be_chosen", lambda rows: (seen.append(real(rows).count()), real(rows))[1])
    got = sorted(map(tuple, selection.select(df).collect()))
    monkeypatch.setattr(selection, "can_be_chosen", lambda rows: rows)
    assert got == sorted(map(tuple, selection.select(df).collect())) and len(got) >= 80
    few = spark.createDataFrame([("day 4", f"p{k}", "a", 1.0) for k in range(900)], "folder string, path string, tag string, total double")
    few = few.select("folder", "path", "total", F.lit("general").alias("event"), F.array("tag").alias("tags"), *[F.lit(1.0).alias(n) for n in ("event_relevance", "grade_relevance")], *[F.lit("x").alias(n) for n in ("class_key", "day_hint", "person")], *[F.lit(False).alias(n) for n in ("face_visible", "has_burst", "landmark_visible", "cheering_shot", "ball_visible")])
    assert real(few).count() == selection.ALL + 1


def test_members_pass_in_batches(spark, monkeypatch):
    monkeypatch.setattr(zips, "ROWS", 7)
    rows = [(a, f"d/{k:03d}", f"{a}{k}".encode() * (k % 3)) for a in "xyz" for k in range(50)]
    packed = zips.archives(spark.createDataFrame(rows, "archive string, member string, content binary"))
    assert packed.groupBy("archive").count().where("count > 1").isEmpty() and packed.count() == 3
    got = sorted((r.archive, r.member, r.size, bytes(r.content)) for r in zips.unpacked(packed).collect())
    assert got == [(a, m, len(x), x) for a, m, x in rows]
    # A batch of Arrow holds several members, not one.
    assert "MapInArrow" in zips.unpacked(packed)._jdf.queryExecution().optimizedPlan().toString()


def test_groups_that_no_resolution_names_are_not_folded(spark):
    groups = spark.createDataFrame([("a", k, k, [], [f"p{k}"]) for k in range(40)] + [("b", 1, 1, [], ["p1", "q"])], review.GROUP)
    log = [
        (1, "resolved", "manual_student_number", "p3", "a::3", ["a::3"], 99), (2, "resolved", "manual_student_number", "p3", "a::3", ["a::3"], 98),
        (3, "resolved", "manual_candidate_selection", None, "a::5", ["a::5", "a::6", "a::7"], 55), (4, "deleted", "manual_delete", "p1", None, None, None), (5, "open", "manual_delete", "p9", None, None, None),
        (6, "resolved", "manual_student_number", "p7", "a::7", ["a::7"], 77),
    ]
    log = spark.createDataFrame(log, "seq long, status string, resolution_type string, image_path string, group_key string, group_keys array<string>, student_no int")
    out = review.apply_resolutions(groups, log)
    got = {(r.class_id, r.group_idx): (r.student_number, r.cards, r.portraits) for r in out.collect()}
    wanted = {("a", k): (k, [], [f"p{k}"]) for k in range(40)} | {("a", 3): (98, ["p3"], []), ("a", 5): (55, [], ["p5"]), ("a", 6): (None, [], ["p6"]), ("a", 7): (77, ["p7"], []), ("a", 1): (1, [], []), ("b", 1): (1, [], ["q"])}
    assert got == wanted and out.count() == 41
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()


def test_last_resolutions_without_windows(spark):
    log = spark.createDataFrame([(3, "e", "x", "p", None, "1", "b"), (1, "e", "x", "q", None, "1", "a"), (2, None, "x", "p", None, "1", "c"), (5, None, "x", "p", None, "1", "d"), (4, None, "x", "p", "g", "1", "e")], "seq long, error_id string, error_type string, image_path string, group_key string, class_id string, status string")
    out = review.latest(log)
    assert out.columns == log.columns and sorted((r.seq, r.image_path, r.status) for r in out.collect()) == [(1, "p", "b"), (2, "p", "d"), (4, "p", "e")]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_bounds_are_found_by_halving(spark):
    bounds = [-5, 0, 2**60, 2**60 + 1]
    values = [-6, -5, -4, 0, 1, 2**60, 2**60 + 1, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert {r.v: r.n for r in df.select("v", ranking._bounds_below(F.col("v"), bounds).alias("n")).collect()} == {v: sum(b < v for b in bounds) for v in values}
    assert "lambda" not in ranking.numbered_in_all(df, ["v"], F.col("v"), "n")._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_page_without_pandas_groups(spark, monkeypatch):
    from shutterloom.operators import clustering

    draw = random.Random(4)
    words = [(1, x := draw.randrange(500) * 1.0, y := draw.randrange(300) * 1.0, x + 20, y + 8, f"w {k}" if k % 3 else "z") for k in range(400)] + [(1, None, 5.0, 9.0, 13.0, "none")]
    df = spark.createDataFrame(words, "page long, x0 double, y0 double, x1 double, y1 double, text string")
    p = pd.DataFrame(words, columns=["page", "x0", "y0", "x1", "y1", "text"])
    p = p.assign(y=(p.y0 + p.y1) / 2, x=(p.x0 + p.x1) / 2).sort_values(["y", "x0"], kind="stable")
    p = p.assign(row=clustering.bands_of(p.y.to_numpy(), 4.0)).sort_values(["row", "x0"], kind="stable")
    width, wanted = float(np.nanmax(p.x1)), []
    for row, line in p.groupby("row"):
        text = " ".join(" ".join(line.text).split())
        if len(text.replace(" ", "")) >= 3:
            wanted.append((1, row + 1, text, *[" ".join(line.text[(line.x >= a * width) & (line.x < b * width)]) for a, b in clustering.STAFF_COLUMNS.values()]))
    monkeypatch.setattr(pd.DataFrame, "groupby", None)
    assert sorted(map(tuple, clustering.page_rows(df.coalesce(1)).collect())) == sorted(wanted)
