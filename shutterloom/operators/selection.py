"""Choosing an event's photos under quotas. One fold per folder over evaluated photos."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.tables import EVENT_RULES

LEAST, MOST = 20, 25
#: Strict limits per person, class, scene, composition and for bursts.
LIMITS = {"person": 2, "class": 3, "scene": 2, "composition": 3, "burst": 1}


@dataclass
class Album:
    """The photos chosen so far, with the counts that the limits are about."""

    rows: list[dict]
    transit_most: int | None
    chosen: dict[int, str] = field(default_factory=dict)
    counts: Counter = field(default_factory=Counter)

    def keys(self, row: dict) -> list[tuple[str, object]]:
        out = [("person", row["person"]), ("scene", row["scene"]), ("composition", row["composition"])]
        out += [("class", c) for c in row["classes"]]
        return [*out, ("burst", True)] if row["has_burst"] else out

    def fits(self, row: dict, strict: bool) -> bool:
        if strict and any(self.counts[k] >= LIMITS[k[0]] for k in self.keys(row)):
            return False
        return self.transit_most is None or not row["transit"] or self.counts["transit"] < self.transit_most

    def pick(self, i: int, reason: str, strict: bool = True) -> bool:
        row = self.rows[i]
        if i in self.chosen or not self.fits(row, strict):
            return False
        self.chosen[i] = reason
        self.counts.update(self.keys(row))
        self.counts["transit"] += row["transit"]
        for flag in ("landmark_visible", "cheering_shot", "ball_visible"):
            self.counts[flag] += row[flag]
        return True

    def until(self, enough: Callable[[], bool], places: Iterable[int], reason: str, strict: bool = True) -> None:
        for i in places:
            if enough():
                return
            self.pick(i, reason, strict)


#: Photos of a folder that are chosen in all, at most: MOST, and before those what an event's rule asks for.
ALL = MOST + max(len(r.tag_groups) + r.landmarks + r.cheering[0] + 1 for r in EVENT_RULES.values())


def choose(rows: list[dict], event: str) -> list[tuple[int, str]]:
    """(place in `rows`, reason) of the chosen rows. `rows` are acceptable photos in order of preference; with `in_bucket`,
    the photos of a row's bucket, they may be those of can_be_chosen()."""
    rule = EVENT_RULES[event]
    album = Album(rows, rule.transit_most)
    everywhere = range(len(rows))

    def full(n: int) -> Callable[[], bool]:
        return lambda: len(album.chosen) >= n

    for terms in rule.tag_groups:
        wanted = (i for i in everywhere if any(t in q or q in t for t in rows[i]["tags"] for q in terms))
        any(album.pick(i, "required: " + "/".join(terms)) for i in wanted)
    for flag, least in (("landmark_visible", rule.landmarks), ("cheering_shot", rule.cheering[0]), ("ball_visible", int(rule.ball))):
        if least:
            album.until(lambda flag=flag, least=least: album.counts[flag] >= least, (i for i in everywhere if rows[i][flag]), flag)
    if rule.by_class or rule.by_day:
        key = "class_key" if rule.by_class else "day_hint"
        waiting: dict[str, list[int]] = {}
        for i in everywhere:
            waiting.setdefault(rows[i][key], []).append(i)
        for places in waiting.values():
            places.sort(key=lambda i: -rows[i]["total"])
        held = {k: rows[places[0]].get("in_bucket", len(places)) for k, places in waiting.items()}
        went_on = True
        while went_on and len(album.chosen) < MOST:
            went_on = False
            # Small buckets first, by what they held when the round began.
            for k in sorted(waiting, key=held.copy().__getitem__):
                if waiting[k] and len(album.chosen) < MOST:
                    held[k] -= 1
                    went_on |= album.pick(waiting[k].pop(0), f"balanced: {key}")
    album.until(full(MOST), everywhere, "top")
    if len(album.chosen) < LEAST:
        album.until(full(LEAST), everywhere, "fallback_relaxed", strict=False)
    album.until(full(MOST), everywhere, "fill_to_max_relaxed", strict=False)
    return list(album.chosen.items())


def can_be_chosen(rows: DataFrame) -> DataFrame:
    """The rows of select() that choose() can come to, with `in_bucket`, the rows of their bucket.

    Of photos that no limit tells apart each phase takes the first that is left, and limits only get tighter, so the first
    ALL + 1 of them are enough. Rounds over buckets take one photo of each at a time; every round but the last chooses one,
    so the first MOST + 1 of a bucket by total are enough.
    """
    number = lambda n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n)).desc_nulls_last()
    preferred = [number("event_relevance"), number("grade_relevance"), number("total"), F.asc_nulls_last("path")]
    rule = lambda test: F.col("event").isin(*[e for e, r in EVENT_RULES.items() if test(r)])
    bucket = F.when(rule(lambda r: r.by_class), F.col("class_key")).when(rule(lambda r: r.by_day), F.col("day_hint"))
    rows = rows.withColumn("_bucket", bucket)
    alike = ["folder", "tags", "class_key", "person", "face_visible", "has_burst", "landmark_visible", "cheering_shot", "ball_visible"]
    rows = rows.withColumn("_alike", F.row_number().over(Window.partitionBy(*alike).orderBy(*preferred)))
    by_total = Window.partitionBy("folder", "_bucket").orderBy(number("total"), *preferred)
    rows = rows.withColumn("_place", F.when(F.col("_bucket").isNotNull(), F.row_number().over(by_total)))
    sizes = rows.groupBy("folder", "_bucket").agg(F.count("*").alias("in_bucket"))
    kept = rows.where((F.col("_alike") <= ALL + 1) | (F.col("_place") <= MOST + 1))
    same = kept["folder"].eqNullSafe(sizes["folder"]) & kept["_bucket"].eqNullSafe(sizes["_bucket"])
    return kept.join(sizes, same).select(*[kept[n] for n in rows.columns if not n.startswith("_")], "in_bucket")


def select(evaluated: DataFrame, default_event: str = "general") -> DataFrame:
    """(folder, path, total, event, reason, place): at most MOST photos per folder, by total score.

    evaluated: folder, path, is_ng, total, event_relevance, grade_relevance, tags (text), class_hint, day_hint,
    person_signature, face_visible, has_burst, landmark_visible, cheering_shot, ball_visible. Ties go by path.
    """
    tags = scalars.tags_of(F.col("tags"))
    rows = evaluated.where(~F.coalesce("is_ng", F.lit(False))).select(
        "folder", "path", "total", F.coalesce("event_relevance", F.lit(5.0)).alias("event_relevance"), F.coalesce("grade_relevance", F.lit(5.0)).alias("grade_relevance"),
        tags.alias("tags"), scalars.class_hint(F.col("class_hint")).alias("class_key"), F.coalesce("day_hint", F.lit("不明")).alias("day_hint"),
        F.lower(F.trim(F.coalesce("person_signature", F.lit("unknown")))).alias("person"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("face_visible", "has_burst", "landmark_visible", "cheering_shot", "ball_visible")],
        scalars.event_of_folder(F.col("folder"), default_event).alias("event"), scalars.has_tag(tags, scalars.tables.TRANSIT_TERMS).alias("transit"),
    )

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["event_relevance", "grade_relevance", "total", "path"], ascending=[False, False, False, True], kind="stable")
        rows = p.to_dict("records")
        for r in rows:
            r["tags"] = list(r["tags"])
            r["composition"] = tuple(sorted(r["tags"]))
            r["classes"] = [] if r["class_key"] == "unknown" else r["class_key"].split("_")[1:]
            r["scene"] = (r["composition"], r["class_key"])
            if r["person"] in ("unknown", "不明"):
                r["person"] = ("nobody", r["class_key"], r["face_visible"])
        got = [(rows[i], reason) for i, reason in choose(rows, rows[0]["event"])]
        got.sort(key=lambda g: (-g[0]["total"], g[0]["path"]))
        return pd.DataFrame([(r["folder"], r["path"], r["total"], r["event"], why, k) for k, (r, why) in enumerate(got, 1)], columns=["folder", "path", "total", "event", "reason", "place"])

    return can_be_chosen(rows).groupBy("folder").applyInPandas(fold, "folder string, path string, total double, event string, reason string, place int")
