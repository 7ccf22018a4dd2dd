"""A folder of portraits in order becomes numbered people in classes, by composition of simpler operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import clustering

IMAGE = "folder, idx, path, card_number, separator_label, separator_number, emb"
RESULT = "folder string, group_id int, number int, class_label string, paths array<string>, cards array<string>"


def grouped_people(images: DataFrame, least: float = clustering.SAME_PERSON, reach: int = 5) -> DataFrame:
    """RESULT of images (IMAGE): faces grouped by running centroid, numbers from cards, classes from separators.

    A group's number is the first card number on its pictures. A card without a face goes to the nearest group, at most
    `reach` positions off, in order; a separator's number to the first unnumbered group after it. The group's class is
    the separator that covers its upper median position; what lies before the first separator is pre-separator.
    """

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx", kind="stable").reset_index(drop=True)
        faces = [i for i in range(len(p)) if p.emb[i] is not None and pd.isna(p.separator_label[i])]
        owner = dict(zip(faces, clustering.running_centroids(clustering._matrix(p.emb[faces])), strict=True)) if faces else {}
        groups: dict[int, dict] = {}
        known = lambda v: None if pd.isna(v) else int(v)
        for i, g in owner.items():
            group = groups.setdefault(g, {"at": [], "paths": [], "cards": [], "number": None})
            group["at"].append(int(p.idx[i]))
            group["paths"].append(p.path[i])
            if group["number"] is None and known(p.card_number[i]) is not None:
                group["number"] = known(p.card_number[i])
        for i in range(len(p)):
            if i not in owner and known(p.card_number[i]) is not None and groups:
                near = min((abs(at - int(p.idx[i])), k) for k, g in groups.items() for at in g["at"])
                if near[0] <= reach and groups[near[1]]["number"] is None:
                    groups[near[1]]["number"] = known(p.card_number[i])
                    groups[near[1]]["cards"].append(p.path[i])
        marks = [(int(p.idx[i]), p.separator_label[i], known(p.separator_number[i])) for i in range(len(p)) if not pd.isna(p.separator_label[i])]
        for at, _, number in marks:
            if number is not None and all(g["number"] != number for g in groups.values()):
                after = [(min(g["at"]), k) for k, g in groups.items() if g["number"] is None and min(g["at"]) > at]
                if after:
                    groups[min(after)[1]]["number"] = number
        rows = []
        for k, g in sorted(groups.items()):
            middle = sorted(g["at"])[len(g["at"]) // 2]
            before = [label for at, label, _ in marks if at <= middle]
            label = before[-1] if before else "pre-separator" if marks and max(g["at"]) < marks[0][0] else "unknown"
            rows.append((p.folder[0], k, g["number"], label, g["paths"], g["cards"]))
        return pd.DataFrame(rows, columns=["folder", "group_id", "number", "class_label", "paths", "cards"]).astype({"number": "Int32"})

    columns = [c.strip() for c in IMAGE.split(",")]
    return images.select(*columns).groupBy("folder").applyInPandas(fold, RESULT)


def flat_students(groups: DataFrame) -> DataFrame:
    """One row per picture, without classes."""
    return groups.select("group_id", "number", F.explode(F.array_distinct(F.concat("paths", "cards"))).alias("path"))


def best_shots(groups: DataFrame, scored: DataFrame) -> DataFrame:
    """The best picture of each group, good ones first; a group of rejected ones says so."""
    rows = groups.select("folder", "group_id", F.posexplode("paths").alias("pos", "path")).join(scored.select("path", "score", "is_ng"), "path")
    order = Window.partitionBy("folder", "group_id").orderBy("is_ng", F.desc("score"), "pos")
    best = rows.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return best.select("folder", "group_id", "path", "score", F.when(F.col("is_ng"), "[all-NG fallback]").otherwise("").alias("note"))
