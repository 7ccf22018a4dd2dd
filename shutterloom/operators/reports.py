"""Reports: the sheets of workbooks as tables, in their order, with display headers and values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, tables

# Sheets of an event report and what they say of their photos.
BEST, REJECTED, UNSELECTED, TOTALS = "ベストショット一覧", "NG写真一覧", "未選定写真一覧", "統計サマリー"
BEST_COMMENT = "総合評価が高く、ベストショット候補として選定されました。"
BEST_REASON = "類似写真グループ内の代表候補として選定され、総合評価が高いため最終選定されました。"
REJECTED_REASON = "代表候補の中で総合評価が低いため"
REJECTED_COMMENT = "代表候補の中で総合評価が低いため、NG候補として分類されました。"
UNSELECTED_COMMENT = "品質基準は満たしていますが、ベストショット選定数の上限により未選定となりました。"
UNSELECTED_REASON = "ベストショット選定数の上限により未選定"
REVIEW_SHEET = "NG写真・要確認"


def headed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns under their display names, with display values."""
    kinds = dict(df.dtypes)
    shown = lambda c: scalars.shown(F.col(c)) if kinds[c] == "string" else scalars.shown_boolean(F.col(c)) if kinds[c] == "boolean" else F.col(c)
    names = [scalars.header(c) for c in columns]
    return df.select(*[shown(c).alias(n if names.index(n) == k else f"{n} ({k + 1})") for k, (c, n) in enumerate(zip(columns, names, strict=True))])


def totals(df: DataFrame, rows: Sequence[tuple[str, Column | None]]) -> DataFrame:
    """(項目, 値): one row per label, its aggregate over `df` as text, empty where there is none; in order."""
    values = [F.coalesce(v.cast("string"), F.lit("")) if v is not None else F.lit("") for _, v in rows]
    pairs = F.array(*[F.struct(F.lit(label).alias("項目"), value.alias("値")) for (label, _), value in zip(rows, values, strict=True)])
    return df.agg(pairs.alias("_rows")).select(F.explode("_rows").alias("_r")).select("_r.*")


def event_report(photos: DataFrame, inputs: int, clusters: int, asked: int | None = None) -> dict[str, DataFrame]:
    """The four sheets of an event: best, rejected and unselected photos by score, and totals.

    photos: the representatives of clusters with file, bucket, total, technical, expression, composition, rarity,
    cluster and taken (time as text).
    """
    order = [F.desc("total"), "file"]

    def of(bucket: str) -> DataFrame:
        return photos.where(F.col("bucket") == bucket).orderBy(*order)

    place = {"ファイル名": F.col("file"), "総合スコア": F.col("total"), "類似グループID": F.col("cluster"), "撮影日時": F.col("taken")}

    def sheet(bucket: str, label: str, columns: dict[str, Column]) -> DataFrame:
        every = place | {"区分": F.lit(label)} | columns
        return of(bucket).select(*[every[n].alias(n) for n in SHEET_COLUMNS[bucket]])

    scores = {"技術スコア": F.col("technical"), "表情/明るさスコア": F.col("expression"), "構図スコア": F.col("composition"), "希少性スコア": F.col("rarity")}
    count = lambda bucket: F.count_if(F.col("bucket") == bucket)
    kept = F.count("*")
    stats = [
        ("■ 全体集計", None), ("入力写真数", F.lit(inputs)), ("類似グループ数", F.lit(clusters)), ("代表候補数", kept),
        ("重複削減率", F.round(1 - kept / F.lit(max(inputs, 1)), 4)), ("ベストショット選定数", count("final_selected")), ("NG写真数", count("ng")),
        ("未選定写真数", count("other_passing")), ("ベストショット指定数", F.lit(asked) if asked is not None else F.lit(None)),
    ]
    return {
        BEST: sheet("final_selected", tables.BUCKETS["final_selected"], scores | {"コメント": F.lit(BEST_COMMENT), "選定理由": F.lit(BEST_REASON)}),
        REJECTED: sheet("ng", tables.BUCKETS["ng"], {"NG理由": F.lit(REJECTED_REASON), "コメント": F.lit(REJECTED_COMMENT)}),
        UNSELECTED: sheet("other_passing", "未選定写真", {"コメント": F.lit(UNSELECTED_COMMENT), "未選定理由": F.lit(UNSELECTED_REASON)}),
        TOTALS: totals(photos, stats),
    }


# The columns of the first three sheets.
SHEET_COLUMNS = {
    "final_selected": ["ファイル名", "区分", "総合スコア", "技術スコア", "表情/明るさスコア", "構図スコア", "希少性スコア", "類似グループID", "撮影日時", "コメント", "選定理由"],
    "ng": ["ファイル名", "区分", "総合スコア", "NG理由", "コメント", "類似グループID", "撮影日時"],
    "other_passing": ["ファイル名", "区分", "総合スコア", "コメント", "未選定理由", "類似グループID", "撮影日時"],
}


def event_counts(photos: DataFrame) -> DataFrame:
    """A21 in K24: per kind of event how many photos are selected, rejected and left over; photos has event and bucket."""
    count = lambda bucket, name: F.count_if(F.col("bucket") == bucket).alias(name)
    rows = photos.where("event is not null").groupBy(F.col("event").alias("■ イベント種別別 枚数"))
    return rows.agg(count("final_selected", "選定"), count("ng", "NG"), count("other_passing", "未選定")).orderBy("■ イベント種別別 枚数")


def club_report(photos: DataFrame, faces: DataFrame) -> dict[str, DataFrame]:
    """The six sheets of a club run, of ranked photos and their faces.

    photos: club, original_file, renamed_file, shooting_date, rank, person_count, closed_eye_faces, eyes_closed_photo,
    formality, quality, expression, gesture_penalty, ng_flag, total_score, ng_reason; faces: club, file, face_index,
    left_eye_ratio, right_eye_ratio, eye_closed. After rank edits the same sheets come from the edited photos.
    """
    per_club = photos.groupBy("club").agg(
        F.count("*").alias("photo_count"), F.count_if("eyes_closed_photo").alias("closed_eye_photo_count"), F.sum("closed_eye_faces").alias("closed_eye_face_count"), F.count_if(~F.col("ng_flag")).alias("ranked_output_count"),
    )
    summary = totals(photos, [
        (scalars.header("club_count"), F.countDistinct("club")), (scalars.header("photo_count"), F.count("*")), (scalars.header("closed_eye_photo_count"), F.count_if("eyes_closed_photo")),
        (scalars.header("closed_eye_face_count"), F.sum("closed_eye_faces")), (scalars.header("ranked_output_count"), F.count_if(~F.col("ng_flag"))),
    ])
    ranked = ["club", "original_file", "rank", "person_count", "closed_eye_faces", "formality", "quality", "expression", "gesture_penalty", "ng_flag", "total_score"]
    names = tables.CLUB_SHEETS
    return {
        names["Summary"]: summary,
        names["Eye Closure Summary"]: headed(per_club.orderBy("club"), ["club", "photo_count", "closed_eye_photo_count", "closed_eye_face_count", "ranked_output_count"]),
        names["Face Detail"]: headed(faces.orderBy("club", "file", "face_index"), ["club", "file", "face_index", "left_eye_ratio", "right_eye_ratio", "eye_closed"]),
        names["Best Shot Ranking"]: headed(photos.orderBy("club", "rank"), ranked),
        names["Rename Output"]: headed(photos.orderBy("club", "rank"), ["club", "original_file", "renamed_file", "shooting_date", "rank"]),
        REVIEW_SHEET: headed(photos.where("ng_flag").orderBy("club", "rank"), ["club", "original_file", "ng_flag", "ng_reason"]),
    }


# The columns of staff workbooks, as headers and the fields they show.
MATCH_COLUMNS = {
    "Original Filename": "filename", "Renamed Filename": "renamed_filename", "Image Path": "image_path", "Card Name (OCR)": "card_name", "Card Subject (OCR)": "card_subject",
    "Card OCR Confidence": "card_ocr_confidence", "Card Uncertain Chars": "card_uncertain_chars", "Status": "status", "Match Method": "match_method", "Match Score": "match_score",
    "PDF Matched Name": "pdf_name", "PDF Role / Admin Tags": "pdf_role", "PDF Academic Subjects": "pdf_subjects", "PDF All Subjects (incl. roles)": "pdf_subjects_list",
    "PDF Classes / Grades": "pdf_classes_grades", "PDF Presence": "pdf_presence", "PDF Source Types": "pdf_source_types", "PDF Source Files": "pdf_source_files", "PDF Pages": "pdf_pages",
    "PDF Extraction Confidence": "pdf_confidence", "PDF Notes": "pdf_notes", "PDF Name Aliases": "pdf_aliases", "Destination": "destination",
}
MASTER_COLUMNS = {
    "Teacher Name": "name", "Academic Subjects": "subject", "Role / Admin Tags": "role", "Classes / Grades": "classes", "Presence": "presence", "Source Types": "source_types",
    "PDF Pages": "pages", "PDF Extraction Conf": "confidence", "Notes": "notes", "Name Aliases": "aliases",
}
FINAL_COLUMNS = {"Original Filename": "filename", "Final Teacher Name": "final_name", "Name Source": "name_source", "Card OCR Name": "card_name", "Match Method": "match_method", "Match Score": "match_score"}
SHOT_COLUMNS = {
    "Teacher (roster name)": "pdf_name", "Card Subject": "card_subject", "Original Filename": "filename", "Renamed Filename": "renamed_filename", "Rank": "rank", "Destination": "destination",
    "Suitability (0-10)": "suitability", "Beauty (0-10)": "beauty", "Expression (0-10)": "expression", "Composite Score": "composite", "Is NG": "is_ng", "NG Reason": "ng_reason",
    "Short Comment": "comment", "Selected Best Shot": "best",
}


def listed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns that `df` has of those of a sheet, under display headers; a header that occurs twice is numbered."""
    kinds = dict(df.dtypes)
    out, seen = [], set()
    for header, field in columns.items():
        if field not in kinds:
            continue
        value = scalars.shown(F.col(field)) if kinds[field] == "string" else scalars.shown_boolean(F.col(field)) if kinds[field] == "boolean" else F.col(field)
        name = scalars.header(header)
        name = f"{name} ({len(out) + 1})" if name in seen else name
        seen.add(name)
        out.append(value.alias(name))
    return df.select(*out)


def staff_report(matches: DataFrame, master: DataFrame, shots: DataFrame, by_subject: DataFrame) -> dict[str, DataFrame]:
    """The five sheets of a staff run: matched cards, the staff list, final names, scored portraits, people by subject.

    matches and shots have fields of MATCH_COLUMNS, FINAL_COLUMNS and SHOT_COLUMNS, master those of MASTER_COLUMNS,
    by_subject is staff.staff_by_subject().
    """
    names = tables.STAFF_SHEETS
    return {
        names["Match Results"]: listed(matches.orderBy("filename"), MATCH_COLUMNS),
        names["PDF Staff Master"]: listed(master.orderBy("staff_pos"), MASTER_COLUMNS),
        names["Final Name List"]: listed(matches.orderBy("filename"), FINAL_COLUMNS),
        names["Best Shot Scores"]: listed(shots.orderBy("pdf_name", "rank"), SHOT_COLUMNS),
        names["Staff by Subject"]: by_subject.select(F.col("subject").alias("教科"), F.col("people").alias("人数"), F.array_join("names", ", ").alias("氏名")),
    }


def eye_report(faces: DataFrame, least: float = 0.24) -> dict[str, DataFrame]:
    """Totals and one row per face, with the eyes that are closed."""
    closed = (F.col("left_eye_ratio") <= least) | (F.col("right_eye_ratio") <= least)
    rows = faces.withColumn("eye_closed", F.coalesce(closed, F.lit(False)))
    per_photo = rows.groupBy("club", "file").agg(F.max("eye_closed").alias("closed"), F.count_if("eye_closed").alias("n"))
    summary = per_photo.groupBy("club").agg(F.count("*").alias("photos"), F.count_if("closed").alias("closed_photos"), F.sum("n").alias("closed_faces")).orderBy("club")
    return {"Summary": summary, "Face Detail": rows.select("club", "file", "face_index", "left_eye_ratio", "right_eye_ratio", "eye_closed").orderBy("club", "file", "face_index")}


#: The sheets of the integrated run, in order.
INTEGRATED_SHEETS = (
    "Pipeline_Summary", "Similarity_Summary", "Similarity_Clusters", "Similarity_Image_Level", "Scored_All_Candidates", "NG_Log", "Selected", "Others", "Rename_Map",
)


def integrated_report(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The nine sheets in order, nested columns as JSON text; a sheet that is not there is left out."""

    def flat(df: DataFrame) -> DataFrame:
        nested = lambda kind: kind.startswith(("array", "struct", "map"))
        return df.select(*[F.to_json(F.col(f"`{n}`")).alias(n) if nested(kind) else F.col(f"`{n}`") for n, kind in df.dtypes])

    return {n: flat(frames[n]) for n in INTEGRATED_SHEETS if n in frames}
