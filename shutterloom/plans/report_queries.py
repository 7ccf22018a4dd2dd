"""Sinks written and read back, sources, model answers and small helpers as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels, providers
from ..functions import scalars as X
from ..functions import scores as S
from ..functions import tables as fixed
from ..operators import ranking, relational, reports, review, staff
from ..operators import tables as T
from ..sources import files, rosters, sinks, workbooks, zip_source, zips
from ..sources.folders import shared_folder, written
from .fold_queries import CARD_ROWS, ENTRIES, GROUPS, LISTED, PICTURES, PUPILS, STAFF, _errors, _records
from .ranking_queries import BUCKETS, CLUB, CLUB_NG, CLUB_SCORE, PARTS, SNAP_SCORES, _club, _scored
from .registry import query, query_of
from .relational_queries import ALL_FRAMES
from .relational_queries import GUIDES as LINES

c = F.col


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


# --- workbooks and tables, written and read back ---

DEALT = BUCKETS.replace("{best}", "greatest(1, CAST(round_even(n * 0.30, 0) AS INT))")


def _photos(df):
    rows = ranking.buckets(_scored(df), ["grp"], "score", "pos")
    return rows.select(
        F.concat(F.lit("IMG_"), c("pos"), F.lit(".jpg")).alias("file"), "bucket", S.rounded_away(S.rounded_away(c("score"), 6), 4).alias("total"), F.round("focus", 4).alias("technical"), F.round("bright", 4).alias("expression"),
        F.round("comp", 4).alias("composition"), F.round("rare", 4).alias("rarity"), c("grp").alias("cluster"), F.lit("2024-05-01 09:00:00").alias("taken"), "grp",
    )


SHEETS_SQL = f"CASE bucket WHEN 'final_selected' THEN '{reports.BEST}' WHEN 'ng' THEN '{reports.REJECTED}' ELSE '{reports.UNSELECTED}' END"
LABELS_SQL = "CASE bucket WHEN 'final_selected' THEN 'ベストショット' WHEN 'ng' THEN 'NG写真' ELSE '未選定写真' END"


@query("k24_event_workbook", PARTS, f"SELECT {SHEETS_SQL} AS sheet, CAST(row_number() OVER (PARTITION BY bucket ORDER BY round(score, 4) DESC, 'IMG_' || CAST(pos AS STRING) || '.jpg') + 1 AS INT) AS row, 'IMG_' || CAST(pos AS STRING) || '.jpg' AS file, {LABELS_SQL} AS label FROM ({DEALT}) AS b")
def k24(df):
    """The event report as a workbook, read back; its totals are in k24_event_totals."""
    path = f"{shared_folder(spark_of(df))}.xlsx"
    parts = workbooks.write_sheets(reports.event_report(_photos(df), 1000, 50, None), path)
    cells = workbooks.read_back(spark_of(df), path, {n: p for n, p in parts.items() if n != reports.TOTALS}).where((c("row") > 1) & (c("col") <= 2))
    return cells.groupBy("sheet", "row").pivot("col", [1, 2]).agg(F.first("value")).select("sheet", "row", c("1").alias("file"), c("2").alias("label"))


@query("k24_event_totals", PARTS, f"SELECT * FROM (SELECT '入力写真数' AS label, '1000' AS value UNION ALL SELECT '類似グループ数', '50' UNION ALL SELECT '代表候補数', CAST(count(*) AS STRING) FROM ({DEALT}) AS a UNION ALL SELECT 'ベストショット選定数', CAST(count(*) AS STRING) FROM ({DEALT}) AS b WHERE bucket = 'final_selected' UNION ALL SELECT 'NG写真数', CAST(count(*) AS STRING) FROM ({DEALT}) AS d WHERE bucket = 'ng' UNION ALL SELECT '未選定写真数', CAST(count(*) AS STRING) FROM ({DEALT}) AS e WHERE bucket = 'other_passing') AS t")
def k24_totals(df):
    path = f"{shared_folder(spark_of(df))}.xlsx"
    sheets = reports.event_report(_photos(df), 1000, 50, None)
    workbooks.write_workbook({reports.TOTALS: sheets[reports.TOTALS]}, path)
    rows = workbooks.as_table(workbooks.read_cells(spark_of(df), path), reports.TOTALS, ["label", "value"])
    return rows.where("value is not null and label <> '重複削減率'").select("label", "value")


@query("k01_versioned_report", PARTS, f"SELECT bucket, count(*) AS n, round(sum(score), 3) AS score FROM ({DEALT}) AS b GROUP BY bucket")
def k01(df):
    """Tables under a version of their own, partitioned by bucket; the second version is read."""
    root = shared_folder(spark_of(df))
    rows = ranking.buckets(_scored(df), ["grp"], "score", "pos").select("pos", "bucket", F.round("score", 6).alias("score"))
    for part in (rows.where("bucket = 'ng'"), rows):
        sinks.write_version({"photos": part}, root, {"photos": ["bucket"]})
    return sinks.read_latest(spark_of(df), root, "photos").groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("score"))


@query("k02_localised_csv", GROUPS, "SELECT class_id, coalesce(CAST(student_number AS STRING), '') AS number, path FROM {source} AS s")
def k02(df):
    """A table as CSV under display headers, read back."""
    path = shared_folder(spark_of(df))
    sinks.write_sheet(df.select("class_id", "student_number", c("path").alias("image_path")), path)
    rows = spark_of(df).read.option("header", True).csv(path)
    return rows.select(c("クラス").alias("class_id"), F.coalesce(c("出席番号"), F.lit("")).alias("number"), c("画像パス").alias("path"))


def _club_photos(df):
    ranked = ranking.numbered(_club(df), ["club"], ["ng", F.desc("score"), "pos"])
    return ranked.select(
        "club", c("file").alias("original_file"), F.concat_ws("_", "club", "file").alias("renamed_file"), F.lit("20240501").alias("shooting_date"), "rank", c("people").cast("int").alias("person_count"),
        c("closed").alias("closed_eye_faces"), (c("closed") > 0).alias("eyes_closed_photo"), "formality", c("beauty").alias("quality"), "expression", c("gesture").alias("gesture_penalty"),
        c("ng").alias("ng_flag"), c("score").alias("total_score"), F.when(c("ng"), "eyes closed").otherwise("").alias("ng_reason"),
    )


def _club_faces(df):
    return df.select("club", "file", F.lit(0).alias("face_index"), (c("beauty") / 20).alias("left_eye_ratio"), (c("formality") / 20).alias("right_eye_ratio"), (c("closed") > 0).alias("eye_closed"))


RANKED_SQL = f"SELECT club, file, {CLUB_NG} AS ng, row_number() OVER (PARTITION BY club ORDER BY {CLUB_NG}, {CLUB_SCORE} DESC, pos) AS rank FROM {{source}} AS s"


@query("k05_club_workbook", CLUB, f"SELECT sheet, club, file, value FROM (SELECT 'リネーム結果' AS sheet, club, file, club || '_' || file AS value FROM ({RANKED_SQL}) AS a UNION ALL SELECT 'NG写真・要確認', club, file, 'はい' FROM ({RANKED_SQL}) AS b WHERE ng) AS t")
def k05(df):
    """The club workbook, two of its six sheets read back."""
    path = f"{shared_folder(spark_of(df))}.xlsx"
    parts = workbooks.write_sheets(reports.club_report(_club_photos(df), _club_faces(df)), path)
    wanted = (fixed.CLUB_SHEETS["Rename Output"], reports.REVIEW_SHEET)
    both = [workbooks.as_table(workbooks.read_back(spark_of(df), path, {s: parts[s]}), s, ["club", "file", "value"]).withColumn("sheet", F.lit(s)) for s in wanted]
    return both[0].unionByName(both[1]).select("sheet", "club", "file", "value")


@query("k05_club_totals", CLUB, f"SELECT club, CAST(count(*) AS STRING) AS photos, CAST(count(*) FILTER (WHERE closed > 0) AS STRING) AS closed_photos, CAST(sum(closed) AS STRING) AS closed_faces, CAST(count(*) FILTER (WHERE NOT ({CLUB_NG})) AS STRING) AS ranked FROM {{source}} AS s GROUP BY club")
def k05_totals(df):
    path = f"{shared_folder(spark_of(df))}.xlsx"
    name = fixed.CLUB_SHEETS["Eye Closure Summary"]
    workbooks.write_workbook({name: reports.club_report(_club_photos(df), _club_faces(df))[name]}, path)
    return workbooks.as_table(workbooks.read_cells(spark_of(df), path), name, ["club", "photos", "closed_photos", "closed_faces", "ranked"]).drop("row")


@query("k08_rebuilt_workbook", CLUB, f"SELECT club, file, CAST(CASE WHEN rank = 1 THEN 2 WHEN rank = 2 THEN 1 ELSE rank END AS STRING) AS rank FROM ({RANKED_SQL}) AS a WHERE NOT (rank = 3)")
def k08(df):
    """After ranks were changed by hand (first and second swapped, the third taken out) the sheets are made again."""
    photos = _club_photos(df)
    changes = photos.where("rank <= 3").select("club", "original_file", F.when(c("rank") < 3, 3 - c("rank")).alias("final_rank"), (c("rank") == 3).alias("excluded"))
    edited = relational.adjusted(photos, changes, ["club", "original_file"]).where(~c("excluded")).withColumn("rank", c("final_rank")).select(*photos.columns)
    path = f"{shared_folder(spark_of(df))}.xlsx"
    name = fixed.CLUB_SHEETS["Best Shot Ranking"]
    parts = workbooks.write_sheets({name: reports.club_report(edited, _club_faces(df))[name]}, path)
    return workbooks.as_table(workbooks.read_back(spark_of(df), path, parts), name, ["club", "file", "rank"]).drop("row")


@query("k27_eye_report", CLUB, "SELECT club, CAST(count(*) AS STRING) AS photos, CAST(count(*) FILTER (WHERE beauty / 20 <= 0.24 OR formality / 20 <= 0.24) AS STRING) AS closed_photos FROM {source} AS s GROUP BY club")
def k27(df):
    path = f"{shared_folder(spark_of(df))}.xlsx"
    parts = workbooks.write_sheets(reports.eye_report(_club_faces(df).drop("eye_closed")), path)
    return workbooks.as_table(workbooks.read_back(spark_of(df), path, {"Summary": parts["Summary"]}), "Summary", ["club", "photos", "closed_photos"]).drop("row")


@query("k03_integrated_workbook", CLUB, "SELECT sheet, file, flags FROM (SELECT 'Selected' AS sheet, file, '[' || CAST(closed AS STRING) || ',' || CAST(CAST(people AS INT) AS STRING) || ']' AS flags FROM {source} AS a WHERE NOT is_ng UNION ALL SELECT 'NG_Log', file, '[' || CAST(closed AS STRING) || ',' || CAST(CAST(people AS INT) AS STRING) || ']' FROM {source} AS b WHERE is_ng) AS t")
def k03(df):
    """Sheets in their order, lists as JSON text."""
    rows = df.select("file", F.array("closed", c("people").cast("int")).alias("flags"), "is_ng")
    path = f"{shared_folder(spark_of(df))}.xlsx"
    parts = workbooks.write_sheets(reports.integrated_report({"Selected": rows.where(~c("is_ng")).drop("is_ng"), "NG_Log": rows.where("is_ng").drop("is_ng")}), path)
    both = [workbooks.as_table(workbooks.read_back(spark_of(df), path, {s: p}), s, ["file", "flags"]).withColumn("sheet", F.lit(s)) for s, p in parts.items()]
    return both[0].unionByName(both[1]).select("sheet", "file", "flags")


@query_of("k09_staff_workbook", {"cards": CARD_ROWS, "people": STAFF}, "SELECT 'PDF教職員マスター' AS sheet, teacher_name AS name, CAST(NULL AS STRING) AS status FROM {people} AS p UNION ALL SELECT '照合結果', 'c' || CAST(card_id AS STRING), CASE WHEN card_id % 2 = 0 THEN '照合済み' ELSE 'un照合済み' END FROM {cards} AS k")
def k09(cards, people):
    """The staff workbook, the columns of two of its sheets read back."""
    matches = cards.select(F.concat(F.lit("c"), "card_id").alias("filename"), F.lit("").alias("renamed_filename"), F.when(c("card_id") % 2 == 0, "matched").otherwise("unmatched").alias("status"), c("name").alias("card_name"))
    prepared = staff.prepared_records(_records(people))
    master = people.select("pos", c("teacher_name").alias("name"), c("pos").alias("staff_pos"))
    shots = matches.select(c("card_name").alias("pdf_name"), F.lit(1).alias("rank"), "filename")
    sheets = reports.staff_report(matches, master, shots, staff.staff_by_subject(prepared))
    path = f"{shared_folder(spark_of(cards))}.xlsx"
    parts = workbooks.write_sheets(sheets, path)
    names = fixed.STAFF_SHEETS
    cells = workbooks.read_back(spark_of(cards), path, {names[n]: parts[names[n]] for n in ("PDF Staff Master", "Match Results")})
    one = workbooks.as_table(cells, names["PDF Staff Master"], ["name"]).select(F.lit(names["PDF Staff Master"]).alias("sheet"), "name", F.lit(None).cast("string").alias("status"))
    # An empty cell in the second column, so the status is the fourth of those written.
    two = workbooks.as_table(cells, names["Match Results"], ["name", "renamed", "card", "status"]).select(F.lit(names["Match Results"]).alias("sheet"), "name", "status")
    return one.unionByName(two)


@query("k11_subject_counts", STAFF, "SELECT subject, people, names FROM (SELECT subject, count(*) AS people, string_agg(teacher_name, ',' ORDER BY teacher_name) AS names FROM (SELECT teacher_name, CASE WHEN pos % 9 = 0 THEN '教頭' ELSE CASE pos % 4 WHEN 0 THEN '数学' WHEN 1 THEN '国語' WHEN 2 THEN '英語' ELSE '' END END AS subject FROM {source} AS s) AS a GROUP BY subject) AS t")
def k11(df):
    """K11 and H03."""
    return staff.staff_by_subject(staff.prepared_records(_records(df))).select("subject", "people", F.array_join("names", ",").alias("names"))


ERRORS_SQL = "(SELECT 'duplicate_number' AS error_type, class_id, student_number, count(*) AS n FROM {source} AS a WHERE student_number IS NOT NULL AND student_number % 17 <> 0 GROUP BY class_id, student_number HAVING count(*) > 1 UNION ALL SELECT 'missing_tag_shot', class_id, NULL, 1 FROM {source} AS b WHERE student_number IS NULL) AS t"


@query("k16_error_json", GROUPS, f"SELECT error_type, class_id, student_number, n FROM {ERRORS_SQL}")
def k16(df):
    """The error queue as JSON, read back under its schema."""
    path = shared_folder(spark_of(df))
    errors = _errors(df)
    sinks.write_json(errors, path)
    rows = sinks.read_json(spark_of(df), path, ", ".join(f"`{n}` {kind}" for n, kind in errors.dtypes))
    return rows.select("error_type", "class_id", "student_number", F.size("group_keys").cast("long").alias("n"))


@query("k17_error_rows", GROUPS, f"SELECT class_id, sum(n) AS groups, count(*) AS errors FROM {ERRORS_SQL} GROUP BY class_id")
def k17(df):
    """The localised error sheet as CSV, read back and counted."""
    path = shared_folder(spark_of(df))
    sheet = review.error_sheet(_errors(df))
    sheet.write.option("header", True).csv(path)
    rows = spark_of(df).read.option("header", True).csv(path)
    keys = F.size(F.split(c("関連グループキー"), r" \| "))
    return rows.groupBy(c("クラス").alias("class_id")).agg(F.sum(keys).alias("groups"), F.count("*").alias("errors"))


@query("k18_roster_json", "SELECT CAST(c_nationkey AS STRING) AS class, CAST(c_custkey AS INT) AS number, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS furigana FROM (SELECT c_nationkey, c_custkey, c_name, 'x' AS c_mktsegment FROM customer) AS k", "SELECT * FROM {source} AS s")
def k18(df):
    """Rows as JSON lines, nulls kept, read back."""
    path = shared_folder(spark_of(df))
    sinks.write_json(df, path)
    return sinks.read_json(spark_of(df), path, "class string, number int, name string, furigana string")


@query("s29_missing_log", "SELECT event_id AS id, event_type AS error_id FROM events", "SELECT id FROM {source} AS s")
def s29(df):
    """A path that is not there is an empty table; none of the events is resolved by it."""
    log = sinks.read_json(spark_of(df), f"{shared_folder(spark_of(df))}/none", "error_id string")
    return df.join(log, "error_id", "left_anti").select("id")


FILES = "SELECT concat('a', CAST(p_partkey % 20 AS STRING), '.zip') AS archive, concat(CASE p_partkey % 3 WHEN 0 THEN 'club/' WHEN 1 THEN 'other/' ELSE '' END, 'f', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '.JPG' ELSE '.txt' END) AS member, p_name AS name FROM part"


@query("k23_zip_round_trip", FILES, "SELECT archive, member, octet_length(encode(name)) AS size, md5(name) AS digest FROM {source} AS s")
def k23(df):
    """Members packed into archives and read from them."""
    packed = zips.archives(df.select("archive", "member", c("name").cast("binary").alias("content")))
    return zips.unpacked(packed).select("archive", "member", "size", F.md5("content").alias("digest"))


@query("k07_club_zip", FILES, "SELECT member FROM {source} AS s WHERE member LIKE 'club/%' AND member LIKE '%.JPG'")
def k07(df):
    """Only handed-out folders, only pictures."""
    packed = zips.archives(zips.top_folders(df.select("archive", "member", c("name").cast("binary").alias("content")), ("club",)))
    return zips.unpacked(packed, (".jpg",)).select("member")


@query("s06_zip_source", FILES, "SELECT concat(replace(replace(archive, '.zip', ''), '/', '_'), '.zip') AS archive, member, octet_length(encode(name)) AS size, md5(name) AS digest FROM {source} AS s")
def s06(df):
    """Archives written to a folder and read by the data source, members dealt over partitions."""
    spark, folder = zip_source.registered(spark_of(df)), f"{shared_folder(spark_of(df))}/zips"
    written(zip_source.written_archives(zips.archives(df.select("archive", "member", c("name").cast("binary").alias("content"))), folder), "archives")
    rows = spark.read.format("zip").schema("archive string, member string, size long, content binary").load(folder)
    return rows.select(F.substring_index("archive", "/", -1).alias("archive"), "member", "size", F.md5("content").alias("digest"))


# --- sources ---


@query("s13_photo_root", LISTED, "SELECT CASE WHEN max(CASE WHEN contains(rel, '/') THEN 0 ELSE 1 END) = 0 AND count(DISTINCT split_part(rel, '/', 1)) = 1 THEN min(split_part(rel, '/', 1)) ELSE '' END AS root, count(*) AS files FROM (SELECT substr(path, 5) AS rel FROM {source} AS s WHERE NOT suffix(path, '.txt')) AS t")
def s13(df):
    listed = files.described(df, "/in")
    return listed.agg(F.lit(files.photo_root(listed)).alias("root"), F.count("*").alias("files"))


@query("s05_first_folders", LISTED, "SELECT split_part(rel, '/', 1) AS folder, count(*) AS n FROM (SELECT substr(path, 5) AS rel FROM {source} AS s WHERE NOT suffix(path, '.txt')) AS t WHERE contains(rel, '/') GROUP BY 1")
def s05(df):
    return files.grouped_by_folder(files.described(df, "/in")).groupBy("folder").agg(F.count("*").alias("n"))


TIMES = "SELECT event_id AS id, ts, CASE event_id % 4 WHEN 0 THEN '2024:02:30 10:00:00' WHEN 1 THEN '2024:02:03 10:11:12' ELSE NULL END AS original, CASE event_id % 4 WHEN 2 THEN '2023:12:31 23:59:59' WHEN 0 THEN 'junk' ELSE NULL END AS digitized FROM events"


@query("s17_captured", TIMES, "SELECT id, CASE id % 4 WHEN 1 THEN '2024-02-03 10:11:12' WHEN 2 THEN '2023-12-31 23:59:59' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS taken, CASE id % 4 WHEN 1 THEN '20240203' WHEN 2 THEN '20231231' ELSE strftime(ts, '%Y%m%d') END AS day FROM {source} AS s")
def s17(df):
    """The first tag that is a time, else the file's."""
    taken = files.captured([c("original"), c("digitized")], c("ts").cast("timestamp"))
    return df.select("id", X.capture_text(taken).alias("taken"), X.shooting_date(taken).alias("day"))


PACKAGES = "SELECT event_id AS size, concat('2025_north_IMG', CAST(event_id AS STRING), '_3A', lpad(CAST(user_id % 40 AS STRING), 2, '0'), CASE event_id % 4 WHEN 0 THEN '_best' WHEN 1 THEN concat('_backup', CAST(event_id % 3 + 2 AS STRING)) WHEN 2 THEN '_tag' ELSE '' END, '.jpg') AS name FROM events"


@query("s35_lowest_files", PACKAGES, "SELECT student, kind, arg_min(name, k) AS file FROM (SELECT CAST(regexp_extract(name, '_3A([0-9]{2})_', 1) AS INT) AS student, CASE size % 4 WHEN 2 THEN 'card' ELSE 'portrait' END AS kind, name, (CASE size % 4 WHEN 1 THEN size % 3 + 2 ELSE 0 END, name) AS k FROM {source} AS s WHERE size % 4 < 3) AS t GROUP BY student, kind")
def s35(df):
    return files.lowest_files(df)


@query("s34_absent_numbers", "SELECT o_custkey AS k, concat(CAST(o_custkey AS STRING), ', x', CAST(o_custkey AS STRING), ',', CAST(o_custkey + 1 AS STRING)) AS line FROM orders", "SELECT DISTINCT CAST(number AS INT) AS number FROM (SELECT k AS number FROM {source} AS a UNION ALL SELECT k + 1 FROM {source} AS b) AS t")
def s34(df):
    path = shared_folder(spark_of(df))
    df.select("line").write.text(path)
    return files.absent_numbers(spark_of(df), path)


TITLED = """SELECT concat('s', CAST(c_nationkey AS STRING)) AS sheet, CAST(1 AS INT) AS row, CAST(1 AS INT) AS col, concat('3年', CAST(c_nationkey AS STRING), '組') AS value FROM customer GROUP BY c_nationkey
 UNION ALL SELECT concat('s', CAST(c_nationkey AS STRING)), CAST(2 AS INT), CAST(1 AS INT), '番号' FROM customer GROUP BY c_nationkey
 UNION ALL SELECT concat('s', CAST(c_nationkey AS STRING)), CAST(n + 2 AS INT), CAST(1 AS INT), CAST(n AS STRING) FROM (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) AS a
 UNION ALL SELECT concat('s', CAST(c_nationkey AS STRING)), CAST(n + 2 AS INT), CAST(2 AS INT), c_name FROM (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) AS b"""


@query("s24_roster_format_b", TITLED, "SELECT '3-' || substr(a.sheet, 2) AS class, CAST(a.value AS INT) AS number, b.value AS name FROM {source} AS a JOIN {source} AS b ON a.sheet = b.sheet AND a.row = b.row AND a.col = 1 AND b.col = 2 WHERE a.row > 2")
def s24(df):
    return rosters.format_b(df).select("class", "number", "name")


HEADED = """SELECT concat('s', CAST(c_nationkey AS STRING)) AS sheet, CAST(2 AS INT) AS row, CAST(2 AS INT) AS col, 'No' AS value FROM customer GROUP BY c_nationkey
 UNION ALL SELECT concat('s', CAST(c_nationkey AS STRING)), CAST(2 AS INT), CAST(4 AS INT), '氏名' FROM customer GROUP BY c_nationkey
 UNION ALL SELECT concat('s', CAST(c_nationkey AS STRING)), CAST(c_custkey + 2 AS INT), CAST(2 AS INT), CAST(c_custkey % 40 AS STRING) FROM customer
 UNION ALL SELECT concat('s', CAST(c_nationkey AS STRING)), CAST(c_custkey + 2 AS INT), CAST(4 AS INT), c_name FROM customer"""


@query("s26_roster_generic", HEADED, "SELECT class, number, name FROM (SELECT a.sheet AS class, CAST(a.value AS INT) AS number, b.value AS name, row_number() OVER (PARTITION BY a.sheet, a.value ORDER BY a.row) AS n FROM {source} AS a JOIN {source} AS b ON a.sheet = b.sheet AND a.row = b.row AND a.col = 2 AND b.col = 4 WHERE a.row > 2) AS t WHERE n = 1")
def s26(df):
    return rosters.generic(df).select("class", "number", "name")


SNIFFED = f"SELECT concat('A', sheet) AS sheet, row, col, CASE WHEN row = 1 THEN 'HR7' ELSE value END AS value FROM ({HEADED}) AS x UNION ALL SELECT concat('A', sheet), 1, 9, 'HR07' FROM ({HEADED}) AS u WHERE row = 2 AND col = 2 UNION ALL SELECT concat('B', sheet), row, col, value FROM ({TITLED}) AS y UNION ALL SELECT concat('C', sheet), row, col, value FROM ({HEADED}) AS z"


@query("s23_three_formats", SNIFFED, "SELECT DISTINCT sheet, CASE substr(sheet, 1, 1) WHEN 'C' THEN 'generic' ELSE substr(sheet, 1, 1) END AS format FROM {source} AS s")
def s23(df):
    return rosters.sniffed(df)


@query("s23_workbook_cells", CLUB, "SELECT club AS sheet, CAST(row_number() OVER (PARTITION BY club ORDER BY pos) + 1 AS INT) AS row, file FROM {source} AS s")
def s23_cells(df):
    """A workbook with a sheet for each club, as cells."""
    clubs = [r.club for r in df.select("club").distinct().orderBy("club").collect()]
    path = f"{shared_folder(spark_of(df))}.xlsx"
    workbooks.write_workbook({n: df.where(c("club") == n).orderBy("pos").select("file", "is_ng", "beauty") for n in clubs}, path)
    return workbooks.read_cells(spark_of(df), path).where("row > 1 and col = 1").select("sheet", "row", c("value").alias("file"))


PICTURE = "SELECT p_partkey AS id, CAST(p_partkey % 5 + 2 AS INT) AS w, CAST(p_partkey % 7 + 1 AS INT) AS h, CAST(p_partkey % 200 + 20 AS INT) AS k, p_partkey % 10 = 0 AS broken FROM part"


@query("s14_decoded", PICTURE, "SELECT id, CASE WHEN NOT broken THEN h END AS height, CASE WHEN NOT broken THEN w END AS width, CASE WHEN NOT broken THEN h * w * 3 END AS bytes FROM {source} AS s")
def s14(df):
    """Grey pictures decoded to three channels; unreadable ones have nulls."""
    header = F.concat(F.lit("P5 "), "w", F.lit(" "), "h", F.lit(" 255\n"))
    body = F.unhex(F.repeat(F.lpad(F.hex("k"), 2, "0"), c("w") * c("h")))
    rows = df.select("id", F.when(c("broken"), F.lit("P5 9").cast("binary")).otherwise(F.concat(header.cast("binary"), body)).alias("content"))
    return pixels.decoded(rows, "id").select("id", "height", "width", F.octet_length("rgb").alias("bytes"))


def _pictures(df):
    """Pictures of w by h, whose first column of pixels has the value k and the others 250."""
    return df.select("id", (c("h") * 4).alias("height"), (c("w") * 4).alias("width"), F.unhex(F.repeat(F.concat(F.repeat(F.lpad(F.hex("k"), 2, "0"), F.lit(3)), F.repeat(F.lit("FA"), (c("w") * 4 - 1) * 3)), c("h") * 4)).alias("rgb"))


@query("f24_white_pictures", PICTURE, "SELECT id, CAST(w * 4 - CASE WHEN k >= 180 THEN 0 ELSE 1 END AS DOUBLE) / (w * 4) >= 0.9 AS white, h * 2 AS height, w * 2 AS width, 16 * w + 16 * h - 16 AS drawn FROM {source} AS s")
def f24(df):
    """White pictures, pictures scaled to half, and pixels of a frame drawn inside."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for p in batches:
            out, seen = [], {}
            for r in p.itertuples(index=False):
                # Equal pictures of a batch are looked at once.
                if (key := (r.height, r.width, r.rgb)) not in seen:
                    x = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
                    small = pixels.resized(x, max(r.height, r.width) // 2)
                    drawn = (pixels.framed(x, (0, 0, r.width, r.height)) == np.array([255, 0, 0])).all(2).sum()
                    seen[key] = pixels.mostly_white(x, 0.9), small.shape[0], small.shape[1], int(drawn)
                out.append((r.id, *seen[key]))
            yield pd.DataFrame(out, columns=["id", "white", "height", "width", "drawn"])

    # Rows of a few bytes become pictures of many, so they are dealt to all tasks before.
    dealt = df.repartition(int(spark_of(df).conf.get("spark.sql.shuffle.partitions")), "id")
    return _pictures(dealt).mapInPandas(run, "id long, white boolean, height int, width int, drawn int")


# --- answers of models ---


@query("m03_club_evaluation", CLUB.replace("FROM part", ", CASE p_partkey % 3 WHEN 0 THEN 'sorry' WHEN 1 THEN NULL ELSE concat('ok {\"formality_score\": ', CAST(p_size % 11 AS STRING), ', \"is_ng\": true}') END AS answer FROM part"), "SELECT pos, CASE WHEN pos % 3 = 2 THEN formality ELSE CAST(greatest(0, 8 - closed) AS DOUBLE) END AS formality, CASE WHEN pos % 3 = 2 THEN 0.0 ELSE 7.0 END AS beauty, CASE WHEN pos % 3 = 2 THEN true ELSE CAST(people AS INT) = 0 END AS is_ng, pos % 3 = 2 AS from_model FROM {source} AS s")
def m03(df):
    return df.select("pos", providers.club_evaluation(c("answer"), c("people").cast("int"), c("closed")).alias("e")).select("pos", "e.formality", "e.beauty", "e.is_ng", "e.from_model")


UNIFIED = """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN concat('{"image_type": "card", "card": {"name": "n', CAST(event_id AS STRING), '", "confidence": 0.5}, "portrait": null}')
 WHEN 1 THEN concat('{"portrait": {"suitability_score": ', CAST(event_id % 10 AS STRING), ', "beauty_score": 4, "expression_score": 5, "is_ng": false}}') WHEN 2 THEN '{"image_type": "portrait", "portrait": {"is_ng": true}}' ELSE 'no' END AS answer FROM events"""


@query("m07_unified_read", UNIFIED, "SELECT id, CASE id % 4 WHEN 0 THEN 'card' WHEN 3 THEN NULL ELSE 'portrait' END AS image_type, CASE WHEN id % 4 = 0 THEN 'n' || CAST(id AS STRING) END AS name, CASE id % 4 WHEN 1 THEN round(0.5 * (id % 10) + 2.2, 4) WHEN 2 THEN -1.0 END AS composite_score, CASE WHEN id % 4 = 3 THEN 'no' END AS raw FROM {source} AS s")
def m07(df):
    return df.select("id", providers.unified_read(c("answer")).alias("x")).select("id", "x.image_type", "x.name", F.round("x.composite_score", 4).alias("composite_score"), "x.raw")


CARDS = "SELECT event_id AS id, CAST(event_id % 10 AS INT) AS k FROM events"


def _card_reader(text: str) -> str | None:
    """Sure of digits from 7 on at first, of those from 4 on when asked again; at 3 it answers without an object."""
    again, n = text.startswith("again"), int(text.split()[-1])
    if n == 3:
        return "?"
    return '{"name": "%s%d", "confidence": %.1f}' % ("b" if again else "a", n, 0.9 if n >= (4 if again else 7) else 0.3 - 0.1 * again * (n == 1))


@query("m08_card_read", CARDS, "SELECT id, CASE WHEN k = 3 THEN NULL WHEN k >= 7 OR k = 1 THEN 'a' || CAST(k AS STRING) ELSE 'b' || CAST(k AS STRING) END AS name, CASE WHEN k = 3 THEN '?' END AS raw, k < 7 AND k <> 3 AS retried FROM {source} AS s")
def m08(df):
    """M08, M07's and A34's second reading."""
    rows = providers.read_twice(df, F.concat_ws(" ", F.lit("read"), "k"), lambda first: F.concat_ws(" ", F.lit("again"), F.regexp_extract(first["name"], r"(\d+)", 1)), providers.FunctionProvider(_card_reader))
    return rows.select("id", c("card.name").alias("name"), c("card.raw").alias("raw"), "retried")


def _row_repairer(text: str) -> str | None:
    head, *lines = text.split("\n")
    if int(head.split()[1]) % 3 == 0:
        return "cut"
    return '{"records": [%s]}' % ", ".join(f'{{"teacher_name": "{line}", "confidence": 0.5}}' for line in lines)


@query("m09_row_repair", "SELECT s_nationkey AS page, s_suppkey AS pos, s_name AS text FROM supplier", "SELECT page, CAST(n // 18 AS INT) AS chunk, CAST(n % 18 AS INT) AS place, text AS teacher_name FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS n FROM {source} AS s) AS t WHERE (n // 18 + 1) % 3 <> 0")
def m09(df):
    """M09 and M10's records: rows of a page in chunks of 18; a chunk whose answer has no object gives none."""
    request = lambda k, text: F.concat(F.lit("CHUNK "), k.cast("string"), F.lit("\n"), text)
    return providers.repaired_rows(df, ["page"], "pos", "text", request, providers.FunctionProvider(_row_repairer)).select("page", "chunk", "place", "teacher_name")


PAGES = """SELECT event_id AS page, CASE event_id % 3 WHEN 0 THEN concat('{"file": "f", "records": [{"surname": "s', CAST(event_id AS STRING), '", "subjects": ["a", "b"]}, {"surname": "t"}]}') WHEN 1 THEN '{"records": []}' ELSE 'none' END AS answer FROM events"""


@query("m10_page_records", PAGES, "SELECT page, 0 AS place, 's' || CAST(page AS STRING) AS surname, 2 AS subjects FROM {source} AS a WHERE page % 3 = 0 UNION ALL SELECT page, 1, 't', NULL FROM {source} AS b WHERE page % 3 = 0")
def m10(df):
    return providers.staff_records(df, ["page"]).select("page", "place", "surname", F.when(c("subjects").isNotNull(), F.size("subjects")).alias("subjects"))


TWO_READS = """SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE '{"family_name": "山田", "given_name": "太", "class_label": "", "role": ""}' END AS one,
 CASE event_id % 3 WHEN 0 THEN '{"family_name": "山田", "given_name": "太郎", "class_label": "3-1", "role": "担任"}' WHEN 1 THEN '{"family_name": "山田", "given_name": "太"}' ELSE '{"family_name": "山", "given_name": "太", "role": "副担任"}' END AS two FROM events"""


@query("m15_teacher_read", TWO_READS, "SELECT id, CASE WHEN id % 5 <> 0 THEN CASE WHEN id % 3 = 0 THEN '山田 太郎' ELSE '山田 太' END END AS name, CASE WHEN id % 5 <> 0 THEN CASE WHEN id % 3 = 0 THEN '3-1' ELSE '' END END AS class_label, CASE WHEN id % 5 <> 0 THEN CASE id % 3 WHEN 0 THEN '担任' WHEN 1 THEN '' ELSE '副担任' END END AS role, CASE WHEN id % 5 <> 0 THEN CASE WHEN id % 3 = 1 THEN 0.97 ELSE 0.9 END END AS confidence FROM {source} AS s")
def m15(df):
    return df.select("id", providers.teacher_read(c("one"), c("two")).alias("x")).select("id", "x.name", "x.class_label", "x.role", "x.confidence")


@query("m02_prompt_lengths", "SELECT event_id AS id, event_type AS kind, user_id AS usr FROM events", "SELECT id, CAST(length('Rate this ' || kind || ' photo (folder 3, grade ' || CAST(usr AS STRING) || '). Answer with one JSON object.') % 10 AS DOUBLE) AS technical FROM {source} AS s")
def m02(df):
    """What a provider is sent; the folder comes before the grade in the text."""
    request = providers.prompt(c("kind"), c("usr").cast("string"), F.lit("3"))
    rows = providers.asked(df, request, providers.FunctionProvider(lambda text: '{"technical": %d}' % (len(text) % 10)))
    return rows.select("id", X.json_object(c("answer"), "technical double", "technical")["technical"].alias("technical"))


# --- helpers and single functions ---


@query("x25_lenient_json", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN concat('```json {\"n\": ', CAST(event_id AS STRING), '} ```') WHEN 1 THEN '{}' ELSE 'none' END AS raw FROM events", "SELECT id, id % 3 < 2 AS found, CASE WHEN id % 3 = 0 THEN id END AS n FROM {source} AS s")
def x25(df):
    """Fields of an object with text around it; null only without an object."""
    x = X.json_fields(c("raw"), "n long")
    return df.select("id", x.isNotNull().alias("found"), x["n"].alias("n"))


@query("x27_cut_objects", "SELECT event_id AS id, concat(CASE event_id % 3 WHEN 0 THEN '{\"class\": \"3A\", \"n\": ' WHEN 1 THEN '{\"rows\": [{\"n\": ' ELSE 'x [' END, CAST(event_id AS STRING), CASE event_id % 3 WHEN 0 THEN ', \"x\": \"tr' WHEN 1 THEN '}, {\"n\": \"' ELSE ', ' END) AS raw FROM events", "SELECT id, CASE id % 3 WHEN 0 THEN '{\"class\": \"3A\", \"n\": ' || CAST(id AS STRING) || '}' WHEN 1 THEN '{\"rows\": [{\"n\": ' || CAST(id AS STRING) || '}]}' ELSE '[' || CAST(id AS STRING) || ']' END AS whole FROM {source} AS s")
def x27(df):
    from ..functions import names

    return df.select("id", names.repaired_json(c("raw")).alias("whole"))


@query("x30_unique_names", "SELECT event_id AS id, concat('a', CAST(event_id % 7 AS STRING), CASE WHEN event_id % 2 = 0 THEN '.jpg' ELSE '' END) AS name FROM events", "SELECT id, CASE WHEN n = 1 THEN name WHEN suffix(name, '.jpg') THEN replace(name, '.jpg', '') || '__dup' || CAST(n AS STRING) || '.jpg' ELSE name || '__dup' || CAST(n AS STRING) END AS shown FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM {source} AS s) AS t")
def x30(df):
    rows = ranking.numbered(df, ["name"], ["id"], "n")
    return rows.select("id", X.unique_names(c("name"), c("n")).alias("shown"))


@query("x38_narrow", "SELECT event_id AS id, concat('Ａｂ', CAST(event_id AS STRING), '　！') AS wide FROM events", "SELECT id, 'Ab' || CAST(id AS STRING) || ' !' AS narrow FROM {source} AS s")
def x38(df):
    return df.select("id", X.narrow(c("wide")).alias("narrow"))


@query("x54_media_type", "SELECT event_id AS id, concat('a/b.', CASE event_id % 4 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'tif' WHEN 2 THEN 'webp' ELSE 'doc' END) AS path FROM events", "SELECT id, CASE id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/tiff' WHEN 2 THEN 'image/webp' ELSE 'application/octet-stream' END AS media FROM {source} AS s")
def x54(df):
    return df.select("id", X.media_type(c("path")).alias("media"))


@query("x62_cell_values", "SELECT event_id AS id, value, event_id % 2 = 0 AS flag, ts FROM events", "SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE CAST(id AS STRING) END AS number, CASE WHEN flag THEN 'はい' ELSE 'いいえ' END AS flag, CASE WHEN id % 3 = 0 THEN '' ELSE 'a, ' || CAST(id AS STRING) END AS items FROM {source} AS s")
def x62(df):
    some = c("id") % 3 != 0
    return df.select(
        "id", X.sheet_value(F.when(some, c("id")), "bigint").alias("number"), X.sheet_value(c("flag"), "boolean").alias("flag"),
        X.sheet_value(F.when(some, F.array(F.lit("a"), c("id").cast("string"))), "array<string>").alias("items"),
    )


HEADERS = {"Original Filename": "元ファイル名", "Card Name (OCR)": "札氏名（OCR）", "detection_layer": "検出レイヤー", "dedup_reduction_rate": "重複削減率", "other_passing_count": "通過写真枚数", "is_ng": "NG判定", "matched": "照合済み", "zzz": "zzz"}


@query("p30_headers", "SELECT o_orderkey AS id, CAST(o_orderkey % 8 AS INT) AS k FROM orders", "SELECT id, ['" + "', '".join(HEADERS) + "'][k + 1] AS name, ['" + "', '".join(HEADERS.values()) + "'][k + 1] AS shown FROM {source} AS s")
def p30(df):
    """Display names of the columns and terms that rows name."""
    names = F.array(*map(F.lit, HEADERS))
    return df.select("id", names[c("k")].alias("name"), F.array(*[F.lit(X.header(n)) for n in HEADERS])[c("k")].alias("shown"))


@query("h09_lists_and_unions", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS tag FROM orders", "SELECT id, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN id % 3 = 0 THEN 'b' END AS extra FROM {source} AS s")
def h09(df):
    """Null as an empty list, and a union of tables with other columns."""
    rows = df.select("id", F.size(T.as_list(F.when(c("tag").isNotNull(), F.array("tag")), "string")).alias("n"))
    return T.united([rows.where("id % 3 <> 0"), rows.where("id % 3 = 0").withColumn("extra", F.lit("b"))])


@query("h11_empty_evaluations", "SELECT concat('p', CAST(o_orderkey AS STRING)) AS path FROM orders", "SELECT path, 0 AS known FROM {source} AS s")
def h11(df):
    """The empty table of evaluations takes rows that have only a path; all else is unknown."""
    rows = T.empty_evaluations(spark_of(df)).unionByName(df, allowMissingColumns=True)
    known = [F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in rows.columns if n != "path"]
    return rows.select("path", sum(known[1:], known[0]).alias("known"))


@query("h29_frame_bounds", "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS top, p_retailprice AS left_at FROM part", "SELECT id, round(left_at + 40 - left_at, 4) AS width, round(top + 44 - top, 4) AS height, top AS y FROM {source} AS s")
def h29(df):
    from ..operators import geometry

    b = geometry.bounds(c("top"), c("left_at"), c("top") + 44, c("left_at") + 40)
    return df.select("id", F.round(b["width"], 4).alias("width"), F.round(b["height"], 4).alias("height"), b["top"].alias("y"))


@query_of("p24_strict_ratios", {"guides": LINES, "frames": ALL_FRAMES}, "SELECT f.frame, round(CASE WHEN n >= 2 THEN (a - top) / (bottom - top) END, 3) AS top_ratio, round(CASE WHEN n >= 2 THEN (z - top) / (bottom - top) END, 3) AS bottom_ratio FROM {frames} AS f LEFT JOIN (SELECT frame, count(*) AS n, min(y) AS a, max(y) AS z FROM {guides} AS g JOIN {frames} AS e ON g.page = e.page AND y > top AND y < bottom GROUP BY frame) AS i ON i.frame = f.frame")
def p24(guides, frames):
    from ..operators import geometry

    return geometry.strict_ratios(frames, guides, "page").select("frame", "top_ratio", "bottom_ratio")


@query("h28_text_frames", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'names' WHEN 1 THEN 'Names' ELSE 'x' END AS layer FROM part", "SELECT id FROM {source} AS s WHERE layer = 'names'")
def h28(df):
    return T.on_layer(df, "names").select("id")


@query("h33_log_points", "SELECT p_partkey AS id, p_retailprice / 7 AS a FROM part", "SELECT id, CAST(2 AS INT) AS n, round(a + 1, 1) AS x FROM {source} AS s")
def h33(df):
    points = F.array(*[F.struct((c("a") + k).alias("x"), F.lit(0.0).alias("y")) for k in range(4)])
    kept = T.rounded_points(points, 1, 2)
    return df.select("id", F.size(kept).alias("n"), F.round(kept[0]["x"], 1).alias("x"))


@query("o07_report_order", CLUB, "SELECT pos, row_number() OVER (ORDER BY club, closed = 0 DESC, file) AS place FROM {source} AS s")
def o07(df):
    """O07 as places; the sort is the writer's."""
    rows = T.report_order(df.select("pos", c("club").alias("cluster"), (c("closed") == 0).alias("representative"), "file"))
    lead = ranking.text_lead(c("cluster"), F.lit(0))
    return ranking.numbered_in_all(rows, ["cluster", F.desc("representative"), "file"], lead, "place").select("pos", "place")


@query("a01_first_of_each", CLUB, "SELECT club, closed, min(pos) AS pos, count(*) AS n FROM {source} AS s GROUP BY club, closed")
def a01(df):
    """Groups as lists, whose first row stands for them."""
    sizes = df.groupBy("club", "closed").agg(F.count("*").alias("n"))
    return ranking.first_of(df, ["club", "closed"], ["pos"]).select("club", "closed", "pos").join(sizes, ["club", "closed"])


@query_of("h08_listed_pictures", {"wanted": "SELECT l_partkey AS path, l_orderkey * 10 + l_linenumber AS id FROM lineitem", "files": "SELECT p_partkey AS path FROM part WHERE p_size < 25"}, "SELECT id FROM {wanted} AS w WHERE path IN (SELECT path FROM {files} AS f)")
def h08(wanted, files):
    return T.existing(wanted, files).select("id")


@query("j21_timetable_scores", STAFF, "SELECT pos, round(1.0 + CASE WHEN subject <> '' THEN 0.6 ELSE 0 END, 4) AS score FROM {source} AS s")
def j21(df):
    """J21 of each record with itself as a person: equal names, and a shared main subject where there is one."""
    import pandas as pd

    def run(batches):
        for p in batches:
            people = [staff.Person(n, {s} - {""}) for n, s in zip(p.teacher_name, p.subject, strict=True)]
            yield pd.DataFrame({"pos": p.pos, "score": [round(staff.timetable_score(x, x), 4) for x in people]})

    return df.select("pos", "teacher_name", "subject").mapInPandas(run, "pos long, score double")


# --- whole results of operators whose other queries show a part ---


def _rules_sql() -> str:
    rows = []
    for event, r in fixed.EVENT_RULES.items():
        groups = "|".join("/".join(g) for g in r.tag_groups)
        most = "NULL" if r.transit_most is None else r.transit_most
        rows.append(f"('{event}', '{groups}', {r.landmarks}, {r.cheering[0]}, {r.cheering[1]}, {most}, {r.by_class}, {r.by_day}, {r.ball})")
    return f"(VALUES {', '.join(rows)}) AS r(event, tag_groups, landmarks, least, most, transit_most, by_class, by_day, ball)"


@query("x34_all_rules", "SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN 'general' WHEN 1 THEN 'entrance_ceremony' WHEN 2 THEN 'field_trip' WHEN 3 THEN 'sports_festival' WHEN 4 THEN 'other_athletic' WHEN 5 THEN 'cultural_festival' WHEN 6 THEN 'other_cultural' WHEN 7 THEN 'school_trip' WHEN 8 THEN 'other_off_campus' ELSE o_orderpriority END AS event FROM orders", "SELECT s.id, r.tag_groups, r.landmarks, r.least, r.most, r.transit_most, r.by_class, r.by_day, r.ball FROM (SELECT id, CASE WHEN id % 10 = 9 THEN 'general' ELSE event END AS event FROM {source} AS a) AS s JOIN " + _rules_sql() + " ON r.event = s.event")
def x34(df):
    groups = F.array_join(F.transform("tag_groups", lambda g: F.array_join(g, "/")), "|")
    return T.with_rules(df).select("id", groups.alias("tag_groups"), "landmarks", "cheering.least", "cheering.most", "transit_most", "by_class", "by_day", "ball")


@query("s12_class_levels", "SELECT concat('/in/day', CAST(event_id % 5 AS STRING), '/', CASE WHEN event_id % 11 = 0 THEN 'x' ELSE concat(CAST(event_id % 3 + 1 AS STRING), CASE event_id % 2 WHEN 0 THEN 'A' ELSE 'b' END) END, '/IMG_', CAST(event_id AS STRING), '.jpg') AS path, ts AS modified, event_id AS size FROM events", "SELECT size, CAST(size % 3 + 1 AS STRING) || CASE WHEN size % 2 = 0 THEN 'A' ELSE 'b' END AS class_id FROM {source} AS s WHERE size % 11 <> 0")
def s12(df):
    """S12 where no folder of the first level is a class, so those of the second count."""
    return files.class_folders(files.described(df, "/in")).select("size", "class_id")


@query("a18_error_groups", GROUPS, "SELECT 'duplicate_number' AS error_type, class_id, string_agg(class_id || '::' || CAST(group_idx AS STRING), ',' ORDER BY group_idx) AS keys FROM {source} AS a WHERE student_number IS NOT NULL AND student_number % 17 <> 0 GROUP BY class_id, student_number HAVING count(*) > 1 UNION ALL SELECT 'missing_tag_shot', class_id, class_id || '::' || CAST(group_idx AS STRING) FROM {source} AS b WHERE student_number IS NULL")
def a18(df):
    return _errors(df).select("error_type", "class_id", F.array_join("group_keys", ",").alias("keys"))


@query_of("k13_manifest_entries", {"portraits": PICTURES, "roster": PUPILS}, """SELECT class_id, number, coalesce(name, '') AS name, best IS NULL AS absent, '2025_North_' || replace(best, '.jpg', '') || '_' || class_id || lpad(CAST(number AS STRING), 2, '0') || '_best.jpg' AS best, pictures FROM
 (SELECT coalesce(p.class_id, r.class_id) AS class_id, coalesce(p.number, r.number) AS number, r.name, p.best, CASE WHEN p.best IS NULL THEN 0 ELSE least(p.n, 4) END AS pictures FROM
 (SELECT class_id, student_number AS number, max(CASE WHEN k = 1 THEN path END) AS best, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY class_id, student_number ORDER BY is_ng, score DESC, pos) AS k FROM {portraits} AS a) AS b GROUP BY class_id, student_number) AS p
 FULL JOIN (SELECT class_id, number, min(name) AS name FROM {roster} AS d GROUP BY class_id, number) AS r ON p.class_id = r.class_id AND p.number = r.number) AS t""")
def k13(portraits, roster):
    """The entries of every class."""
    rows = review.manifest(portraits, roster, "2025", "North").select("class_id", F.explode("entries").alias("e"))
    kept = F.from_json("e.files", "map<string, string>")
    return rows.select("class_id", "e.number", "e.name", "e.absent", F.get_json_object("e.files", "$.best").alias("best"), F.coalesce(F.nullif(F.size(kept), F.lit(-1)), F.lit(0)).cast("long").alias("pictures"))


SCALE_SQL = "greatest(100.0, least(400.0, eyes * fw / (eye_dist * fw) * 100))"


#: The same shares in both engines, whatever they make of decimals.
SHARES = ENTRIES.replace("93.7177", "CAST(93.7177 AS DOUBLE)").replace("97.3", "CAST(97.3 AS DOUBLE)")


@query("p20_offsets", SHARES, f"SELECT id, CASE WHEN fw IS NULL OR chin_y IS NULL THEN 12.0 ELSE round(0.86 * fh - (fh / 2 + ((fh - fw / 0.8) / 2 + chin_y * fw / 0.8 - fh / 2) * {SCALE_SQL} / 100), 2) END AS offset_y, CASE WHEN fw IS NULL OR chin_y IS NULL THEN 127.0 ELSE round({SCALE_SQL} + 1e-9, 1) END AS scale FROM (SELECT *, CASE role WHEN 'student' THEN 36.0 WHEN 'teacher' THEN 46.0 END AS fw, CASE role WHEN 'student' THEN 44.0 ELSE 54.0 END AS fh, CASE role WHEN 'student' THEN 0.32 ELSE 0.22 END AS eyes FROM {{source}} AS s) AS t")
def p20(df):
    """P20 with P17 to P19: pictures of 4 by 5 in frames that are a little wider."""
    from ..operators import geometry

    roles = spark_of(df).createDataFrame([("student", 36.0, 44.0, 0.2, 0.86), ("teacher", 46.0, 54.0, None, None)], "role string, frame_w double, frame_h double, top_ratio double, bottom_ratio double")
    return geometry.manifest_offsets(df, roles).select("id", "offset_y", "scale")
