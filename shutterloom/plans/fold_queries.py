"""Folds, staff resolution, review flow, geometry, sources and streams as queries."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers, names, pixels, providers, scores
from ..functions import scalars as X
from ..operators import clustering, fuzzy, geometry, islands, relational, review, selection, staff, tables
from ..sources import arrivals, files, rosters, zip_source, zips
from ..sources.folders import shared_folder, written
from ..streaming import incremental, people
from ..streaming.log import Log
from .ranking_queries import EVALS, PHOTOS
from .registry import ORACLES, QUERIES, inputs, query, query_of

c = F.col
#: The vectors of the driver tables are far apart, so queries take lower bounds than the defaults.
LOW_RULES = ((0.35, 4 * 86400.0, 200), (0.30, 86400.0, 100), (0.25, 3600.0, None))
NAMED = PHOTOS.replace("v.user_id AS usr", "concat('IMG_', CAST(e.vec_id AS STRING)) AS name, CASE WHEN e.vec_id % 3 = 0 THEN 'vertical' ELSE 'horizontal' END AS shape, concat('f', CAST(e.label AS STRING)) AS folder")


@query("c01_first_fit_clusters", NAMED)
def c01(df):
    return islands.first_fit_clusters(df, "grp", LOW_RULES)


@query("c01_time_islands", "SELECT user_id AS usr, event_id AS id, ts, CAST(NULL AS DOUBLE) AS seq FROM events", """SELECT usr, min(id) AS first_id, count(*) AS size FROM (SELECT *, sum(cut) OVER (PARTITION BY usr ORDER BY ts, id) AS island FROM
 (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY usr ORDER BY ts, id), ts) <= 3600001000 THEN 0 ELSE 1 END AS cut FROM {source} AS s) AS t) AS u GROUP BY usr, island""")
def c01_islands(df):
    """The islands of C01 by time alone: where a user's events are more than an hour (and the margin) apart."""
    return islands.with_islands(df, "usr", 3600.0, 0).groupBy("usr", "island").agg(F.min("id").alias("first_id"), F.count("*").alias("size")).drop("island")


@query("c02_best_fit_clusters", NAMED)
def c02(df):
    return clustering.best_fit_clusters(df, "grp")


@query("c03_people", NAMED)
def c03(df):
    return clustering.people(df, "grp", 0.30)


@query("snap_run", NAMED)
def snap_run(df):
    """The snap pipeline: cluster, represent by focus, score representatives, bucket."""
    from ..functions import vectors
    from ..operators import ranking

    clusters = islands.first_fit_clusters(df, "grp", LOW_RULES)
    rows = df.join(clusters, ["grp", "id"])
    reps = rows.groupBy("grp", "cluster").agg(F.max_by(F.struct("id", "focus", "emb", "seq"), F.struct("focus", -c("pos"))).alias("r"), F.count("*").alias("size"))
    reps = reps.select("grp", "cluster", "size", "r.*")
    centers = vectors.centroids(reps, ["grp"])
    reps = reps.join(relational.small(centers), "grp").withColumn("rare", 1 - vectors.cosine(c("emb"), c("centroid")))
    n = {x: scores.between_extremes(c(x), ["grp"]) for x in ("focus", "seq", "rare")}
    scored = reps.withColumn("score", F.round(scores.snap_score(n["focus"], n["seq"], n["focus"], n["rare"]), 9))
    return ranking.buckets(scored, ["grp"], "score", "id").select("grp", "cluster", "size", "id", F.round("score", 6).alias("score"), "rank", "bucket")


CHOICES = EVALS.replace("AS path, CAST(o_orderkey % 10", "AS path, CASE o_orderkey % 5 WHEN 0 THEN 'landmark, group shot' WHEN 1 THEN 'athlete oath' WHEN 2 THEN 'lunch' ELSE o_orderpriority END AS tags, concat('p', CAST(o_orderkey % 300 AS STRING)) AS person_signature, o_orderkey % 2 = 0 AS face_visible, o_orderkey % 6 = 0 AS landmark_visible, o_orderkey % 9 = 0 AS cheering_shot, o_orderkey % 10 = 0 AS ball_visible, CAST(o_orderkey % 10").replace(
    "CAST(o_custkey % 40 AS STRING) AS folder", "concat(CASE o_custkey % 4 WHEN 0 THEN 'sports_festival ' WHEN 1 THEN 'school trip ' WHEN 2 THEN 'marathon ' ELSE 'day ' END, CAST(o_custkey % 40 AS STRING)) AS folder"
)


@query("c05_quota_selection", CHOICES)
def c05(df):
    total = c("technical") + c("expression") / 10
    return selection.select(df.withColumn("total", total).withColumnRenamed("burst", "has_burst"))


WORDS = "SELECT l_suppkey AS page, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_orderkey % 700 + l_tax * 10 AS DOUBLE) AS y0, CAST(l_partkey % 500 + 20 AS DOUBLE) AS x1, CAST(l_orderkey % 700 + l_tax * 10 + 8 AS DOUBLE) AS y1, concat('w', CAST(l_partkey AS STRING)) AS text FROM lineitem"


@query("c06_page_rows", WORDS)
def c06(df):
    """H01, H02, C06, F17, X22 and X23."""
    return clustering.page_rows(df)


STAFF = "SELECT s_nationkey AS school, s_suppkey AS pos, s_name AS teacher_name, '' AS surname, '' AS given_name, CASE s_suppkey % 4 WHEN 0 THEN '数学' WHEN 1 THEN '国' WHEN 2 THEN '英語①' ELSE '' END AS subject, CASE WHEN s_suppkey % 9 = 0 THEN '教頭' ELSE '' END AS tag, s_acctbal / 10000 AS confidence, CASE s_suppkey % 3 WHEN 0 THEN 'timetable' WHEN 1 THEN 'roster' ELSE 'previous_layout' END AS source_type, '' AS notes, concat('f', CAST(s_suppkey % 3 AS STRING)) AS file, CAST(s_suppkey % 7 AS INT) AS page FROM supplier"


def _records(df):
    df = df.withColumn("subjects", F.array("subject")).withColumn("role_tags", F.array("tag")).withColumn("classes_or_grades", F.array(F.lit("3")))
    return df


@query("x21_prepared_records", STAFF, "SELECT pos, school, CASE pos % 4 WHEN 0 THEN '数学' WHEN 1 THEN '国語' WHEN 2 THEN '英語' ELSE '' END AS first_subject, pos % 9 = 0 AS office FROM {source} AS s")
def x21(df):
    rows = staff.prepared_records(_records(df)).join(df.select("pos", "school"), "pos")
    others = F.filter("subjects", lambda s: s != "教頭")
    return rows.select("pos", "school", F.coalesce(F.try_element_at(others, F.lit(1)), F.lit("")).alias("first_subject"), F.array_contains("subjects", "教頭").alias("office"))


@query("f18_named_records", STAFF.replace("s_name AS teacher_name", "CASE s_suppkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE s_name END AS teacher_name"), "SELECT pos FROM {source} AS s WHERE pos % 5 > 1")
def f18(df):
    """records without a name go."""
    return staff.prepared_records(_records(df)).select("pos")


@query("f16_new_people", STAFF.replace("s_name AS teacher_name", "substr(md5(CAST(s_suppkey AS STRING)), 1, 12) AS teacher_name").replace("'' AS notes", "CASE WHEN s_suppkey % 4 = 1 THEN '氏名は不鮮明' ELSE '' END AS notes").replace("CASE s_suppkey % 3 WHEN 0 THEN 'timetable' WHEN 1 THEN 'roster' ELSE 'previous_layout' END", "'timetable'"), "SELECT school, teacher_name FROM {source} AS s WHERE confidence >= 0.9 AND pos % 4 <> 1")
def f16(df):
    """F16: of a timetable without a roster, records that are sure and in no doubt become people."""
    rows = staff.prepared_records(_records(df)).join(df.select("pos", "school"), "pos")
    return staff.staff_master(rows, "school").select("school", "teacher_name")


@query("h26_fitted_plates", "SELECT p_partkey AS id, CAST(p_size * 10 AS DOUBLE) AS image_w, p_retailprice AS image_h, CAST(100 + p_partkey % 50 AS DOUBLE) AS scale FROM part", "SELECT id, round(w * scale / 100, 4) AS w, round(h * scale / 100, 4) AS h, round((36 - w * scale / 100) / 2 + 1.5, 4) AS x, round((44 - h * scale / 100) / 2 - 2, 4) AS y FROM (SELECT *, CASE WHEN image_w / image_h > 36.0 / 44 THEN 44 * image_w / image_h ELSE 36.0 END AS w, CASE WHEN image_w / image_h > 36.0 / 44 THEN 44.0 ELSE 36 / (image_w / image_h) END AS h FROM {source} AS s) AS t")
def h26(df):
    """Pictures that fill a frame, scaled around its centre and shifted."""
    fit = tables.fitted(c("image_w"), c("image_h"), F.lit(36.0), F.lit(44.0), c("scale"), F.lit(1.5), F.lit(-2.0))
    return df.select("id", *[scores.rounded_away(fit[n], 4).alias(n) for n in ("w", "h", "x", "y")])


@query("c04_staff_master", STAFF)
def c04(df):
    rows = staff.prepared_records(_records(df)).join(df.select("pos", "school"), "pos")
    return staff.staff_master(rows, "school")


@query("k11_staff_by_subject", STAFF)
def k11(df):
    return staff.staff_by_subject(staff.prepared_records(_records(df)))


CARD_ROWS = "SELECT c_nationkey AS school, c_custkey AS card_id, concat('Supplier', substr(c_name, 9)) AS name, CASE c_custkey % 3 WHEN 0 THEN '数' WHEN 1 THEN '国語' ELSE '' END AS subject, c_acctbal / 10000 AS confidence FROM customer"


@query_of("j04_card_matches", {"cards": CARD_ROWS, "people": STAFF})
def j04(cards, people):
    """J04 with X14 to X18."""
    people = people.select("school", c("pos").alias("staff_pos"), c("teacher_name").alias("name"), F.array("subject").alias("subjects"), c("tag").alias("role"))
    return staff.matched_cards(cards, people, "school")


@query_of("x14_similar_names", {"cards": CARD_ROWS, "people": STAFF})
def x14_similar(cards, people):
    """All pairs of a card's and a person's name key of one school with a matching ratio of at least 0.9."""
    keyed = [df.select(c("school").cast("string").alias("school"), names.name_key(c(n)).alias("key")) for df, n in ((cards, "name"), (people, "teacher_name"))]
    return fuzzy.similar_keys(*keyed, 0.9).select("school", "a", "b", F.round("similarity", 6).alias("similarity"))


@query("x14_name_similarity", "SELECT s_suppkey AS a, s_name AS x, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b, lead(s_name) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS y FROM supplier")
def x14(df):
    """X13, X14 and X16 with composition and sequence matching, of each supplier and the next one of its nation."""
    return df.select("a", "b", names.name_key(c("x")).alias("key"), F.round(names.name_similarity(c("x"), c("y")), 6).alias("similarity"), F.round(names.surname_similarity(c("x"), c("y")), 6).alias("surname"))


@query("x27_repaired_json", "SELECT event_id AS id, substr(concat('{\"rows\": [', props, ', ', props, '], \"n\": 1}'), 1, CAST(12 + event_id % 30 AS INT)) AS raw FROM events")
def x27(df):
    return df.select("id", names.repaired_json(c("raw")).alias("whole"))


GUIDES = "SELECT p_brand AS page, round(p_retailprice / 7, 1) AS y FROM part"
ALL_FRAMES = "SELECT p_brand AS page, p_partkey AS frame, round(p_retailprice / 7, 1) AS top, round(p_retailprice / 7, 1) + 44 AS bottom, CAST(p_partkey % 5 * 40 + p_size / 10.0 AS DOUBLE) AS left FROM part"
#: A share of them, to stand among guides.
FRAMES = f"{ALL_FRAMES} WHERE p_partkey % 5 = 0"


@query("o10_reading_order", ALL_FRAMES)
def o10(df):
    return clustering.reading_order(df, "page")


@query("o11_thinned_guides", GUIDES)
def o11(df):
    return clustering.thinned_guides(df, "page", "y")


@query("a28_modal_values", GUIDES)
def a28(df):
    return clustering.modal_values(df, "page", "y")


@query_of("p22_guide_ratios", {"frames": ALL_FRAMES, "guides": GUIDES})
def p22(frames, guides):
    """J12, A28 and P22."""
    return geometry.guide_ratios(frames, guides, geometry.canonical_offsets(frames, guides, "page"), "page")


@query_of("p23_own_guides", {"frames": FRAMES, "guides": GUIDES})
def p23(frames, guides):
    return geometry.own_guides(guides, frames, geometry.canonical_offsets(frames, guides, "page"), "page")


ENTRIES = "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'student' WHEN 1 THEN 'teacher' ELSE 'guest' END AS role, 800.0 AS image_w, 1000.0 AS image_h, 0.5 AS center_x, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 0.5 + (event_id % 30) / 93.7177 END AS chin_y, 0.1 + (event_id % 20) / 97.3 AS eye_dist FROM events"


@query("p20_manifest_offsets", ENTRIES, "SELECT id, CASE WHEN id % 3 = 2 THEN 'no_frame' WHEN id % 7 = 0 THEN 'no_face' WHEN id % 3 = 1 THEN 'default_guides' ELSE 'guides' END AS method, CASE WHEN id % 3 = 2 OR id % 7 = 0 THEN 127.0 END AS fallback_scale FROM {source} AS s")
def p20(df):
    roles = df.sparkSession.createDataFrame([("student", 36.0, 44.0, 0.2, 0.86), ("teacher", 46.0, 54.0, None, None)], "role string, frame_w double, frame_h double, top_ratio double, bottom_ratio double")
    out = geometry.manifest_offsets(df, roles)
    return out.select("id", "method", F.when(c("method").isin("no_frame", "no_face"), c("scale")).alias("fallback_scale"))


# --- review flow ---

GROUPS = "SELECT CAST(o_custkey % 30 AS STRING) AS class_id, CAST(row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey) AS INT) AS group_idx, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 200 AS INT) END AS student_number, concat('p', CAST(o_orderkey AS STRING), '.jpg') AS path FROM orders"


def _groups(df):
    return df.select("class_id", "group_idx", "student_number", F.array("path").alias("paths"))


def _errors(df):
    return review.detected_errors(_groups(df), df.where("student_number % 17 = 0").select("path"))


@query("a18_error_queue", GROUPS, """SELECT error_type, class_id, student_number, n FROM (SELECT 'duplicate_number' AS error_type, class_id, student_number, count(*) AS n FROM {source} AS a WHERE student_number IS NOT NULL AND student_number % 17 <> 0 GROUP BY class_id, student_number HAVING count(*) > 1
 UNION ALL SELECT 'missing_tag_shot', class_id, NULL, 1 FROM {source} AS b WHERE student_number IS NULL) AS t""")
def a18(df):
    """A13, A16 and A18."""
    return _errors(df).select("error_type", "class_id", "student_number", F.size("group_keys").cast("long").alias("n"))


@query("c11_exportable", GROUPS, "SELECT class_id, group_idx FROM (SELECT *, count(*) OVER (PARTITION BY class_id, student_number) AS n FROM {source} AS s WHERE student_number IS NOT NULL) AS t WHERE n = 1 OR student_number % 17 = 0")
def c11(df):
    return review.exportable(_groups(df), _errors(df)).select("class_id", "group_idx")


@query("k15_error_files", GROUPS, "SELECT error_type, path, class_id || '__' || path AS file FROM (SELECT 'missing_tag_shot' AS error_type, class_id, path FROM {source} AS b WHERE student_number IS NULL UNION ALL SELECT 'duplicate_number', class_id, path FROM (SELECT *, count(*) OVER (PARTITION BY class_id, student_number) AS n FROM {source} AS s WHERE student_number IS NOT NULL AND student_number % 17 <> 0) AS t WHERE n > 1) AS u")
def k15(df):
    return review.error_files(_errors(df))


@query("k17_error_sheet", GROUPS)
def k17(df):
    return review.error_sheet(_errors(df))


@query("c12_c10_resolved_groups", GROUPS)
def c10(df):
    """Every missing number of an even group is entered by hand, then applied."""
    groups = df.select("class_id", "group_idx", "student_number", F.array().cast("array<string>").alias("cards"), F.array("path").alias("portraits"))
    errors = _errors(df).where("error_type = 'missing_tag_shot' and group_idx % 2 = 0")
    log = review.manual_number(errors, c("group_idx") + 1000).withColumn("seq", F.monotonically_increasing_id())
    return review.apply_resolutions(groups, log).select("class_id", "group_idx", "student_number", F.size("cards").alias("cards"), F.size("portraits").alias("portraits"))


ORACLES["c12_c10_resolved_groups"] = f"SELECT class_id, group_idx, CASE WHEN student_number IS NULL AND group_idx % 2 = 0 THEN group_idx + 1000 ELSE student_number END AS student_number, CASE WHEN student_number IS NULL AND group_idx % 2 = 0 THEN 1 ELSE 0 END AS cards, CASE WHEN student_number IS NULL AND group_idx % 2 = 0 THEN 0 ELSE 1 END AS portraits FROM ({GROUPS}) AS s"
LOG = "SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_suppkey % 2 = 0 THEN concat('e', CAST(l_partkey AS STRING)) END AS error_id, 'missing_tag_shot' AS error_type, concat('p', CAST(l_partkey AS STRING)) AS image_path, CAST(NULL AS STRING) AS group_key, CAST(l_suppkey AS STRING) AS class_id, l_returnflag AS status FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber) AS x"


@query("c09_latest_resolutions", LOG, "SELECT seq, error_id, image_path, status FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s0 DESC) AS n, min(s0) OVER (PARTITION BY k) AS seq FROM (SELECT seq AS s0, error_id, image_path, status, CASE WHEN error_id IS NULL THEN image_path || '#' || class_id ELSE error_id END AS k FROM {source} AS a) AS b) AS t WHERE n = 1")
def c09(df):
    return review.latest(df).select("seq", "error_id", "image_path", "status")


PICTURES = "SELECT CAST(o_custkey % 30 AS STRING) AS class_id, CAST(o_orderkey % 40 AS INT) AS student_number, concat('IMG_', CAST(o_orderkey AS STRING), '.jpg') AS path, o_totalprice AS score, o_orderkey % 6 = 0 AS is_ng, o_orderkey AS pos FROM orders"
PUPILS = "SELECT CAST(c_nationkey AS STRING) AS class_id, CAST(c_custkey % 45 AS INT) AS number, c_name AS name FROM customer"


@query_of("k13_manifest", {"portraits": PICTURES, "roster": PUPILS}, "SELECT class_id, count(*) AS students, count(*) FILTER (WHERE NOT present) AS absent FROM (SELECT class_id, number, max(p) = 1 AS present FROM (SELECT class_id, student_number AS number, 1 AS p FROM {portraits} AS a UNION ALL SELECT class_id, number, 0 FROM {roster} AS b) AS t GROUP BY class_id, number) AS u GROUP BY class_id")
def k13(portraits, roster):
    """K13, K14, W07, J08 and U02; the entries themselves are in review.manifest()."""
    return review.manifest(portraits, roster, "2025", "North").select("class_id", "students", "absent")


@query_of("j14_card_owners", {"cards": "SELECT user_id AS folder, event_id AS idx, CAST(event_id % 50 AS INT) AS number FROM events WHERE event_type = 'click'", "groups": "SELECT user_id AS folder, event_id AS place FROM events WHERE event_type = 'view'"}, """WITH near AS (SELECT k.folder, k.idx, k.number, g.group_id, abs(g.place - k.idx) AS d, row_number() OVER (PARTITION BY k.folder, k.idx ORDER BY abs(g.place - k.idx) NULLS LAST, g.group_id) AS r
 FROM {cards} AS k LEFT JOIN (SELECT folder, place, CAST(floor(place / 500) AS BIGINT) AS group_id FROM {groups} AS g0) AS g ON g.folder = k.folder AND abs(g.place - k.idx) <= 120)
 SELECT folder, idx, CASE WHEN row_number() OVER (PARTITION BY folder, group_id ORDER BY idx) = 1 THEN group_id END AS group_id, number FROM near WHERE r = 1""")
def j14(cards, groups):
    """J13 and J14 in their order."""
    groups = groups.withColumn("group_id", F.floor(c("place") / 500)).groupBy("folder", "group_id").agg(F.collect_list("place").alias("places"))
    return review.card_owner(cards, groups, 120)


# --- sources ---

LISTED = "SELECT concat('/in/', CASE event_id % 4 WHEN 0 THEN '3A/' WHEN 1 THEN 'event b/3B/' WHEN 2 THEN '' ELSE 'x/y/' END, 'IMG_', CAST(event_id % 700 AS STRING), CASE event_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.txt' END) AS path, ts AS modified, event_id AS size FROM events"
KEPT = "(SELECT *, substr(path, 5) AS rel FROM {source} AS s0 WHERE NOT suffix(path, '.txt')) AS s"


def _listed(df):
    return files.described(df, "/in")


@query("s01_listing", LISTED, f"SELECT rel, len(string_split(rel, '/')) - 1 AS depth, CASE WHEN contains(rel, '/') THEN split_part(rel, '/', 1) END AS folder, size FROM {KEPT}")
def s01(df):
    """S01, S02, S05, S09 to S11."""
    return _listed(df).select("rel", "depth", "folder", "size")


@query("s03_flat_names", LISTED, f"SELECT size, replace(rel, '/', '_') AS flat FROM {KEPT}")
def s03(df):
    return files.flattened(_listed(df)).select("size", "flat")


#: Each picture in a folder of its own, so paths are unique; few names, so they repeat at every scale.
NUMBERED = LISTED.replace("'IMG_'", "CAST(event_id AS STRING), '/IMG_'").replace("event_id % 700", "event_id % 70")


@query("s08_collisions", NUMBERED, f"SELECT size, CASE WHEN n = 0 THEN nm ELSE regexp_replace(nm, '(\\.[^.]*)$', '_' || CAST(n AS STRING) || '\\1') END AS flat FROM (SELECT size, nm, row_number() OVER (PARTITION BY nm ORDER BY path) - 1 AS n FROM (SELECT *, regexp_extract(rel, '([^/]*)$', 1) AS nm FROM {KEPT}) AS a) AS b")
def s08(df):
    return files.without_collisions(_listed(df)).select("size", "flat")


@query("s12_class_folders", LISTED, f"SELECT size, '3A' AS class_id FROM {KEPT} WHERE split_part(rel, '/', 1) = '3A'")
def s12(df):
    return files.class_folders(_listed(df)).select("size", "class_id")


@query("s31_catalog", LISTED, f"SELECT rel, CASE WHEN len(string_split(rel, '/')) >= 3 THEN split_part(rel, '/', 2) END AS bucket, CASE WHEN suffix(lower(rel), '.jpg') THEN 'image/jpeg' ELSE 'image/png' END AS media_type FROM {KEPT}")
def s31(df):
    """S31, S32 and P27."""
    return files.catalog(_listed(df)).select("rel", "bucket", "media_type")


@query("multi_event_split", LISTED, f"SELECT size, 'event_' || CAST(dense_rank() OVER (ORDER BY CASE WHEN contains(rel, '/') THEN split_part(rel, '/', 1) ELSE '' END) AS STRING) AS event_id FROM {KEPT}")
def multi_event(df):
    return files.events_of(_listed(df)).select("size", "event_id")


@query("f28_safe_paths", "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '/abs/a.jpg' WHEN 1 THEN 'a/../b.jpg' WHEN 2 THEN 'a/b.jpg' ELSE 'a/b.exe' END AS path FROM events", "SELECT id, id % 4 = 2 AS safe FROM {source} AS s")
def f28(df):
    return df.select("id", files.safe_relative(c("path")).alias("safe"))


CELLS = """SELECT concat('s', CAST(c_nationkey AS STRING)) AS sheet, CAST(1 AS INT) AS row, CAST(1 AS INT) AS col, concat('HR', CAST(c_nationkey AS STRING)) AS value FROM customer GROUP BY c_nationkey
 UNION ALL SELECT concat('s', CAST(c_nationkey AS STRING)), CAST(c_custkey + 1 AS INT), CAST(1 AS INT), CAST(c_custkey % 40 AS STRING) FROM customer
 UNION ALL SELECT concat('s', CAST(c_nationkey AS STRING)), CAST(c_custkey + 1 AS INT), CAST(2 AS INT), c_name FROM customer"""


@query("s25_roster_format_a", CELLS, "SELECT class, number, name FROM (SELECT substr(a.sheet, 2) AS class, CAST(a.value AS INT) AS number, b.value AS name, row_number() OVER (PARTITION BY a.sheet, a.value ORDER BY a.row) AS n FROM {source} AS a JOIN {source} AS b ON a.sheet = b.sheet AND a.row = b.row AND a.col = 1 AND b.col = 2 WHERE a.row > 1) AS t WHERE n = 1")
def s25(df):
    return rosters.format_a(df).select("class", "number", "name")


@query("s23_sniffed", CELLS, "SELECT DISTINCT sheet, 'A' AS format FROM {source} AS s")
def s23(df):
    return rosters.sniffed(df)


ANSWERS = "SELECT event_id AS page, concat('{\"class\": \"', CAST(user_id AS STRING), '\", \"students\": [{\"number\": ', CAST(event_id % 30 AS STRING), ', \"name\": \"n', CAST(event_id AS STRING), '\"}]}') AS raw, user_id AS usr FROM events"


@query("s27_roster_answers", ANSWERS, "SELECT class, number, name FROM (SELECT CAST(usr AS STRING) AS class, CAST(page % 30 AS INT) AS number, 'n' || CAST(page AS STRING) AS name, row_number() OVER (PARTITION BY usr, page % 30 ORDER BY page) AS n FROM {source} AS s) AS t WHERE n = 1")
def s27(df):
    return rosters.from_answers(df).select("class", "number", "name")


# --- models ---

READ = "SELECT event_id AS id, concat('{\"has_card\": \"', CASE WHEN event_id % 5 = 0 THEN 'no' ELSE 'yes' END, '\", \"label\": \"', CASE WHEN event_id % 3 = 0 THEN 'A' ELSE '?' END, CAST(event_id % 40 AS STRING), '\"}') AS answer FROM events"


@query("m12_card_reading", READ, "SELECT id, id % 3 = 0 AND id % 5 <> 0 AS accepted, CASE WHEN id % 5 = 0 THEN 'no clear card visible' WHEN id % 3 <> 0 THEN 'invalid_or_uncertain_label' ELSE '' END AS reason FROM {source} AS s")
def m12(df):
    """M12 to M14 over answers that a provider gave."""
    return df.select("id", providers.card_reading(c("answer"), F.lit("3")).alias("x")).select("id", "x.accepted", "x.reason")


@query("m01_evaluation", "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'sorry' ELSE concat('{\"technical\": ', CAST(event_id % 10 AS STRING), ', \"is_ng\": \"', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END, '\", \"ng_reason\": \"', CASE WHEN event_id % 6 = 0 THEN 'eyes closed' ELSE 'dark' END, '\"}') END AS answer FROM events", "SELECT id, CASE WHEN id % 4 = 0 THEN true ELSE id % 3 = 0 AND id % 6 <> 0 END AS is_ng, CASE WHEN id % 4 = 0 THEN 0.0 ELSE CAST(id % 10 AS DOUBLE) END AS technical FROM {source} AS s")
def m01(df):
    """M01 and F08."""
    return df.select("id", providers.evaluation(c("answer")).alias("e")).select("id", "e.is_ng", "e.technical")


@query("m02_provider_calls", "SELECT event_id AS id, event_type AS kind, user_id AS usr FROM events")
def m02(df):
    """M02, M16 and H14 with a provider that is a function; every event is asked about."""
    def answer(text: str) -> str:
        return '{"technical": %d}' % (len(text) % 10)

    request = providers.prompt(c("kind"), F.lit("3"), c("usr").cast("string"))
    rows = providers.asked(df, request, providers.FunctionProvider(answer))
    return rows.select("id", X.json_object(c("answer"), "technical double", "technical")["technical"].alias("technical"))


@query("m02_stored_answers", "SELECT event_id AS id, event_type AS kind, user_id AS usr FROM events", "SELECT id, concat(kind, '-', CAST(usr AS STRING)) AS answer FROM {source} AS s")
def m02_stored(df):
    """Each distinct request is sent once, over two runs of which the second has all requests."""
    store = answers.AnswerStore(df.sparkSession, f"{shared_folder(df.sparkSession)}/answers", "plain")
    request, provider = F.concat_ws("-", "kind", "usr"), providers.FunctionProvider(lambda text: text)
    store.ask(df.where("usr % 2 = 0"), request, provider)
    return store.ask(df, request, provider).select("id", "answer")


FACES = "SELECT event_id AS id, CAST(20 + event_id % 50 AS INT) AS width, CAST(25 + event_id % 40 AS INT) AS height FROM events"
EYES_SQL = "SELECT id, least(width, height) >= {least} AND id % 7 <> 0 AS clear, least(width, height) >= {least} AND id % 7 <> 0 AND id % 3 = 0 AS closed, CASE WHEN least(width, height) < {least} OR id % 7 = 0 THEN 'low' WHEN id % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM {source} AS s"


def _eyes(text: str) -> str | None:
    n = int(text)
    if n % 7 == 0:
        raise ValueError(text)
    return '{"has_clear_face": true, "eyes_closed": %s%s}' % ("true" if n % 3 == 0 else "false", ', "confidence": "high"' if n % 2 == 0 else "")


@query("m04_eye_judgements", FACES, EYES_SQL.replace("{least}", "30"))
def m04(df):
    rows = providers.judged_eyes(df, c("id").cast("string"), providers.FunctionProvider(_eyes))
    return rows.select("id", c("eyes.has_clear_face").alias("clear"), c("eyes.eyes_closed").alias("closed"), c("eyes.confidence").alias("confidence"))


@query("m05_notebook_eyes", FACES, EYES_SQL.replace("{least}", "40"))
def m05(df):
    rows = providers.judged_eyes(df, c("id").cast("string"), providers.FunctionProvider(_eyes), providers.LEAST_NOTEBOOK_FACE, 2)
    return rows.select("id", c("eyes.has_clear_face").alias("clear"), c("eyes.eyes_closed").alias("closed"), c("eyes.confidence").alias("confidence"))


def _boundary(text: str) -> str | None:
    n = int(text.split()[1])
    if n % 5 == 0:
        raise ValueError(text)
    return '{"same_group": %s, "confidence": "%s"}' % ("false" if n % 3 == 0 else "true", "Low" if n % 2 == 0 else "high")


@query("m06_adjacent_groups", "SELECT user_id AS usr, event_id AS id FROM events", "SELECT id, CAST(sum(CASE WHEN n > 1 AND id % 5 <> 0 AND id % 3 = 0 AND id % 2 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY usr ORDER BY id) AS INT) AS grp FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY id) AS n FROM {source} AS a) AS t")
def m06(df):
    rows = providers.adjacent_groups(df, "usr", "id", "id", lambda a, b: F.concat_ws(" ", a, b), providers.FunctionProvider(_boundary))
    return rows.select("id", c("group").alias("grp"))


@query_of("m11_extracted_staff", {"rows": "SELECT concat('f', CAST(s_nationkey AS STRING)) AS file, 1 AS page, s_suppkey AS row FROM supplier WHERE s_nationkey % 2 = 0", "records": STAFF.replace("concat('f', CAST(s_suppkey % 3 AS STRING)) AS file", "concat('f', CAST(s_nationkey AS STRING)) AS file")})
def m11_staff(rows, records):
    """Files of even nations have text rows, and the records of the picture way carry a note."""
    return staff.extracted_staff(rows, _records(records), _records(records).withColumn("notes", F.lit("picture")))


@query("e07_pixel_features", "SELECT p_partkey AS id, 12 AS height, 12 AS width, p_size AS k FROM part")
def e07(df):
    """E01 to E05, E07 and E13 over small synthetic pictures."""
    ramp = F.transform(F.sequence(F.lit(0), F.lit(431)), lambda i: F.lpad(F.hex(F.pmod(i * c("k"), F.lit(256))), 2, "0"))
    return providers.photo_features(df.withColumn("rgb", F.unhex(F.array_join(ramp, ""))))


CARD_PICTURES = "SELECT p_partkey AS id, CAST(5 + p_partkey % 40 AS INT) AS x, CAST(p_partkey % 5 * 8 + 8 AS INT) AS y, CAST(20 + p_partkey % 7 * 5 AS INT) AS w FROM part"


@query("e15_card_boxes", CARD_PICTURES, "SELECT id, y >= 24 AND x >= 8 AND x + w <= 112 AS found, CASE WHEN y >= 24 AND x >= 8 AND x + w <= 112 THEN greatest(0, x - 12) END AS x1, CASE WHEN y >= 24 AND x >= 8 AND x + w <= 112 THEN y - 12 END AS y1, CASE WHEN y >= 24 AND x >= 8 AND x + w <= 112 THEN least(120, x + w + 12) END AS x2, CASE WHEN y >= 24 AND x >= 8 AND x + w <= 112 THEN least(80, y + 28) END AS y2 FROM {source} AS s")
def e15(df):
    """A white card of 16 rows on each of many dark pictures of 120 by 80, some too high or so near the side that white reaches it."""
    white = lambda n: F.repeat(F.lit("FF"), (n * 3).cast("int"))
    dark = lambda n: F.repeat(F.lit("14"), (n * 3).cast("int"))
    line = F.concat(dark(c("x")), white(c("w")), dark(120 - c("x") - c("w")))
    rgb = F.unhex(F.concat(dark(120 * c("y")), F.repeat(line, 16), dark(120 * (64 - c("y")))))
    # Rows of a few bytes become pictures of many, so they are dealt to all tasks before.
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    pictures = dealt.select("id", F.lit(80).alias("height"), F.lit(120).alias("width"), rgb.alias("rgb"))
    return pixels.cards(pictures, placard=False)


# --- streams ---


def stream_counts(spark: SparkSession, sf_dir: str):
    """Windowed counts of a stream that is driven to its end, with a watermark; a log keeps the latest count of each window."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = incremental.windowed_counts(stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind")), window="1 day")
    root = shared_folder(spark)
    log = Log(spark, f"{root}/counts", "start timestamp, kind string, n long", ["start", "kind"], ["n"])
    counts.writeStream.outputMode("update").foreachBatch(log.write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return log.read().select(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind", "n")


QUERIES["stream_windowed_counts"] = stream_counts
ORACLES["stream_windowed_counts"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2"


def stream_people(spark: SparkSession, sf_dir: str):
    """C03 with its state kept between batches."""
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "embeddings.parquet").parquet(sf_dir)
    faces = stream.select(c("label").alias("folder"), c("vec_id").alias("id"), c("vec_id").alias("name"), c("embedding").alias("emb"))
    root = shared_folder(spark)
    found = incremental.recognised(faces, 0.30)
    found.writeStream.format("parquet").option("path", f"{root}/people").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/people")


QUERIES["stream_people"] = stream_people


def stream_numbers(spark: SparkSession, sf_dir: str):
    """The last number shown before each event of a user, kept as state."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    number = F.when(c("event_id") % 3 == 0, c("event_id") % 100)
    found = people.previous_numbers(stream.select(c("user_id").alias("folder"), c("event_id").alias("id"), c("event_id").alias("pos"), number.alias("number")))
    root = shared_folder(spark)
    found.writeStream.format("parquet").option("path", f"{root}/numbers").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/numbers").select("folder", "id", "previous")


QUERIES["c08_stream_numbers"] = stream_numbers
ORACLES["c08_stream_numbers"] = "SELECT user_id AS folder, event_id AS id, last_value(CASE WHEN event_id % 3 = 0 THEN event_id % 100 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events"


@query("c09_merged_log", "SELECT o_custkey % 400 AS error_id, o_orderkey AS seq, o_orderstatus AS status FROM orders", "SELECT error_id, seq, status FROM (SELECT *, row_number() OVER (PARTITION BY error_id ORDER BY seq % 7 DESC, seq DESC) AS n FROM {source} AS s) AS t WHERE n = 1")
def c09_log(df):
    """Resolutions arrive in seven batches, each twice; the log keeps the latest row of each error."""
    log = Log(df.sparkSession, f"{shared_folder(df.sparkSession)}/log", "error_id long, seq long, status string", ["error_id"], ["seq"], parts=3)
    for number in range(7):
        batch = df.where(c("seq") % 7 == number)
        log.write(batch, number)
        log.write(batch.withColumn("status", F.lit("repeated")), number)
    return log.read()


@query("s01_streamed_arrivals", "SELECT p_partkey AS id, concat('a', CAST(p_partkey % 20 AS STRING)) AS archive, concat(p_type, '/', CAST(p_partkey AS STRING)) AS member, p_name AS name FROM part", "SELECT concat(archive, '.zip') AS file, count(*) AS members FROM {source} AS s GROUP BY archive")
def s01_arrivals(df):
    """S01 to S11 as a stream: archives arrive in two goes, the query is started again for the second."""
    spark, root = arrivals.registered(df.sparkSession), shared_folder(df.sparkSession)
    zip_source.registered(spark)
    packed = zips.archives(df.select("archive", "member", c("name").cast("binary").alias("content")))
    for go in (0, 1):
        written(zip_source.written_archives(packed.where(F.pmod(F.xxhash64("archive"), F.lit(2)) == go), f"{root}/in"), "archives")
        stream = spark.readStream.format("arrivals").option("journal", f"{root}/journal").option("suffixes", ".zip").load(f"{root}/in")
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema("path string, size long, modified timestamp").parquet(f"{root}/out").select(F.substring_index("path", "/", -1).alias("file"))
    inside = spark.read.format("zip").schema("archive string, member string").load(f"{root}/in").groupBy(F.substring_index("archive", "/", -1).alias("file")).agg(F.count("*").alias("members"))
    return told.join(inside, "file")


def teacher_run(spark: SparkSession, sf_dir: str):
    """The teacher pipeline: records to people, cards to people, final names, counts of each method."""
    people = staff.staff_master(staff.prepared_records(_records(inputs(spark, sf_dir, STAFF))).join(inputs(spark, sf_dir, STAFF).select("pos", "school"), "pos"), "school")
    listed = people.select("school", "staff_pos", c("teacher_name").alias("name"), "subjects", F.lit("").alias("role"))
    cards = inputs(spark, sf_dir, CARD_ROWS)
    found = staff.matched_cards(cards, listed, "school").join(cards.select("card_id", "name", "confidence"), "card_id")
    final = scores.final_name(c("method"), c("confidence"), c("staff_name"), c("name"))
    rows = found.select("card_id", "method", "score", final["name"].alias("final_name"), final["source"].alias("name_source"))
    # Cards without a name are not numbered: they are many, and are no group.
    named, rest = F.coalesce("final_name", F.lit("")) != "", F.coalesce("final_name", F.lit("")) == ""
    numbers = F.row_number().over(Window.partitionBy("final_name").orderBy("card_id"))
    return rows.where(named).withColumn("number", numbers).unionByName(rows.where(rest).withColumn("number", F.lit(None).cast("int")))


QUERIES["teacher_run"] = teacher_run
