"""Scalar functions as queries: each over strings that are derived from driver tables, with the same rule in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import tables
from .registry import query

PATHS = """SELECT event_id AS id, user_id, ts, value, concat('club', CAST(user_id % 7 AS STRING), '/IMG', CASE WHEN event_id % 3 = 0
 THEN concat('_', CAST(event_id AS STRING), '_x') WHEN event_id % 3 = 1 THEN concat('-', CAST(user_id AS STRING), '-', CAST(event_id % 97 AS STRING))
 ELSE '' END, CASE WHEN event_id % 5 = 0 THEN '.PNG' WHEN event_id % 5 = 1 THEN '.webp' WHEN event_id % 5 = 2 THEN '.txt' ELSE '.jpg' END) AS path FROM events"""
NAMES = """SELECT c_custkey AS id, concat(CASE WHEN c_custkey % 6 = 0 THEN '教諭 ' WHEN c_custkey % 6 = 1 THEN ' ' ELSE '' END,
 CASE c_custkey % 5 WHEN 0 THEN '齋藤' WHEN 1 THEN '髙橋' WHEN 2 THEN 'フクダ' WHEN 3 THEN '渡邊' ELSE '安' END,
 CASE c_custkey % 4 WHEN 0 THEN '　' WHEN 1 THEN '  ' WHEN 2 THEN '' ELSE ' ' END, CASE c_custkey % 3 WHEN 0 THEN '一郎' WHEN 1 THEN 'ハナコ(はなこ)' ELSE '' END,
 CASE c_custkey % 7 WHEN 0 THEN ' 先生' WHEN 1 THEN '：' WHEN 2 THEN '（仮）' WHEN 3 THEN '不明' ELSE '' END) AS name FROM customer"""
SUBJECTS = """SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN '数学2' WHEN 1 THEN ' 国 ' WHEN 2 THEN '英語①' WHEN 3 THEN '保体' WHEN 4 THEN '校長先生' WHEN 5 THEN '社会'
 WHEN 6 THEN '音' WHEN 7 THEN '理科１' WHEN 8 THEN '情報' WHEN 9 THEN p_brand WHEN 10 THEN '' ELSE '　美 術' END AS subject FROM part"""
LABELS = """SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 7 WHEN 0 THEN concat(' ', chr(CAST(65 + l_partkey % 8 AS INT)), CAST(l_suppkey AS STRING)) WHEN 1 THEN concat('ａ', CAST(l_suppkey % 40 AS STRING))
 WHEN 2 THEN 'Ｈ３２' WHEN 3 THEN concat('d-', CAST(l_suppkey AS STRING)) WHEN 4 THEN CAST(l_suppkey AS STRING) WHEN 5 THEN '3A32' ELSE 'A1.5' END AS label FROM lineitem WHERE l_linenumber < 8"""
CLASSES = """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN concat(CAST(c_custkey % 6 AS STRING), '-', CAST(c_nationkey AS STRING)) WHEN 1 THEN concat(CAST(c_custkey % 3 + 1 AS STRING), '年A組')
 WHEN 2 THEN 'B' WHEN 3 THEN ' 2 年 3 組 ' ELSE CAST(c_nationkey AS STRING) END AS class_id FROM customer"""
TAGS = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN concat(o_orderpriority, ', Lunch ;', o_orderstatus) WHEN 1 THEN 'Train Ride|GROUP' WHEN 2 THEN ' ,;| ' WHEN 3 THEN 'landmark' WHEN 4 THEN NULL ELSE o_orderpriority END AS tags FROM orders"""
EVENTS = """SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'Sports' WHEN 1 THEN 'field-trip' WHEN 2 THEN '2024 体育祭' WHEN 3 THEN ' School Trip ' WHEN 4 THEN 'marathon final' WHEN 5 THEN 'Choir-day'
 WHEN 6 THEN '遠足' WHEN 7 THEN o_orderpriority ELSE 'off campus' END AS folder FROM orders"""
HINTS = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN concat('Class ', CAST(o_custkey % 12 AS STRING), ' and class ', CAST(o_custkey % 5 AS STRING)) WHEN 1 THEN '3組' WHEN 2 THEN o_orderpriority WHEN 3 THEN ' unknown' WHEN 4 THEN NULL ELSE 'grade-ab!' END AS hint FROM orders"""

STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"
SUFFIX = r"lower(regexp_extract(path, '[^/]\.([^./]*)$', 1))"
SPACED = r"trim(regexp_replace(replace(coalesce({0}, ''), '　', ' '), '\s+', ' ', 'g'))"


def sql_map(expression: str, values: dict[str, str]) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + " END"


def sql_translate(expression: str, pairs: dict[str, str]) -> str:
    return f"translate({expression}, '{''.join(pairs)}', '{''.join(pairs.values())}')"


def scalar(name: str, source: str, /, **columns: tuple[Callable[[], Column], str]) -> None:
    """One query that evaluates expressions per row, and the same expressions in SQL."""
    oracle = "SELECT id, " + ", ".join(f"{sql} AS {c}" for c, (_, sql) in columns.items()) + " FROM {source} AS s"
    query(name, source, oracle)(lambda df: df.select("id", *[make().alias(c) for c, (make, _) in columns.items()]))


c = F.col
scalar(
    "x01_numeric_tail", PATHS,
    stem=(lambda: X.stem_of(c("path")), STEM), tail=(lambda: X.numeric_tail(c("path")), f"TRY_CAST(regexp_extract_all({STEM}, '[0-9]+')[-1] AS BIGINT)"),
    suffix=(lambda: X.suffix_of(c("path")), SUFFIX), media=(lambda: X.media_type(c("path")), f"coalesce({sql_map(SUFFIX, tables.MEDIA_TYPES)}, 'application/octet-stream')"),
)
GAPS = "SELECT event_id AS id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t0, event_id AS s, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s0 FROM events"
scalar("x02_time_gap", GAPS, gap=(lambda: F.round(X.time_gap(c("ts"), c("t0")), 3), "round(abs(date_diff('microsecond', ts, t0)) / 1e6, 3)"))
scalar("x03_sequence_gap", GAPS, gap=(lambda: X.sequence_gap(c("s"), c("s0")), "abs(s - s0)"))
scalar("s18_shooting_date", GAPS, date=(lambda: X.shooting_date(c("t0")), "coalesce(strftime(t0, '%Y%m%d'), '00000000')"), text=(lambda: X.capture_text(c("t0")), "coalesce(strftime(t0, '%Y-%m-%d %H:%M:%S'), '')"))
CLEAN = rf"trim(regexp_replace(regexp_replace(regexp_replace({SPACED.format('name')}, '[：:]+$', ''), '^(教員|教諭|講師|先生)\s*', ''), '\s*先生$', ''))"
KEY = r"regexp_replace(regexp_replace(regexp_replace(coalesce(name, ''), '[：:]+$', ''), '^(教員|教諭|講師|先生)\s*', ''), '\s*先生$', '')"
KEY = rf"regexp_replace(regexp_replace(regexp_replace({KEY}, '[\s　]+', '', 'g'), '（[^）]*）', '', 'g'), '\([^)]*\)', '', 'g')"
KEY = sql_translate(sql_translate(KEY, tables.NAME_VARIANTS), dict(zip(X.KATAKANA, X.HIRAGANA, strict=True)))
KEY = f"trim(regexp_replace({KEY}, '{'|'.join(tables.NOISE_WORDS)}', '', 'g'))"
scalar("x08_one_spaced", NAMES, spaced=(lambda: X.one_spaced(c("name")), SPACED.format("name")))
scalar("x09_unspaced", NAMES, bare=(lambda: X.unspaced(c("name")), r"regexp_replace(coalesce(name, ''), '[\s　]+', '', 'g')"))
scalar("x10_clean_name", NAMES, clean=(lambda: X.clean_name(c("name")), CLEAN))
scalar("x12_hiragana", NAMES, kana=(lambda: X.hiragana(c("name")), sql_translate("name", dict(zip(X.KATAKANA, X.HIRAGANA, strict=True)))))
scalar("x13_name_key", NAMES, key=(lambda: X.name_key(c("name")), KEY))
NAME = "trim(name)"
scalar(
    "x15_surname", NAMES,
    surname=(lambda: X.surname_of(c("name")), rf"CASE WHEN regexp_extract({NAME}, '^([^\s　]+)[\s　]', 1) <> '' THEN regexp_extract({NAME}, '^([^\s　]+)[\s　]', 1) WHEN length({NAME}) >= 4 THEN substring({NAME}, 1, 2) ELSE substring({NAME}, 1, 1) END"),
)
scalar("f15_uncertain", NAMES, doubt=(lambda: X.is_uncertain(c("name"), F.lit(None).cast("string")), f"regexp_matches(name, '{'|'.join(tables.DOUBT_WORDS)}')"))
SUBJECT = rf"regexp_replace(regexp_replace(regexp_replace({SPACED.format('subject')}, '[①-⑩]', '', 'g'), '[0-9０-９]+$', ''), '\s+', '', 'g')"
SUBJECT = f"coalesce({sql_map(SUBJECT, tables.SUBJECT_ALIASES)}, {SUBJECT})"
ORDER = "[" + ", ".join(f"'{s}'" for s in tables.SUBJECT_ORDER) + "]"
scalar("x11_clean_subject", SUBJECTS, clean=(lambda: X.clean_subject(c("subject")), SUBJECT))
scalar("o08_subject_rank", SUBJECTS, rank=(lambda: X.subject_rank(X.clean_subject(c("subject"))), f"CASE WHEN list_position({ORDER}, {SUBJECT}) > 0 THEN list_position({ORDER}, {SUBJECT}) - 1 ELSE 9999 END"))
scalar(
    "x17_subject_match", SUBJECTS,
    hit=(lambda: X.subject_matches(c("subject"), F.array(F.lit("数学"), F.lit("地歴公民科"), F.lit("美"))), f"({SUBJECT} <> '' AND (contains('数学', {SUBJECT}) OR contains({SUBJECT}, '数学') OR contains('地歴公民', {SUBJECT}) OR contains({SUBJECT}, '地歴公民') OR contains('美術', {SUBJECT}) OR contains({SUBJECT}, '美術')))"),
    broad=(lambda: X.subject_matches_broad(c("subject"), F.array(F.lit("数学")), F.lit("校長, 図書館専門員")), f"({SUBJECT} <> '' AND (contains('数学', {SUBJECT}) OR contains({SUBJECT}, '数学') OR contains('校長', {SUBJECT}) OR contains({SUBJECT}, '校長') OR contains('図書館専門員', {SUBJECT}) OR contains({SUBJECT}, '図書館専門員')))"),
)
FILE = "concat(CASE id % 4 WHEN 0 THEN 'Timetable ' WHEN 1 THEN 'staff' WHEN 2 THEN '前年' ELSE '' END, folder)"
scalar("x20_source_kind", EVENTS, kind=(lambda: X.source_kind(F.expr(FILE)), f"CASE WHEN contains({FILE}, '時間割') OR contains(lower({FILE}), 'timetable') THEN 'timetable' WHEN contains({FILE}, '名票') OR contains(lower({FILE}), 'teacher') OR contains(lower({FILE}), 'staff') THEN 'roster' WHEN contains({FILE}, '前年') OR contains(lower({FILE}), 'layout') THEN 'previous_layout' ELSE 'roster' END"))
ROLES = ", ".join(f"'{r}'" for r in tables.ROLE_SUBJECTS)
scalar(
    "x47_subject_prefix", SUBJECTS,
    prefix=(lambda: X.subject_prefix(F.when(c("id") % 3 == 0, c("subject")), F.when(c("id") % 5 == 0, F.lit("教頭, 主任")), c("subject")),
        f"CASE WHEN id % 3 = 0 AND trim(subject, ' ') <> '' THEN CASE WHEN {SUBJECT} = '' THEN '不明' WHEN {SUBJECT} IN ({ROLES}) OR suffix({SUBJECT}, '科') THEN {SUBJECT} ELSE {SUBJECT} || '科' END WHEN id % 5 = 0 THEN '教頭' WHEN {SUBJECT} = '' THEN '不明' WHEN {SUBJECT} IN ({ROLES}) OR suffix({SUBJECT}, '科') THEN {SUBJECT} ELSE {SUBJECT} || '科' END"),
)
scalar("x48_safe_name", NAMES, safe=(lambda: X.safe_name(c("name")), r"""CASE WHEN regexp_replace(coalesce(name, ''), '[\s　/\\:*?"<>|]+', '', 'g') = '' THEN '不明' ELSE regexp_replace(coalesce(name, ''), '[\s　/\\:*?"<>|]+', '', 'g') END"""))
WORDS = "SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN ' TRUE' WHEN 1 THEN '0' WHEN 2 THEN 'Yes ' WHEN 3 THEN 'n' WHEN 4 THEN NULL WHEN 5 THEN 'maybe' WHEN 6 THEN '1' ELSE 'False' END AS word FROM orders"
scalar("x28_boolean", WORDS, yes=(lambda: X.as_boolean(c("word")), "CASE WHEN lower(trim(word)) IN ('true', '1', 'yes', 'y') THEN true WHEN lower(trim(word)) IN ('false', '0', 'no', 'n') THEN false ELSE false END"))
TAG_LIST = r"list_filter(list_transform(regexp_split_to_array(coalesce(tags, ''), '[,;|]'), lambda t: lower(trim(t))), lambda t: t <> '')"
scalar("x29_tags", TAGS, tags=(lambda: F.array_join(X.tags_of(c("tags")), "+"), f"array_to_string({TAG_LIST}, '+')"))
TRANSIT = "[" + ", ".join(f"'{t}'" for t in tables.TRANSIT_TERMS) + "]"
scalar("f06_tag_match", TAGS, hit=(lambda: X.has_tag(X.tags_of(c("tags")), ("group", "mark")), f"len(list_filter({TAG_LIST}, lambda t: contains(t, 'group') OR contains('group', t) OR contains(t, 'mark') OR contains('mark', t))) > 0"))
scalar("f07_transit_or_meal", TAGS, hit=(lambda: X.has_tag(X.tags_of(c("tags")), tables.TRANSIT_TERMS), f"len(list_filter({TAG_LIST}, lambda t: len(list_filter({TRANSIT}, lambda q: contains(t, q) OR contains(q, t))) > 0)) > 0"))
scalar("f09_repeat_flags", TAGS, burst=(lambda: F.exists(X.tags_of(c("tags")), lambda t: F.contains(t, F.lit("burst"))), f"len(list_filter({TAG_LIST}, lambda t: contains(t, 'burst'))) > 0"), similar=(lambda: F.exists(X.tags_of(c("tags")), lambda t: F.contains(t, F.lit("low"))), f"len(list_filter({TAG_LIST}, lambda t: contains(t, 'low'))) > 0"))
NUMBERS = r"regexp_extract_all(lower(trim(coalesce(hint, ''))), '[0-9]{1,2}')"
SLUG = r"regexp_replace(regexp_replace(lower(trim(coalesce(hint, ''))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
scalar("x31_class_hint", HINTS, hint=(lambda: X.class_hint(c("hint")), f"CASE WHEN len({NUMBERS}) > 0 THEN 'class_' || array_to_string(list_filter({NUMBERS}, lambda n, i: list_position({NUMBERS}, n) = i), '_') WHEN {SLUG} = '' THEN 'unknown' ELSE {SLUG} END"))
scalar("x32_event_type", EVENTS, kind=(lambda: X.event_type(c("folder")), f"coalesce({sql_map(chr(39).join(['replace(replace(lower(trim(folder)), ', '-', ', ', '_', '), ', ' ', ', ', '_', ')']), tables.EVENT_ALIASES)}, 'general')"))
RAW = "replace(lower(trim(folder)), '-', '_')"
scalar("x33_event_of_folder", EVENTS, kind=(lambda: X.event_of_folder(c("folder")), "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains({RAW}, '{h.lower().replace('-', '_')}')''' for h in hints)} THEN '{k}'" for k, hints in tables.EVENT_HINTS) + " ELSE 'general' END"))
NARROW = sql_translate("coalesce(label, '')", dict(zip(X.WIDE, X.NARROW, strict=True))).replace("'" + "".join(X.NARROW) + "'", "'" + "".join(X.NARROW).replace("'", "''") + "'")
CARD = rf"upper(regexp_replace({NARROW}, '\s+', '', 'g'))"
DIGITS = rf"TRY_CAST(regexp_extract({CARD}, '^([A-Z])-?([0-9]{{1,3}})$', 2) AS INT)"
LETTER = rf"regexp_extract({CARD}, '^([A-Z])-?([0-9]{{1,3}})$', 1)"
scalar("x35_card_text", LABELS, text=(lambda: X.card_text(c("label")), CARD), narrow=(lambda: X.narrow(c("label")), f"trim({NARROW})"))
scalar(
    "x36_card_label", LABELS,
    class_id=(lambda: X.card_label(c("label"), F.lit("3"))["class_id"], f"CASE WHEN {LETTER} <> '' THEN '3' || {LETTER} END"),
    number=(lambda: X.card_label(c("label"), F.lit("3"))["student_number"], f"CASE WHEN {LETTER} <> '' THEN {DIGITS} END"),
    key=(lambda: X.card_label(c("label"), F.lit("3"))["label"], f"CASE WHEN {LETTER} <> '' THEN '3' || {LETTER} || '_' || lpad(CAST({DIGITS} AS STRING), 3, '0') END"),
)
scalar(
    "x37_card_label_in_class", LABELS,
    number=(lambda: X.card_label_in_class(c("label"), F.lit("2b"))["student_number"], f"CASE WHEN {LETTER} <> '' THEN {DIGITS} END"),
    mismatch=(lambda: X.card_label_in_class(c("label"), F.lit("2b"))["mismatch"], f"CASE WHEN {LETTER} <> '' THEN {LETTER} <> 'B' END"),
)
FORM = r"([0-9]+)\s*年\s*([A-Za-z0-9]+)\s*組"
OWN = "trim(class_id)"
scalar(
    "x41_class_parts", CLASSES,
    grade=(lambda: X.class_parts(c("class_id"))["grade"], f"CASE WHEN contains({OWN}, '-') THEN trim(split_part({OWN}, '-', 1)) ELSE regexp_extract({OWN}, '{FORM}', 1) END"),
    name=(lambda: X.class_parts(c("class_id"))["name"], f"CASE WHEN contains({OWN}, '-') THEN trim(substring({OWN}, strpos({OWN}, '-') + 1)) WHEN regexp_matches({OWN}, '{FORM}') THEN regexp_extract({OWN}, '{FORM}', 2) ELSE {OWN} END"),
)
scalar("x39_class_id", CLASSES, found=(lambda: X.class_id_of(c("class_id")), f"CASE WHEN regexp_matches(class_id, '{FORM}') THEN regexp_extract(class_id, '{FORM}', 1) || '-' || regexp_extract(class_id, '{FORM}', 2) ELSE nullif(regexp_extract(class_id, '([0-9]+-[A-Za-z0-9]+)', 1), '') END"))
TITLES = "SELECT c_custkey AS id, concat('3年A組 担任', CASE c_custkey % 3 WHEN 0 THEN '：' WHEN 1 THEN ' ' ELSE ': ' END, CASE c_custkey % 4 WHEN 0 THEN '' ELSE '山田 太郎' END, ' (40名)') AS title FROM customer"
scalar("x40_homeroom_teacher", TITLES, teacher=(lambda: X.homeroom_teacher(c("title")), r"CASE WHEN id % 4 = 0 THEN NULL ELSE '山田 太郎' END"))
KINDS = "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN ' Card_Not_Detected' WHEN 1 THEN 'duplicate_number' WHEN 2 THEN '複数札検出' WHEN 3 THEN 'Other' WHEN 4 THEN NULL ELSE 'missing_tag_shot' END AS kind FROM orders"
scalar("x42_error_type", KINDS, kind=(lambda: X.error_type(c("kind")), f"coalesce({sql_map('lower(trim(kind))', tables.ERROR_ALIASES)}, lower(trim(coalesce(kind, ''))))"))
scalar("x43_group_key", CLASSES, key=(lambda: X.group_key(c("class_id"), c("id")), "class_id || '::' || CAST(id AS STRING)"), back=(lambda: X.group_key_parts(X.group_key(c("class_id"), c("id")))["group_idx"], "CAST(id AS INT)"))
PART = """translate({0}, '\\/:*?"<>| ', '')"""
scalar("x44_package_name", PATHS, name=(lambda: X.package_name(F.lit("2025"), F.lit("North / High"), c("path"), X.student_id(F.lit("3A"), c("user_id")), F.lit("best")), f"'2025_NorthHigh_' || {STEM} || '_3A' || lpad(CAST(user_id AS STRING), 2, '0') || '_best.' || {SUFFIX}".replace("lpad(CAST(user_id AS STRING), 2, '0')", "substring(lpad(CAST(user_id AS STRING), 2, '0'), 1, 2)")))
scalar("x45_resolved_name", PATHS, name=(lambda: X.resolved_name(F.lit(""), F.when(c("id") % 2 == 0, F.lit("North")), c("path"), F.lit("3A01"), F.lit("resolved")), f"CASE WHEN id % 2 = 0 THEN 'North_' ELSE '' END || {STEM} || '_3A01_resolved.' || {SUFFIX}"))
scalar("x46_staff_file_name", PATHS, name=(lambda: X.staff_file_name(F.lit("数学科"), F.lit("山田 太郎"), c("path"), F.lit("card"), c("id") % 90), f"'数学科_山田太郎_' || {STEM} || '_card' || lpad(CAST(id % 90 AS STRING), 2, '0') || '.' || {SUFFIX}"))
scalar("x49_club_name", PATHS, name=(lambda: X.club_file_name(X.shooting_date(c("ts")), F.lit("Track & Field"), c("path"), c("id") % 90), f"strftime(ts, '%Y%m%d') || '_Track&Field_' || lpad(CAST(id % 90 AS STRING), 2, '0') || '_' || {STEM} || '.' || {SUFFIX}"))
scalar("k04_snap_name", PATHS, name=(lambda: X.snap_file_name(X.shooting_date(c("ts")), c("path"), c("value")), f"strftime(ts, '%Y%m%d') || '_' || {STEM} || '_本_' || CAST(CAST(trunc(value) AS INT) AS STRING) || '.' || {SUFFIX}"))
MESSAGES = "SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'unmatched, low confidence' WHEN 1 THEN 'obscene pose seen' WHEN 2 THEN 'true' WHEN 3 THEN 'error: no_card_detected' WHEN 4 THEN o_orderpriority WHEN 5 THEN 'missing_tag_shot unresolved' ELSE NULL END AS message FROM orders"
SHOWN = "message"
for _term, _word in tables.DISPLAY_TERMS.items():
    SHOWN = f"replace({SHOWN}, '{_term}', '{_word}')"
scalar("x50_display_value", MESSAGES, shown=(lambda: X.shown(c("message")), SHOWN))
scalar("x51_sheet_value", PATHS, score=(lambda: X.sheet_value(F.round(c("value"), 1), "string"), "CAST(round(value, 1) AS STRING)"), flag=(lambda: X.sheet_value(c("value") > 50, "boolean"), "CASE WHEN value > 50 THEN 'はい' ELSE 'いいえ' END"), time=(lambda: X.sheet_value(c("ts"), "timestamp_ntz"), "strftime(ts, '%Y-%m-%dT%H:%M:%S')"))
FOLDERS = "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN concat('cluster_', lpad(CAST(event_id AS STRING), 6, '0')) WHEN 1 THEN 'cluster_x' ELSE event_type END AS folder, concat('out/', event_type, CASE event_id % 2 WHEN 0 THEN '/clusters/a.jpg' ELSE '/b.jpg' END) AS path FROM events"
scalar("x52_cluster_title", FOLDERS, title=(lambda: X.cluster_title(c("folder")), "CASE WHEN regexp_matches(folder, '^cluster_[0-9]+$') THEN 'Cluster ' || CAST(CAST(substring(folder, 9) AS INT) AS STRING) ELSE folder END"))
scalar("x53_event_before", FOLDERS, event=(lambda: X.event_before(c("path"), "clusters"), "nullif(regexp_extract(path, '([^/]+)/clusters/', 1), '')"))
BOXES = "SELECT p_partkey AS id, CAST(p_size * 3 AS INT) AS x1, CAST(p_size AS INT) AS y1, CAST(p_size * 3 + p_partkey % 60 AS INT) AS x2, CAST(p_size + p_partkey % 41 AS INT) AS y2 FROM part"
scalar(
    "x55_padded_box", BOXES,
    left=(lambda: X.padded_box(F.struct("x1", "y1", "x2", "y2"), F.lit(160), F.lit(80), 0.25)["x1"], "greatest(0, x1 - CAST(trunc((x2 - x1) * 0.25) AS INT))"),
    bottom=(lambda: X.padded_box(F.struct("x1", "y1", "x2", "y2"), F.lit(160), F.lit(80), 0.25)["y2"], "least(80, y2 + CAST(trunc((y2 - y1) * 0.25) AS INT))"),
)
scalar("x56_scene_key", TAGS, key=(lambda: X.scene_key(X.tags_of(c("tags"))), f"CASE WHEN len({TAG_LIST}) > 0 THEN array_to_string(list_sort({TAG_LIST}), '_') ELSE 'unknown' END"))
PACKED = "SELECT event_id AS id, concat('2025_north_IMG', CAST(event_id AS STRING), '_3A', lpad(CAST(user_id % 40 AS STRING), 2, '0'), CASE event_id % 4 WHEN 0 THEN '_best' WHEN 1 THEN concat('_backup', CAST(event_id % 3 + 2 AS STRING)) WHEN 2 THEN '_tag' ELSE '' END, '.jpg') AS file FROM events"
scalar(
    "x57_student_file", PACKED,
    student=(lambda: X.student_file(c("file"))["student"], "CASE WHEN id % 4 < 3 THEN CAST(regexp_extract(file, '_3A([0-9]{2})_', 1) AS INT) END"),
    kind=(lambda: X.student_file(c("file"))["kind"], "CASE id % 4 WHEN 2 THEN 'card' WHEN 3 THEN NULL ELSE 'portrait' END"),
    priority=(lambda: X.student_file(c("file"))["priority"], "CASE id % 4 WHEN 1 THEN id % 3 + 2 WHEN 3 THEN NULL ELSE 0 END"),
)
scalar("x58_slashes", PATHS, path=(lambda: X.slashed(F.replace(c("path"), F.lit("/"), F.lit("\\\\"))), "path"))
scalar("x59_half_up", PATHS, r=(lambda: X.half_up(c("value"), 1), "round(value, 1)"))
JUNK = "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN concat(' ', CAST(event_id AS STRING), 'px') WHEN 1 THEN concat('-', CAST(event_id AS STRING), '.5') WHEN 2 THEN 'none' ELSE NULL END AS raw FROM events"
scalar("x60_number_or", JUNK, number=(lambda: X.number_or(c("raw"), 7.0), "CASE id % 4 WHEN 0 THEN CAST(id AS DOUBLE) WHEN 1 THEN -(id + 0.5) ELSE 7.0 END"))
ANSWERS = "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat('Here: ', props, ' done') ELSE 'no answer' END AS raw, props FROM events"
scalar("x24_json_object", ANSWERS, k=(lambda: X.json_object(c("raw"), "k long", "k")["k"], "CASE WHEN id % 3 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END"))
scalar("p28_headers", "SELECT event_id AS id, event_type AS status FROM events", ステータス=(lambda: c("status"), "status"))
