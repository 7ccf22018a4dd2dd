"""Column functions over names, labels, tags, paths and gaps. Null in gives null out unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables

#: Unicode white space for Java expressions, whose \s is ASCII only.
SPACE = r"(?U)\s"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))


def looked_up(key: Column, values: Mapping[str, str]) -> Column:
    """The value filed under `key`, else null."""
    flat = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), key)


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


# --- numbers in names, gaps -------------------------------------------------------------------------------------


def stem_of(path: Column) -> Column:
    """File name without folders and without the last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def suffix_of(path: Column) -> Column:
    """Lower-case last suffix without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def numeric_tail(path: Column) -> Column:
    """The last run of digits in the stem as a number; null without one or beyond 64 bits."""
    return F.try_element_at(F.regexp_extract_all(stem_of(path), F.lit(r"(\d+)"), 1), F.lit(-1)).try_cast("bigint")


def time_gap(a: Column, b: Column) -> Column:
    """Seconds between two times."""
    return F.abs(F.timestamp_diff("MICROSECOND", a, b)) / F.lit(1e6)


def sequence_gap(a: Column, b: Column) -> Column:
    """Distance of two sequence numbers."""
    return F.abs(a - b)


def shooting_date(time: Column) -> Column:
    """yyyyMMdd, eight zeros if unknown."""
    return F.coalesce(F.date_format(time, "yyyyMMdd"), F.lit("00000000"))


def capture_text(time: Column) -> Column:
    """The time as text, empty if unknown."""
    return F.coalesce(F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


# --- names and subjects -----------------------------------------------------------------------------------------


def one_spaced(text: Column) -> Column:
    """Every run of white space becomes one blank, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "　", " "), f"{SPACE}+", " "))


def unspaced(text: Column) -> Column:
    """Without any white space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def clean_name(name: Column) -> Column:
    """Without trailing colons and without honorifics in front or behind."""
    titles = "|".join(tables.HONORIFICS)
    out = F.regexp_replace(one_spaced(name), "[：:]+$", "")
    out = F.regexp_replace(out, f"^({titles}){SPACE}*", "")
    return F.trim(F.regexp_replace(out, f"{SPACE}*先生$", ""))


def clean_subject(subject: Column) -> Column:
    """X11: without circled or trailing digits and blanks, short forms spelled out."""
    out = F.regexp_replace(one_spaced(subject), "[①-⑩]", "")
    out = F.regexp_replace(F.regexp_replace(out, "[0-9０-９]+$", ""), f"{SPACE}+", "")
    return F.coalesce(looked_up(out, tables.SUBJECT_ALIASES), out)


def hiragana(text: Column) -> Column:
    """Katakana as hiragana."""
    return F.translate(text, KATAKANA, HIRAGANA)


def name_key(name: Column) -> Column:
    """X13 without Unicode composition, which built-in functions lack; names.name_key() has it."""
    titles = "|".join(tables.HONORIFICS)
    out = F.regexp_replace(F.coalesce(name, F.lit("")), "[：:]+$", "")
    out = F.regexp_replace(F.regexp_replace(out, f"^({titles}){SPACE}*", ""), f"{SPACE}*先生$", "")
    out = F.regexp_replace(out, f"(?U)[\\s　\\u00a0\\u200b-\\u200d\\ufeff]+", "")
    out = F.regexp_replace(F.regexp_replace(out, "（[^）]*）", ""), r"\([^)]*\)", "")
    out = F.translate(out, "".join(tables.NAME_VARIANTS), "".join(tables.NAME_VARIANTS.values()))
    return F.trim(F.regexp_replace(hiragana(out), "|".join(tables.NOISE_WORDS), ""))


def surname_of(name: Column) -> Column:
    """Up to the first blank, else two characters of four or more, else one."""
    name = F.regexp_replace(name, f"^{SPACE}+|{SPACE}+$", "")
    spaced = F.regexp_extract(name, r"^([^\s　]+)[\s　]", 1)
    return F.when(spaced != "", spaced).when(F.length(name) >= 4, F.substring(name, 1, 2)).otherwise(F.substring(name, 1, 1))


def subject_matches(subject: Column, subjects: Column) -> Column:
    """Equal to one of `subjects`, inside one, or around one; an empty subject matches none."""
    own = clean_subject(subject)
    return (own != "") & F.exists(subjects, lambda s: F.contains(clean_subject(s), own) | F.contains(own, clean_subject(s)))


def subject_matches_broad(subject: Column, subjects: Column, role: Column) -> Column:
    """As X17, over the comma-separated roles too."""
    roles = F.filter(F.transform(F.split(F.coalesce(role, F.lit("")), ","), F.trim), lambda r: r != "")
    return subject_matches(subject, F.concat(F.coalesce(subjects, F.array().cast("array<string>")), roles))


def subject_rank(subject: Column) -> Column:
    """Place in the display order, unknown last."""
    place = F.array_position(F.array(*[F.lit(s) for s in tables.SUBJECT_ORDER]), subject)
    return F.when(place > 0, place - 1).otherwise(9999)


def sorted_subjects(subjects: Column) -> Column:
    """Cleaned, distinct, in display order, then by name."""
    clean = F.array_distinct(F.filter(F.transform(subjects, clean_subject), lambda s: s != ""))
    ranked = F.array_sort(F.transform(clean, lambda s: F.struct(subject_rank(s).alias("rank"), s.alias("name"))))
    return F.transform(ranked, lambda x: x["name"])


def main_subject(subjects: Column) -> Column:
    """The first of O09, else empty."""
    return F.coalesce(F.try_element_at(sorted_subjects(subjects), F.lit(1)), F.lit(""))


def source_kind(file: Column) -> Column:
    """Kind of a staff document by its name."""
    low = F.lower(one_spaced(file))
    return (
        F.when(F.contains(file, F.lit("時間割")) | F.contains(low, F.lit("timetable")), "timetable")
        .when(F.contains(file, F.lit("名票")) | F.contains(low, F.lit("teacher")) | F.contains(low, F.lit("staff")), "roster")
        .when(F.contains(file, F.lit("前年")) | F.contains(low, F.lit("layout")), "previous_layout")
        .otherwise("roster")
    )


def is_uncertain(name: Column, notes: Column) -> Column:
    """the name or the notes voice doubt."""
    return F.concat_ws(" ", name, notes).rlike("|".join(tables.DOUBT_WORDS))


def subject_prefix(subjects: Column, role: Column, card_subject: Column) -> Column:
    """First subject, else first role, else the card's subject; with 科 unless it is an office or has it; else 不明."""

    def first(text: Column) -> Column:
        return F.try_element_at(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), F.trim), lambda s: s != ""), F.lit(1))

    token = clean_subject(F.coalesce(first(subjects), first(role), F.when(~is_blank(card_subject), clean_subject(card_subject))))
    bare = token.isin(*tables.ROLE_SUBJECTS) | F.endswith(token, F.lit("科"))
    return F.when(token == "", "不明").when(bare, token).otherwise(F.concat(token, F.lit("科")))


def safe_name(name: Column) -> Column:
    """Without blanks and characters that file systems refuse; 不明 if nothing is left."""
    out = F.regexp_replace(F.coalesce(name, F.lit("")), r'[\s　/\\:*?"<>|]+', "")
    return F.when(out == "", "不明").otherwise(out)


# --- tags, events, booleans -------------------------------------------------------------------------------------


def as_boolean(value: Column, default: bool = False) -> Column:
    """Yes and no words as booleans, `default` for others and null."""
    word = F.lower(F.trim(value))
    return F.when(word.isin("true", "1", "yes", "y"), True).when(word.isin("false", "0", "no", "n"), False).otherwise(default)


def tags_of(text: Column) -> Column:
    """Tags separated by comma, semicolon or bar, trimmed, lower-case, none empty; null gives no tags."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;|]"), lambda t: F.lower(F.trim(t)))
    return F.filter(parts, lambda t: t != "")


def _alike(term: Column):
    return lambda tag: F.contains(tag, term) | F.contains(term, tag)


def has_tag(tags: Column, terms: Sequence[str]) -> Column:
    """some tag contains a term or is contained in one."""
    found = F.lit(False)
    for term in terms:
        found = found | F.exists(tags, _alike(F.lit(term)))
    return F.coalesce(found, F.lit(False))


def class_hint(text: Column) -> Column:
    """class_ and the distinct numbers of one or two digits in order; else a slug; else unknown."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    numbers = F.array_distinct(F.regexp_extract_all(low, F.lit(r"(\d{1,2})"), 1))
    slug = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.size(numbers) > 0, F.concat(F.lit("class_"), F.array_join(numbers, "_"))).when(slug == "", "unknown").otherwise(slug)


def event_type(text: Column) -> Column:
    """The kind of event behind a name or alias, general if unknown."""
    key = F.translate(F.lower(F.trim(text)), "- ", "__")
    return F.coalesce(looked_up(key, tables.EVENT_ALIASES), F.lit("general"))


def event_of_folder(folder: Column, default: str = "general") -> Column:
    """The first kind of event with a hint in the folder's name."""
    raw, out = F.translate(F.lower(F.trim(folder)), "-", "_"), None
    for kind, hints in tables.EVENT_HINTS:
        hit = F.lit(False)
        for hint in hints:
            hit = hit | F.contains(raw, F.lit(hint.lower().replace("-", "_")))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(default)


# --- labels and files -------------------------------------------------------------------------------------------


def narrow(text: Column) -> Column:
    """Full-width forms as ASCII, trimmed."""
    return F.trim(F.translate(text, WIDE, NARROW))


def card_text(text: Column) -> Column:
    """Narrow, upper case, no blanks."""
    return F.upper(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), WIDE, NARROW), r"\s+", ""))


def card_label(text: Column, grade: Column) -> Column:
    """struct(class_id, student_number, label) of a letter and up to three digits; null if it is not such a label."""
    own = card_text(text)
    letter, digits = F.regexp_extract(own, r"^([A-Z])-?(\d{1,3})$", 1), F.regexp_extract(own, r"^([A-Z])-?(\d{1,3})$", 2).try_cast("int")
    class_id = F.concat(grade, letter)
    found = F.struct(class_id.alias("class_id"), digits.alias("student_number"), F.concat_ws("_", class_id, F.lpad(digits.cast("string"), 3, "0")).alias("label"))
    return F.when(letter != "", found)


def card_label_in_class(text: Column, folder_class: Column) -> Column:
    """As X36 with the folder's class as context; mismatch tells that the letters differ."""
    label = card_label(text, F.regexp_extract(folder_class, r"^(\d+)", 1))
    letter = F.upper(F.regexp_extract(folder_class, r"([A-Za-z])$", 1))
    return F.when(label.isNotNull(), F.struct(F.upper(folder_class).alias("class_id"), label["student_number"].alias("student_number"), (letter != F.right(label["class_id"], F.lit(1))).alias("mismatch")))


def class_parts(class_id: Column) -> Column:
    """struct(grade, name): around a hyphen, or of the year-and-class form, else no grade."""
    own, form = F.trim(class_id), r"(\d+)\s*年\s*([A-Za-z0-9]+)\s*組"
    at = F.locate("-", own)
    hyphen = F.struct(F.trim(F.substring(own, F.lit(1), at - 1)).alias("grade"), F.trim(F.substring(own, at + 1, F.length(own))).alias("name"))
    formed = F.struct(F.regexp_extract(own, form, 1).alias("grade"), F.regexp_extract(own, form, 2).alias("name"))
    return F.when(at > 0, hyphen).when(own.rlike(form), formed).otherwise(F.struct(F.lit("").alias("grade"), F.coalesce(own, F.lit("")).alias("name")))


def error_type(text: Column) -> Column:
    """The canonical error type, else the trimmed lower-case text."""
    key = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.coalesce(looked_up(key, tables.ERROR_ALIASES), key)


def group_key(class_id: Column, index: Column) -> Column:
    """Class and group index in one key."""
    return F.concat_ws("::", class_id, index.cast("string"))


def group_key_parts(key: Column) -> Column:
    """X43 back: struct(class_id, group_idx), the index null unless it is a number."""
    return F.struct(F.regexp_extract(key, r"(?s)^(.*)::", 1).alias("class_id"), F.regexp_extract(key, r"::([^:]*)$", 1).try_cast("int").alias("group_idx"))


def student_id(class_id: Column, number: Column) -> Column:
    """Class and number of at least two digits."""
    return F.concat(class_id, F.lpad(number.cast("string"), 2, "0"))


def clean_part(text: Column) -> Column:
    """A file name part without characters that file systems refuse."""
    return F.translate(F.coalesce(text, F.lit("")), '\\/:*?"<>| ', "")


def package_name(year: Column, school: Column, path: Column, identity: Column, tag: Column) -> Column:
    """year_school_stem_identity_tag.suffix."""
    name = F.concat_ws("_", year, clean_part(school), stem_of(path), clean_part(identity), tag)
    return F.concat_ws(".", name, F.nullif(suffix_of(path), F.lit("")))


def resolved_name(year: Column, school: Column, path: Column, identity: Column, tag: Column) -> Column:
    """As X44 without empty parts."""
    parts = F.filter(F.array(year, clean_part(school), stem_of(path), clean_part(identity), tag), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.concat_ws(".", F.array_join(parts, "_"), F.nullif(suffix_of(path), F.lit("")))


def staff_file_name(prefix: Column, name: Column, path: Column, tag: Column, number: Column) -> Column:
    """prefix_name_stem_tagNN.suffix."""
    numbered = F.concat(tag, F.lpad(number.cast("string"), 2, "0"))
    return F.concat(F.concat_ws("_", prefix, safe_name(name), stem_of(path), numbered), F.lit("."), suffix_of(path))


def rank_label(rank: Column) -> Column:
    return F.when(rank.isNull(), "").otherwise(F.lpad(rank.cast("string"), 2, "0"))


def club_file_name(date: Column, club: Column, path: Column, rank: Column) -> Column:
    """date_club_rank_stem.suffix with a rank of two digits."""
    return F.concat(F.concat_ws("_", date, clean_part(club), rank_label(rank), stem_of(path)), F.lit("."), suffix_of(path))


def snap_file_name(date: Column, path: Column, score: Column) -> Column:
    """date_stem_本_score.suffix with the score's whole part."""
    return F.concat(F.concat_ws("_", date, stem_of(path), F.lit("本"), score.cast("int").cast("string")), F.lit("."), suffix_of(path))


def unique_names(name: Column, copy: Column) -> Column:
    """The name, with __dup2, __dup3 ... before the suffix for its second, third ... use."""
    ending = F.regexp_extract(name, r"(\.[^./]*)$", 1)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(ending))
    return F.when(copy > 1, F.concat(base, F.lit("__dup"), copy.cast("string"), ending)).otherwise(name)


def shown(value: Column) -> Column:
    """Terms replaced in their fixed order, so that a term inside another is replaced first."""
    for term, word in tables.DISPLAY_TERMS.items():
        value = F.replace(value, F.lit(term), F.lit(word))
    return value


def shown_boolean(value: Column) -> Column:
    return F.when(value, "はい").when(~value, "いいえ").otherwise("")


def header(name: str) -> str:
    """The display name of a column, else of a term, else itself."""
    return tables.HEADERS.get(name) or tables.DISPLAY_TERMS.get(name, name)


def sheet_value(value: Column, kind: str) -> Column:
    """How a cell is shown: no null or NaN, numbers to three places, lists joined, times in ISO form."""
    if kind in ("double", "float"):
        return F.when(value.isNull() | F.isnan(value), "").otherwise(F.round(value, 3).cast("string"))
    if kind == "boolean":
        return shown_boolean(value)
    if kind.startswith("array"):
        return F.coalesce(F.array_join(F.transform(value, lambda v: v.cast("string")), ", "), F.lit(""))
    if kind.startswith("timestamp"):
        return F.coalesce(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def cluster_title(folder: Column) -> Column:
    """cluster_007 as Cluster 7, other names as they are."""
    number = F.regexp_extract(folder, r"^cluster_(\d+)$", 1).try_cast("int")
    return F.when(number.isNotNull(), F.concat(F.lit("Cluster "), number.cast("string"))).otherwise(folder)


def event_before(path: Column, marker: str) -> Column:
    """The path part in front of `marker`, null if there is none."""
    return F.nullif(F.regexp_extract(path, rf"(?:^|/)([^/]+)/{marker}(?:/|$)", 1), F.lit(""))


def media_type(path: Column) -> Column:
    """By suffix, octets if unknown."""
    return F.coalesce(looked_up(suffix_of(path), tables.MEDIA_TYPES), F.lit("application/octet-stream"))


def padded_box(box: Column, width: Column, height: Column, share: float) -> Column:
    """A box widened by a share of its sides, inside the picture."""
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    dx, dy = (w * F.lit(share)).cast("int"), (h * F.lit(share)).cast("int")
    zero = F.lit(0)
    return F.struct(
        F.greatest(zero, box["x1"] - dx).alias("x1"), F.greatest(zero, box["y1"] - dy).alias("y1"),
        F.least(width, box["x2"] + dx).alias("x2"), F.least(height, box["y2"] + dy).alias("y2"),
    )


def scene_key(tags: Column) -> Column:
    """Tags in order, joined; unknown without tags."""
    return F.when(F.size(tags) > 0, F.array_join(F.array_sort(tags), "_")).otherwise("unknown")


def student_file(name: Column) -> Column:
    """struct(student, kind, priority) of a package file: ..._IDnn_tag.suffix, kind portrait or name, lower first."""
    identity = F.regexp_extract(name, r"_([0-9]*[A-Za-z]?)(\d{2})_(?:best|backup\d*|tag)\.[A-Za-z]+$", 2).try_cast("int")
    tag = F.regexp_extract(name, r"_(best|backup\d*|tag)\.[A-Za-z]+$", 1)
    priority = F.when(tag == "best", 0).when(F.startswith(tag, F.lit("backup")), F.coalesce(F.regexp_extract(tag, r"(\d+)$", 1).try_cast("int"), F.lit(1))).otherwise(0)
    return F.when(identity.isNotNull(), F.struct(identity.alias("student"), F.when(tag == "tag", "card").otherwise("portrait").alias("kind"), priority.alias("priority")))


def slashed(path: Column) -> Column:
    """Forward slashes, none repeated."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/")


def half_up(value: Column, places: int = 0) -> Column:
    """X59."""
    return F.round(value, places)


def number_or(text: Column, fallback: float) -> Column:
    """The number that the text starts with, else `fallback`."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1), F.lit("")).try_cast("double"), F.lit(fallback))


def json_object(text: Column, schema: str, required: str) -> Column:
    """The object in a model's answer, also with text around it; null if it lacks `required`."""
    whole, inner = F.from_json(text, schema), F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)
    return F.when(whole[required].isNotNull(), whole).when(inner[required].isNotNull(), inner)


def json_fields(text: Column, schema: str) -> Column:
    """As json_object() without a required field: null only if there is no object."""
    fields, inner = F.from_json(text, schema), F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    whole = F.get_json_object(text, "$").startswith("{")
    return F.when(whole, fields).when(F.get_json_object(inner, "$").isNotNull(), F.from_json(inner, schema))


def class_id_of(text: Column) -> Column:
    """Grade and class from a sheet's title, such as 3-1 or the year-and-class form; null if there is none."""
    own = narrow(text)
    formed = F.concat_ws("-", F.nullif(F.regexp_extract(own, r"(\d+)\s*年\s*([A-Za-z0-9]+)\s*組", 1), F.lit("")), F.nullif(F.regexp_extract(own, r"(\d+)\s*年\s*([A-Za-z0-9]+)\s*組", 2), F.lit("")))
    return F.coalesce(F.nullif(formed, F.lit("")), F.nullif(F.regexp_extract(own, r"(\d+-[A-Za-z0-9]+)", 1), F.lit("")))


def homeroom_teacher(text: Column) -> Column:
    """The name behind the homeroom label, null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(narrow(text), r"担任\s*[:：]?+\s*([^\s()（）]+(?:\s[^\s()（）]+)?)", 1)), F.lit(""))
