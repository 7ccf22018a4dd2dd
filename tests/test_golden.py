"""Known cases: buckets, labels, eyes, ranks, events, names and offsets."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.functions import names, providers, scalars, scores
from shutterloom.operators import ranking, relational, review
from shutterloom.sources import documents, files, sinks, zips


def bucket_counts(spark, n, best=None):
    df = spark.range(n).select(F.lit("g").alias("g"), "id", (F.lit(n) - F.col("id")).cast("double").alias("score"))
    rows = ranking.buckets(df, ["g"], "score", "id", best).orderBy("id").collect()
    return {b: [r.id for r in rows if r.bucket == b] for b in ("final_selected", "ng", "other_passing")}


@pytest.mark.parametrize(("n", "best", "final", "ng"), [(40, None, 12, 2), (40, 10, 10, 2), (40, 30, 30, 2), (40, 100, 38, 2), (32, None, 10, 2), (50, None, 15, 2), (2, None, 1, 1), (1, None, 1, 0)])
def test_buckets(spark, n, best, final, ng):
    got = bucket_counts(spark, n, best)
    assert got["final_selected"] == list(range(final))
    assert got["ng"] == list(range(n - ng, n))
    assert got["other_passing"] == list(range(final, n - ng))


@pytest.mark.parametrize("best", [0, -1, 1.5, "abc", 201, True])
def test_bad_counts(best):
    with pytest.raises(ValueError, match="whole number"):
        scores.checked_count(best)


@pytest.mark.parametrize(("text", "label"), [("A2", ("3A", 2, "3A_002")), ("A11", ("3A", 11, "3A_011")), ("D32", ("3D", 32, "3D_032")), ("H28", ("3H", 28, "3H_028")), ("Ｈ３２", ("3H", 32, "3H_032")), ("", None), ("32", None), ("3A32", None), ("A", None), ("担任", None), ("A1.5", None)])
def test_card_labels(spark, text, label):
    got = spark.createDataFrame([(text,)], "t string").select(scalars.card_label(F.col("t"), F.lit("3")).alias("x")).first().x
    assert (tuple(got) if got else None) == label


def test_regrouping(spark):
    groups = spark.createDataFrame([("a", ["p1", "p2"]), ("b", ["p3"])], "group_id string, paths array<string>")
    cards = spark.createDataFrame([("p2", True, "3A", 2), ("p1", False, "3B", 9)], "path string, accepted boolean, class_id string, student_number int")
    assert sorted(tuple(r)[:3] for r in relational.regrouped(groups, cards).collect()) == [("a", "3A", 2), ("b", "UNK", None)]


def test_eyes(spark):
    def landmarks(left, right):
        out = [(0.0, 0.0)] * 106
        out[34], out[35] = (9.0, 0.0), (0.0, float(left))
        out[88], out[89] = (9.0, 0.0), (0.0, float(right))
        return out

    df = spark.createDataFrame([(1, landmarks(2, 5)), (2, None), (3, landmarks(5, 5))], "id int, l array<struct<x: double, y: double>>")
    left, right = scores.eye_ratio_or_null(F.col("l"), *scores.LEFT_EYE), scores.eye_ratio_or_null(F.col("l"), *scores.RIGHT_EYE)
    got = {r.id: r for r in df.select("id", left.alias("a"), right.alias("b"), scores.eyes_closed(left, right).alias("closed")).collect()}
    assert got[1].a <= 0.24 < got[1].b and got[1].closed
    assert got[2].a is None and got[2].closed is None
    assert got[3].closed is False


def test_unknown_values_are_not_bounds(spark):
    row = spark.range(1).select(
        scores.clipped(F.lit(None).cast("double")).alias("clipped"), scores.eye_penalty(F.lit(None).cast("double"), F.lit(0.2)).alias("eyes"),
        scores.target_eye_distance(F.lit(None).cast("double"), F.lit(0.9), F.lit(36.0), F.lit(44.0)).alias("target"), scores.eye_penalty(F.lit(0.1), F.lit(0.1)).alias("closed"),
    ).first()
    assert (row.clipped, row.eyes, row.target, row.closed) == (None, 0.0, 0.22, 1.0)


def test_display_terms(spark):
    got = spark.createDataFrame([("unmatched",), ("eyes closed",), (None,)], "t string").select(scalars.shown(F.col("t"))).collect()
    assert [r[0] for r in got] == ["un照合済み", "目つぶり", None]
    assert scalars.header("error_type") == "エラー種別" and scalars.header("zzz") == "zzz"


def test_rank_changes(spark):
    rows = spark.createDataFrame([("c", "a.jpg", 1), ("c", "b.jpg", 2)], "club string, file string, rank int")
    changes = spark.createDataFrame([("c", "a.jpg", None, True), ("c", "b.jpg", 1, False)], "club string, file string, final_rank int, excluded boolean")
    got = {r.file: (r.final_rank, r.excluded) for r in relational.adjusted(rows, changes, ["club", "file"]).collect()}
    assert got == {"a.jpg": (None, True), "b.jpg": (1, False)}
    with pytest.raises(ValueError, match="no such row"):
        relational.adjusted(rows, changes.withColumn("file", F.lit("zzz")), ["club", "file"])


def test_events_of_folders(spark):
    rows = [(f"/in/{e}/{k}.jpg",) for e in ("b", "a") for k in (1, 2)]
    df = spark.createDataFrame(rows, "path string").select("path", F.current_timestamp().alias("modified"), F.lit(1).alias("size"))
    got = {(r.event_name, r.event_id) for r in files.events_of(files.described(df, "/in")).collect()}
    assert got == {("a", "event_1"), ("b", "event_2")}
    root = spark.createDataFrame([("/in/x.jpg",)], "path string").select("path", F.current_timestamp().alias("modified"), F.lit(1).alias("size"))
    assert {r.event_id for r in files.events_of(files.described(root, "/in")).collect()} == {"event_1"}


def test_name_keys_and_similarity():
    assert names.key_of("教諭 髙橋　フクダ（ふ）先生：") == names.key_of("高橋ふくだ")
    assert names.key_of(None) == "" and names.similarity_of("", "x") == 0.0
    assert names.key_of("か" + chr(0x3099)) == "が"
    assert names.similarity_of("山田太郎", "山田花子") == 0.5
    assert names.surname_part("山田 太郎") == "山田" and names.surname_part("山田太郎") == "山田" and names.surname_part("安二") == "安"


@pytest.mark.parametrize(("raw", "whole"), [('{"a": [1, 2, {"b": 3', '{"a": [1, 2, {"b": 3}]}'), ('{"class": "3A", "n": 4, "x": "tr', '{"class": "3A", "n": 4}'), ('{"class": "3A", "n": 4', '{"class": "3A", "n": 4}'), ('{"a": 1, "b":', '{"a": 1}'), ('{"a": 1, "b": {"c": "x, y", "d": tr', '{"a": 1, "b": {"c": "x, y"}}'), ('{"a": "x', '{}'), ('[1, 2,', '[1, 2]'), ('x {"a": 1} y', '{"a": 1}'), ("none", None), (None, None), ('{"a": [{"b": "x, y"}, {"c', '{"a": [{"b": "x, y"}]}')])
def test_json_repair(raw, whole):
    assert names.repaired(raw) == whole


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("club/one.jpg", b"1")
        z.writestr("club/two.txt", b"22")
    got = sorted((r.member, r.size, bytes(r.content)) for r in zips.members(spark, str(tmp_path), (".jpg",)).collect())
    assert got == [("club/one.jpg", 1, b"1")]
    for bad in ("../x", "/x", "a/../../x", "c:/x"):
        with pytest.raises(zips.UnsafeMember):
            zips.checked(bad)
    assert zips.checked("a\\b.jpg") == "a/b.jpg"
    packed = zips.archives(spark.createDataFrame([("z", "b/2", bytearray(b"two")), ("z", "a/1", bytearray(b"one"))], "archive string, member string, content binary")).first()
    with zipfile.ZipFile(io.BytesIO(packed.content)) as z:
        assert z.namelist() == ["a/1", "b/2"] and z.read("b/2") == b"two"


def test_pages_through_an_injected_parser(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"one two|three")), ("b.pdf", bytearray(b"!"))], "path string, content binary")

    def words():
        def parse(content):
            if content == b"!":
                raise ValueError
            return [[(k * 10, 5, k * 10 + 8, 9, w) for k, w in enumerate(page.split())] for page in content.decode().split("|")]

        return parse

    got = sorted((r.file, r.page, r.x0, r.text) for r in documents.page_words(files, words).collect())
    assert got == [("a.pdf", 1, 0.0, "one"), ("a.pdf", 1, 10.0, "two"), ("a.pdf", 2, 0.0, "three")]
    pages = documents.page_pictures(files, lambda: lambda content: [np.zeros((2, 3, 3), np.uint8)] * len(content), 4)
    assert sorted((r.file, r.page) for r in pages.collect()) == [("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3), ("a.pdf", 4), ("b.pdf", 1)]


def test_listing_and_sinks(spark, tmp_path):
    for name in ("3A/x.JPG", "y.png", "z.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"abc")
    listed = files.listing(spark, str(tmp_path / "in"))
    assert sorted((r.rel, r.folder, r.size) for r in listed.collect()) == [("3A/x.JPG", "3A", 3), ("y.png", None, 3)]
    assert files.photo_root(listed) == "" and files.photo_root(listed.where("depth = 1")) == "3A"
    root = str(tmp_path / "out")
    for k in (1, 2):
        sinks.write_version({"photos": listed.withColumn("k", F.lit(k))}, root)
    assert sinks.versions(spark, root) == [1, 2]
    assert {r.k for r in sinks.read_latest(spark, root, "photos").collect()} == {2}
    sinks.write_sheet(spark.createDataFrame([(True, 1.23456, ["a", "b"])], "is_ng boolean, total_score double, related_paths array<string>"), str(tmp_path / "sheet"))
    back = spark.read.option("header", True).csv(str(tmp_path / "sheet")).first().asDict()
    assert back == {"NG判定": "はい", "総合スコア": "1.235", "関連画像パス": "a, b"}
    sinks.write_json(listed, str(tmp_path / "json"))
    assert sinks.read_json(spark, str(tmp_path / "json"), "rel string").count() == 2
    assert sinks.read_json(spark, str(tmp_path / "none"), "rel string").count() == 0
    (tmp_path / "absent.txt").write_text("3, 7\n9,x")
    assert sorted(r.number for r in files.absent_numbers(spark, str(tmp_path / "absent.txt")).collect()) == [3, 7, 9]


def test_pixel_features():
    flat = np.full((12, 12, 3), 100, np.uint8)
    focus, mean, bright, contrast, thirds, sharp = providers.pixel_features(flat)
    assert bright == pytest.approx(100) and (focus, mean, contrast, thirds, sharp) == pytest.approx((0, 0, 0, 0, 0), abs=1e-6)
    edge = flat.copy()
    edge[:, 6:] = 200
    assert providers.pixel_features(edge)[0] > 0 and providers.pixel_features(edge)[5] > 0
    mask = np.zeros((8, 8), bool)
    mask[1, 1] = mask[2, 2] = mask[6, 6] = True
    assert providers.largest_blob(mask) == 2
    skin = np.full((20, 20, 3), (200, 120, 90), np.uint8)
    assert providers.skin_gesture(skin, None) == 1.0 and providers.skin_gesture(flat, None) == 0.0


def test_resolutions(spark):
    groups = spark.createDataFrame([("3A", 0, None, [], ["p1", "p2"]), ("3A", 1, 5, [], ["p3"]), ("3A", 2, 5, [], ["p4"]), ("3B", 0, 1, [], ["p5"])], review.GROUP)
    log = spark.createDataFrame(
        [
            (1, "resolved", "manual_student_number", "p1", "3A::0", None, 7),
            (2, "open", "manual_student_number", "p5", "3B::0", None, 9),
            (3, "resolved", "manual_candidate_selection", None, None, ["3A::2", "3A::1"], 5),
            (4, "deleted", "manual_delete", "p5", None, None, None),
        ],
        "seq long, status string, resolution_type string, image_path string, group_key string, group_keys array<string>, student_no int",
    )
    got = {(r.class_id, r.group_idx): (r.student_number, r.cards, r.portraits) for r in review.apply_resolutions(groups, log).collect()}
    assert got == {("3A", 0): (7, ["p1"], ["p2"]), ("3A", 1): (None, [], ["p3"]), ("3A", 2): (5, [], ["p4"]), ("3B", 0): (1, [], [])}


def test_manifest_orders_and_marks_absentees(spark):
    portraits = spark.createDataFrame([("3A", 2, "in/a.jpg", 5.0, False, 1), ("3A", 2, "in/b.jpg", 9.0, True, 2), ("3A", 2, "in/c.jpg", 4.0, False, 3)], "class_id string, student_number int, path string, score double, is_ng boolean, pos int")
    roster = spark.createDataFrame([("3A", 1, "Ito"), ("3A", 2, "Abe")], "class_id string, number int, name string")
    (row,) = review.manifest(portraits, roster, "2025", "North High").collect()
    assert (row.students, row.absent) == (2, 1)
    assert [(e.number, e.name, e.absent) for e in row.entries] == [(1, "Ito", True), (2, "Abe", False)]
    assert '"best":"2025_NorthHigh_a_3A02_best.jpg"' in row.entries[1].files
