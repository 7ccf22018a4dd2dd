"""Queries that read whole tables: no part of the input is left out."""

from pyspark.sql import functions as F

from shutterloom.functions import providers
from shutterloom.operators import staff
from shutterloom.plans import fold_queries, ranking_queries, relational_queries, report_queries, scalar_queries, table_queries  # noqa: F401
from shutterloom.plans.registry import QUERIES


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_top_similar_searches_all_rows(spark, sf):
    rows = QUERIES["j25_top_similar"](spark, sf)
    asked = table(spark, sf, "embeddings").where("vec_id % 50 = 0").count()
    assert rows.count() == 5 * asked
    assert rows.where("rank = 1 and id = query").count() == asked
    assert rows.where("id % 10 = 0 and id <> query").count() > 0


def test_collisions_are_numbered_over_all_events(spark, sf):
    rows = QUERIES["s08_collisions"](spark, sf)
    wanted = table(spark, sf, "events").where("event_id % 3 <> 2").count()
    assert rows.count() == rows.select("flat").distinct().count() == wanted
    assert rows.where(F.col("flat").rlike(r"_\d+_1\.")).count() > 0


def grown(spark, sf, tmp_path, name, key):
    """A folder with the table twice, the second time with ids far above."""
    rows = table(spark, sf, name)
    rows = rows.unionByName(rows.withColumn(key, F.col(key) + 1_000_000))
    rows.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), rows.count()


def test_every_event_is_asked_about(spark, sf, tmp_path):
    at, wanted = grown(spark, sf, tmp_path, "events", "event_id")
    rows = QUERIES["m02_provider_calls"](spark, at)
    assert rows.where("technical is not null").select("id").distinct().count() == rows.count() == wanted


def test_every_part_has_its_picture(spark, sf, tmp_path):
    at, wanted = grown(spark, sf, tmp_path, "part", "p_partkey")
    rows = QUERIES["e07_pixel_features"](spark, at)
    assert rows.where("failure is null and focus is not null").select("id").distinct().count() == rows.count() == wanted


def test_cosine_is_given_for_every_vector(spark, sf):
    rows = QUERIES["x04_centroid_cosine"](spark, sf)
    assert rows.where("cosine is not null").select("id").distinct().count() == rows.count() == table(spark, sf, "embeddings").count()


def test_tiny_faces_are_not_sent_and_failures_are_low(spark):
    faces = spark.createDataFrame([("tiny", 29, 90), ("small", 35, 39), ("bad", 90, 90), ("good", 40, 40), ("empty", 50, 50)], "id string, width int, height int")

    def answer(text):
        if text in ("tiny", "bad"):
            raise ValueError(text)
        return "{}" if text == "empty" else '```json\n{"has_clear_face": true, "eyes_closed": true}\n```'

    for least, small in ((providers.LEAST_FACE, (True, True, "medium")), (providers.LEAST_NOTEBOOK_FACE, (False, False, "low"))):
        rows = providers.judged_eyes(faces, F.col("id"), providers.FunctionProvider(answer), least)
        got = {r.id: tuple(r.eyes) for r in rows.collect()}
        assert got == {"tiny": (False, False, "low"), "small": small, "bad": (False, False, "low"), "good": (True, True, "medium"), "empty": (False, False, "medium")}


def test_tiny_faces_reach_no_provider(spark, tmp_path):
    def answer(text):
        (tmp_path / text).touch()
        return "{}"

    faces = spark.createDataFrame([("tiny", 29, 90), ("large", 90, 90)], "id string, width int, height int")
    providers.judged_eyes(faces, F.col("id"), providers.FunctionProvider(answer)).collect()
    assert [p.name for p in tmp_path.iterdir()] == ["large"]


def test_only_a_sure_split_parts_neighbours(spark):
    said = {"b": '{"same_group": false, "confidence": "Low"}', "c": None, "d": '{"same_group": false, "confidence": "high"}', "e": "{}", "f": '{"same_group": false}', "g": '{"same_group": true, "confidence": "high"}'}
    photos = spark.createDataFrame([("x", k, p) for k, p in enumerate("abcdefg")] + [("y", 0, "d")], "folder string, pos int, photo string")
    rows = providers.adjacent_groups(photos, "folder", "pos", "photo", lambda a, b: F.concat_ws(">", a, b), providers.FunctionProvider(lambda text: said[text[-1]]))
    got = {(r.folder, r.photo): (r.group, r.boundary and tuple(r.boundary)) for r in rows.collect()}
    assert got == {
        ("x", "a"): (0, None), ("x", "b"): (0, (True, "low", True)), ("x", "c"): (0, (True, "low", True)), ("x", "d"): (1, (False, "high", False)),
        ("x", "e"): (1, (True, "low", False)), ("x", "f"): (1, (True, "low", True)), ("x", "g"): (1, (True, "high", False)), ("y", "d"): (0, None),
    }


def test_staff_comes_by_text_or_by_picture_and_is_flat(spark):
    kind = "pos long, teacher_name string, surname string, given_name string, role_tags array<string>, subjects array<string>, classes_or_grades array<string>, confidence double, source_type string, notes string, file string, page int"

    def records(way):
        return spark.createDataFrame([(k, f"{way} person {f}", "", "", ["教頭"], ["数学"], ["3"], 0.9, "roster", "", f, 1) for k, f in enumerate(("long", "short", "none"))], kind)

    rows = spark.createDataFrame([("long", k % 3, k) for k in range(8)] + [("short", 1, k) for k in range(7)], "file string, page int, row int")
    got = {r.file: (r.name, r.subject, r.role) for r in staff.extracted_staff(rows, records("text"), records("picture")).collect()}
    assert got == {f: (f"{way} person {f}", "数学", "教頭") for f, way in (("long", "text"), ("short", "picture"), ("none", "picture"))}


def test_an_unreadable_judgement_is_asked_for_again(spark, tmp_path):
    def answer(text):
        again = (tmp_path / text).exists()
        (tmp_path / text).touch()
        return '{"has_clear_face": true}' if again else "sorry {"

    faces = spark.createDataFrame([("one", 90, 90)], "id string, width int, height int")
    rows = providers.judged_eyes(faces, F.col("id"), providers.FunctionProvider(answer), providers.LEAST_NOTEBOOK_FACE, 2)
    assert tuple(rows.first().eyes) == (True, False, "medium")


def test_every_part_is_a_frame_in_reading_order(spark, sf):
    assert QUERIES["o10_reading_order"](spark, sf).select("frame").distinct().count() == table(spark, sf, "part").count()


def test_the_largest_frame_is_that_of_all_parts(spark, sf):
    sizes = table(spark, sf, "part").groupBy("p_brand").agg(F.max("p_size").alias("most"))
    found = QUERIES["o12_largest"](spark, sf).join(table(spark, sf, "part"), F.col("frame") == F.col("p_partkey"))
    assert found.join(sizes, F.col("page") == sizes["p_brand"]).where("p_size = most").count() == sizes.count()


def test_every_line_is_a_word_on_its_page(spark, sf):
    words = QUERIES["c06_page_rows"](spark, sf).select(F.explode(F.split("text", " ")).alias("word"))
    assert words.where("word like 'w%'").count() >= 0.99 * table(spark, sf, "lineitem").count()
