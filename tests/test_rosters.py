"""Roster sheets of the three formats, and what is around them."""

from shutterloom.sources import rosters


def cells(spark, sheets):
    rows = [(s, r, k, v) for s, lines in sheets.items() for r, line in enumerate(lines, 1) for k, v in enumerate(line, 1) if v is not None]
    return spark.createDataFrame(rows, rosters.CELLS).repartition(3)


A = {"a": [["HR1", None, None, "HR2"], ["1", "Abe　Ko", "あべ", "1", "Ito"], ["２", "Baba", None, "1", "again"], ["x", "no number"]]}
B = {"b": [["3年A組 担任：山田"], ["番号", "氏名", "かな", None, "番号", "氏名"], ["1", "Abe", "あ", None, "21", "Ueda"], ["2", "Baba"], [], [], [], ["9", "too late"]]}
G = {"g": [["title"], ["No", "ふりがな", "氏名"], ["1", "あ", "Abe"], ["2", None, "Baba"], ["2", None, "twice"]]}


def found(df):
    return sorted((r["class"], r.number, r.name) for r in df.collect())


def test_sniffing(spark):
    assert {r.sheet: r.format for r in rosters.sniffed(cells(spark, A | B | G)).collect()} == {"a": "A", "b": "B", "g": "generic"}


def test_format_a(spark):
    assert found(rosters.format_a(cells(spark, A))) == [("1", 1, "Abe Ko"), ("1", 2, "Baba"), ("2", 1, "Ito")]


def test_format_b_stops_after_three_empty_rows(spark):
    assert found(rosters.format_b(cells(spark, B))) == [("3-A", 1, "Abe"), ("3-A", 2, "Baba"), ("3-A", 21, "Ueda")]


def test_generic_header_in_any_case(spark):
    got = rosters.generic(cells(spark, G)).collect()
    assert found(rosters.generic(cells(spark, G))) == [("g", 1, "Abe"), ("g", 2, "Baba")]
    assert {r.furigana for r in got} == {"あ", ""}


def test_answers_keep_the_first_page(spark):
    raw = '{"class": "3-1", "students": [{"number": 1, "name": "%s"}, {"number": null, "name": "x"}]}'
    pages = spark.createDataFrame([(2, raw % "late"), (1, "noise " + raw % "early" + " end"), (3, "none"), (4, None)], "page int, raw string")
    assert found(rosters.from_answers(pages)) == [("3-1", 1, "early")]
