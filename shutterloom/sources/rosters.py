"""Rosters from sheets. A sheet is a table of cells (sheet, row, col, value), so formats are joins, not loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

CELLS = "sheet string, row int, col int, value string"


def sniffed(cells: DataFrame) -> DataFrame:
    """(sheet, format) by what a sheet shows: HRnn headers: A; a class title with a number header: B; else generic."""
    value = scalars.narrow(F.col("value"))
    marks = cells.groupBy("sheet").agg(
        F.max(value.rlike(r"^HR\d+$")).alias("a"), F.max(scalars.class_id_of(F.col("value")).isNotNull() & (F.col("row") <= 3)).alias("title"), F.max(F.lower(value).isin("番号", "no", "no.")).alias("number"),
    )
    return marks.select("sheet", F.when(F.col("a"), "A").when(F.col("title") & F.col("number"), "B").otherwise("generic").alias("format"))


def format_a(cells: DataFrame) -> DataFrame:
    """Wide sheets with repeated blocks, each under an HRnn header: number, name and reading in the columns from it on."""
    heads = cells.where(scalars.narrow(F.col("value")).rlike(r"^HR\d+$")).select("sheet", F.col("row").alias("top"), F.col("col").alias("left"), F.regexp_extract(scalars.narrow(F.col("value")), r"(\d+)$", 1).alias("class"))
    data = cells.join(heads, "sheet").where("row > top and col between left and left + 2")
    below = Window.partitionBy("sheet", "left", "row").orderBy(F.desc("top"))
    data = data.withColumn("_n", F.dense_rank().over(below)).where("_n = 1")
    return _rows(data, F.col("class"))


def format_b(cells: DataFrame) -> DataFrame:
    """A class title in the first rows, then blocks of number, name, reading side by side; reading stops after three empty rows."""
    value = scalars.narrow(F.col("value"))
    titles = cells.where("row <= 3").groupBy("sheet").agg(F.first(scalars.class_id_of(F.col("value")), ignorenulls=True).alias("class")).where("class is not null")
    heads = cells.where(F.lower(value).isin("番号", "no", "no.")).select("sheet", F.col("row").alias("top"), F.col("col").alias("left"))
    data = cells.where(F.coalesce("value", F.lit("")) != "").join(heads, "sheet").where("row > top and col between left and left + 2")
    lines = data.select("sheet", "left", "top", "row").distinct()
    order = Window.partitionBy("sheet", "left").orderBy("row")
    jump = F.col("row") - F.coalesce(F.lag("row").over(order), F.col("top"))
    ended = F.max((jump > 3).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("_ended", ended).where("_ended = 0").select("sheet", "left", "row")
    return _rows(data.join(lines, ["sheet", "left", "row"]).join(titles, "sheet"), F.col("class"))


def generic(cells: DataFrame) -> DataFrame:
    """The first header row among five that names a number and a name column; case does not matter."""
    value = F.lower(scalars.narrow(F.col("value")))
    heads = cells.where("row <= 5 and col <= 29").withColumn("kind", F.when(value.isin("番号", "no", "no.", "出席番号"), "number").when(value.isin("氏名", "名前", "name"), "name").when(value.isin("ふりがな", "フリガナ", "furigana"), "furigana"))
    heads = heads.where("kind is not null").groupBy("sheet", "row", "kind").agg(F.min("col").alias("col"))
    both = heads.groupBy("sheet", "row").agg(F.count_if(F.col("kind").isin("number", "name")).alias("n")).where("n = 2").groupBy("sheet").agg(F.min("row").alias("top"))
    columns = heads.join(both, "sheet").where("row = top").select("sheet", "top", "kind", "col")
    data = cells.join(columns, ["sheet", "col"]).where("row > top")
    wide = data.groupBy("sheet", "row").pivot("kind", ["number", "name", "furigana"]).agg(F.first("value"))
    return _clean(wide.select("sheet", "row", F.col("sheet").alias("class"), "number", "name", "furigana"))


def _rows(data: DataFrame, class_id) -> DataFrame:
    kind = F.element_at(F.array(F.lit("number"), F.lit("name"), F.lit("furigana")), F.col("col") - F.col("left") + 1)
    wide = data.withColumn("kind", kind).withColumn("class", class_id).groupBy("sheet", "class", "left", "row").pivot("kind", ["number", "name", "furigana"]).agg(F.first("value"))
    return _clean(wide)


def _clean(wide: DataFrame) -> DataFrame:
    """The first row of each class and number; rows without either a number or a name go."""
    rows = wide.select("class", scalars.narrow(F.col("number")).try_cast("int").alias("number"), scalars.one_spaced(F.col("name")).alias("name"), scalars.one_spaced(F.col("furigana")).alias("furigana"), "sheet", "row")
    order = Window.partitionBy("class", "number").orderBy("sheet", "row")
    return rows.where("number is not null and name <> ''").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def from_answers(pages: DataFrame) -> DataFrame:
    """Model answers per page (page, raw) as a roster; a number that an earlier page has is not taken again."""
    schema = "class string, students array<struct<number: int, name: string, furigana: string, gender: string>>"
    answers = pages.select("page", scalars.json_object(F.col("raw"), schema, "students").alias("x")).where("x is not null")
    rows = answers.select("page", F.col("x.class").alias("class"), F.posexplode("x.students").alias("pos", "s")).select("class", "s.*", "page", "pos")
    order = Window.partitionBy("class", "number").orderBy("page", "pos")
    return rows.where("number is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
