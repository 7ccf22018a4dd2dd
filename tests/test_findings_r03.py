"""What the findings of the third round named."""

from pyspark.sql import functions as F

from shutterloom.functions import scores
from shutterloom.operators import relational, tables
from shutterloom.plans import fold_queries, ranking_queries, relational_queries, report_queries, scalar_queries, table_queries  # noqa: F401
from shutterloom.plans.registry import QUERIES, inputs


def test_fitted_plates_round_as_the_sql_does(spark):
    row = spark.createDataFrame([(460.0, 999.0, 149.0)], "image_w double, image_h double, scale double")
    fit = tables.fitted(F.col("image_w"), F.col("image_h"), F.lit(36.0), F.lit(44.0), F.col("scale"), F.lit(1.5), F.lit(-2.0))
    values = spark.createDataFrame([(2.5,), (-2.5,), (1.00005,), (None,)], "x double")
    got = [r.x for r in values.select(scores.rounded_away(F.col("x"), 0).alias("x")).collect()]
    assert got == [3.0, -3.0, 1.0, None]
    h = 36 / (460.0 / 999.0) * 149.0 / 100
    assert row.select(fit["h"]).first()[0] == h
    # 148.98525 is a double just below: its shortest decimal is a tie, its scaled value is not.
    assert row.sparkSession.createDataFrame([(1.0049999999999999,)], "x double").select(scores.rounded_away(F.col("x"), 2)).first()[0] == 1.0


def test_cosine_of_all_pairs_of_a_group(spark, sf):
    rows = QUERIES["x04_cosine"](spark, sf)
    photos = inputs(spark, sf, ranking_queries.PHOTOS)
    sizes = [r["count"] for r in photos.groupBy("grp").count().collect()]
    assert rows.count() == rows.select("a", "b").distinct().count() == sum(n * (n - 1) // 2 for n in sizes)
    few = {(r.a, r.b, round(r.cosine, 9)) for r in relational.pairs_of(photos, "grp", "id", "emb", 3).collect()}
    assert few == {(r.a, r.b, round(r.cosine, 9)) for r in relational.pairs_of(photos, "grp", "id", "emb").collect()}
