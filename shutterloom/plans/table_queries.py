"""Small table operators, readings and the individual pipeline as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import readings, scores
from ..operators import individual
from ..operators import tables as T
from .ranking_queries import CLUB
from .registry import query, query_of

c = F.col


@query("x34_event_rules", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'school_trip' WHEN 1 THEN 'sports_festival' ELSE o_orderpriority END AS event FROM orders", "SELECT id, CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS landmarks, CASE WHEN id % 3 = 0 THEN 2 END AS transit_most, id % 3 = 1 AS by_class FROM {source} AS s")
def x34(df):
    return T.with_rules(df).select("id", "landmarks", "transit_most", "by_class")


@query("p26_p29_public_rows", CLUB, "SELECT pos, club || '::' || file AS item_id FROM {source} AS s")
def p29(df):
    return T.public(T.club_items(df.withColumn("_score", F.lit(1)))).select("pos", "item_id")


@query("s33_preview", "SELECT p_brand AS sheet, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS row, 1 AS col, p_name AS value FROM part", "SELECT sheet, row, value AS cells FROM {source} AS s WHERE row <= 11")
def s33(df):
    return T.preview(df, 10).select("sheet", "row", F.array_join("cells", "|").alias("cells"))


@query("s37_layers", "SELECT p_partkey AS id, p_type AS layer FROM part", "SELECT id FROM {source} AS s WHERE layer IN (SELECT min(layer) FROM {source} AS a UNION ALL SELECT max(layer) FROM {source} AS b)")
def s37(df):
    ends = df.agg(F.min("layer").alias("a"), F.max("layer").alias("b")).first()
    return T.on_layer(df, ends.a, ends.b).select("id")


@query("c13_overrides", "SELECT o_orderkey AS id, o_custkey % 3 AS a, o_custkey % 5 AS b FROM orders", "SELECT id, CASE WHEN b = 1 THEN 'late' WHEN a = 1 THEN 'early' ELSE 'base' END AS one FROM {source} AS s")
def c13(df):
    def entry(k, v):
        return F.create_map(k.cast("string"), F.lit(v))

    merged = T.overridden(F.create_map(F.lit("1"), F.lit("base")), [entry(c("a"), "early"), entry(c("b"), "late")])
    return df.select("id", merged["1"].alias("one"))


@query_of("h04_corrections", {"rows": "SELECT c_custkey AS id, c_name AS name FROM customer", "fixes": "SELECT o_custkey AS id, 'by hand' AS name FROM orders WHERE o_orderkey % 9 = 0"}, "SELECT id, CASE WHEN id IN (SELECT id FROM {fixes} AS f) THEN 'by hand' ELSE name END AS name FROM {rows} AS r")
def h04(rows, fixes):
    return T.corrected(rows, fixes, "id", "name").select("id", "name")


@query("h05_resolved_numbers", "SELECT o_custkey % 9 AS folder, concat('p', CAST(o_orderkey AS STRING)) AS image_path, CAST(o_orderkey % 50 AS INT) AS number, CASE WHEN o_orderkey % 4 = 0 THEN 'resolved' ELSE 'open' END AS status FROM orders", "SELECT folder, count(*) AS n, sum(number) AS total FROM {source} AS s WHERE status = 'resolved' GROUP BY folder")
def h05(df):
    numbers = T.resolved_numbers(df)
    total = F.aggregate(F.map_values("numbers"), F.lit(0).cast("long"), lambda a, b: a + b)
    return numbers.select("folder", F.size("numbers").cast("long").alias("n"), total.alias("total"))


@query_of("h10_existing", {"wanted": "SELECT l_partkey AS path, l_orderkey * 10 + l_linenumber AS id FROM lineitem", "files": "SELECT p_partkey AS path FROM part WHERE p_size < 10"}, "SELECT id FROM {wanted} AS w WHERE path IN (SELECT path FROM {files} AS f)")
def h10(wanted, files):
    return T.existing(wanted, files).select("id")


@query_of("h24_resolved_files", {"wanted": "SELECT DISTINCT concat('f', CAST(l_partkey % 300 AS STRING)) AS name FROM lineitem", "files": "SELECT concat(CASE p_partkey % 2 WHEN 0 THEN '' ELSE 'sub/' END, 'f', CAST(p_partkey % 400 AS STRING)) AS rel, concat('/r', CAST(p_partkey % 3 AS STRING), '/', CAST(p_partkey AS STRING)) AS path, CAST(p_partkey % 3 AS INT) AS root FROM part"},
    "SELECT name, arg_min(path, k) AS path FROM (SELECT w.name, f.path, (CASE WHEN f.rel = w.name THEN 0 ELSE 1 END, root, f.path) AS k FROM {wanted} AS w JOIN {files} AS f ON f.rel = w.name OR f.rel = 'sub/' || w.name) AS t GROUP BY name")
def h24(wanted, files):
    return T.resolved_file(wanted, files)


@query("h17_top_shown", CLUB, "SELECT pos FROM {source} AS s ORDER BY beauty DESC, pos LIMIT 20")
def h17(df):
    return T.top_shown(df, "beauty", "pos", 20).select("pos")


@query("o15_catalog_order", "SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN 'ranking.csv' ELSE concat('f', CAST(event_id AS STRING)) END AS name FROM events", "SELECT id, row_number() OVER (ORDER BY CASE WHEN name = 'ranking.csv' THEN 2 ELSE 3 END, name, id) AS place FROM {source} AS s")
def o15(df):
    from ..operators import ranking

    order = T.catalog_order(c("name"))
    return ranking.numbered_in_all(df, [order, "id"], ranking.text_lead(c("name"), order["place"]), "place").select("id", "place")


@query("h25_fitted", "SELECT p_partkey AS id, p_size * 20.0 AS w, 600.0 AS h FROM part", "SELECT id, round((36 - CASE WHEN w / h > 36.0 / 44 THEN 44 * (w / h) ELSE 36 END * 1.3) / 2 + 1.5, 4) AS x FROM {source} AS s")
def h25(df):
    fit = T.fitted(c("w"), c("h"), F.lit(36.0), F.lit(44.0), F.lit(130.0), F.lit(1.5), F.lit(0.0))
    return df.select("id", F.round(fit["x"], 4).alias("x"))


@query("h27_placeholders", CLUB, "SELECT pos, CASE WHEN closed = 0 THEN 'absent.png' ELSE file END AS file FROM {source} AS s")
def h27(df):
    return df.select("pos", T.placeholder(c("file"), c("closed") == 0).alias("file"))


@query("m11_page_ways", "SELECT l_suppkey AS file, l_linenumber AS page, l_orderkey AS row FROM lineitem", "SELECT file, page, CASE WHEN count(*) >= 8 THEN 'text' ELSE 'picture' END AS way FROM {source} AS s GROUP BY file, page")
def m11(df):
    return T.pages_by_way(df).select("file", "page", "way")


@query("k12_numbered_portraits", "SELECT o_custkey AS person, o_orderkey AS pos, o_totalprice AS score, o_orderkey % 5 = 0 AS is_ng, o_custkey % 2 = 0 AS matched FROM orders", "SELECT pos, row_number() OVER (PARTITION BY person ORDER BY is_ng, score DESC, pos) AS rank, CASE WHEN matched THEN 'matched' ELSE 'unmatched' END AS folder FROM {source} AS s")
def k12(df):
    return T.numbered_files(df, ["person"]).select("pos", "rank", "folder")


READ = "SELECT l_orderkey AS id, CAST(l_linenumber AS INT) AS pos, CASE l_partkey % 4 WHEN 0 THEN concat(CAST(l_partkey % 9 AS STRING), '-', CAST(l_suppkey % 30 AS STRING)) WHEN 1 THEN concat('no ', CAST(l_suppkey % 70 AS STRING)) ELSE 'x' END AS text, l_discount AS confidence FROM lineitem"


@query("e17_separators", READ, r"""SELECT id, grade, class_number, student_number FROM (SELECT id, min_by(g, k) FILTER (WHERE valid) AS grade, min_by(c, k) FILTER (WHERE valid) AS class_number, min(least) FILTER (WHERE NOT valid) AS student_number FROM
 (SELECT *, coalesce(g BETWEEN 1 AND 6 AND c BETWEEN 1 AND 20, false) AS valid, list_min(list_filter(list_transform(regexp_extract_all(text, '[0-9]+'), lambda n: CAST(n AS INT)), lambda n: n BETWEEN 1 AND 50)) AS least, pos * 100 + c * 0 AS k FROM (SELECT *, TRY_CAST(regexp_extract(text, '([0-9])-([0-9]{1,2})', 1) AS INT) AS g, TRY_CAST(regexp_extract(text, '([0-9])-([0-9]{1,2})', 2) AS INT) AS c FROM (SELECT id, pos, min(text) AS text FROM {source} AS s GROUP BY id, pos) AS a) AS b) AS t GROUP BY id) AS u WHERE grade IS NOT NULL""")
def e17(df):
    df = df.groupBy("id", "pos").agg(F.min("text").alias("text"))
    return readings.separators(df).select("id", "grade", "class_number", "student_number")


@query("e18_teacher_cards", "SELECT c_custkey AS id, CAST(1 AS INT) AS pos, CASE c_custkey % 3 WHEN 0 THEN '3-2 担任' WHEN 1 THEN '副担任' ELSE 'x' END AS text, '山田太郎' AS other FROM customer", "SELECT id, CASE id % 3 WHEN 0 THEN '3-2' END AS class_label, CASE id % 3 WHEN 0 THEN '担任' ELSE '副担任' END AS role, '山田太郎' AS name FROM {source} AS s WHERE id % 3 < 2")
def e18(df):
    lines = df.select("id", "pos", "text").unionByName(df.select("id", F.lit(2).alias("pos"), c("other").alias("text"))).withColumn("confidence", F.lit(0.9))
    return readings.teacher_card(lines)


TWICE = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS a, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE 'z' END AS b, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS ca, CAST(o_custkey % 10 AS DOUBLE) / 10 AS cb FROM orders"


@query("a33_a34_two_reads", TWICE, "SELECT id, CASE WHEN a = b THEN a WHEN length(coalesce(b, '')) > length(coalesce(a, '')) THEN b ELSE a END AS value, CASE WHEN a = b THEN 0.97 ELSE 0.9 END AS sure, CASE WHEN ca >= 0.75 THEN ca WHEN cb >= ca THEN cb ELSE ca END AS kept FROM {source} AS s")
def a33(df):
    vote = readings.agreed(c("a"), c("b"))
    kept = readings.better_read(F.struct(c("ca").alias("confidence")), F.struct(c("cb").alias("confidence")))
    return df.select("id", vote["value"].alias("value"), vote["confidence"].alias("sure"), kept["confidence"].alias("kept"))


@query("e09_largest_face", "SELECT l_orderkey AS id, CAST(l_linenumber * 100000 + l_partkey AS INT) AS face_index, CAST(0 AS INT) AS x1, CAST(0 AS INT) AS y1, CAST(l_quantity AS INT) AS x2, CAST(l_suppkey AS INT) AS y2 FROM lineitem", "SELECT id, face_index FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x2 * y2 DESC, face_index) AS n FROM {source} AS s) AS t WHERE n = 1")
def e09(df):
    """E08 to E11, E14 and E20 differ in the detector only; this is what follows them."""
    return readings.largest_face(df).select("id", "face_index")


@query("f02_integrated_rule", "SELECT event_id AS id, value / 100 AS cosine, CAST(event_id % 400 AS DOUBLE) AS gap, event_id % 20 AS jump, event_id % 2 = 0 AS turned FROM events", "SELECT id, CASE WHEN cosine >= 0.88 THEN 'strict' WHEN cosine >= 0.84 AND (gap <= 240 OR jump <= 10) THEN 'relaxed' WHEN cosine >= 0.82 AND (gap <= 120 OR jump <= 10 OR turned) THEN 'relaxed_near' END AS rule FROM {source} AS s")
def f02(df):
    """F02 for given cosines and gaps; the fold C02 applies the same bounds."""
    from ..operators.clustering import INTEGRATED, NARROW_SECONDS, STEPS, WIDE_SECONDS

    strict, wide, narrow = INTEGRATED
    near = lambda s: (c("gap") <= s) | (c("jump") <= STEPS)
    return df.select("id", F.when(c("cosine") >= strict, "strict").when((c("cosine") >= wide) & near(WIDE_SECONDS), "relaxed").when((c("cosine") >= narrow) & (near(NARROW_SECONDS) | c("turned")), "relaxed_near").alias("rule"))


FOLDER = "SELECT CAST(e.label AS STRING) AS folder, e.vec_id AS idx, concat('p', CAST(e.vec_id AS STRING)) AS path, CASE WHEN e.vec_id % 7 = 0 THEN CAST(e.vec_id % 40 AS INT) END AS card_number, CASE WHEN e.vec_id % 50 = 0 THEN concat('3-', CAST(e.vec_id / 50 AS STRING)) END AS separator_label, CAST(NULL AS INT) AS separator_number, e.embedding AS emb FROM embeddings e"


@query("c07_grouped_people", FOLDER)
def c07(df):
    """C03, A30, J13, J14, J11 and A31 in one fold per folder."""
    return individual.grouped_people(df, 0.30)


@query("h06_best_shots", FOLDER)
def h06(df):
    """H06, H07 and W06 over C07."""
    groups = individual.grouped_people(df)
    scored = individual.flat_students(groups).select("path", F.length("path").cast("double").alias("score"), (F.length("path") % 2 == 0).alias("is_ng")).distinct()
    return individual.best_shots(groups, scored)


@query("p25_scale_clamp", CLUB, "SELECT pos, greatest(100.0, least(400.0, beauty * 60)) AS scale FROM {source} AS s")
def p25(df):
    from ..operators.geometry import SCALE_CLAMP

    return df.select("pos", scores.clipped(c("beauty") * 60, *SCALE_CLAMP).alias("scale"))
