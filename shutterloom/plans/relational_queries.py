"""Joins, set operations and group aggregations as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import scores, vectors
from ..operators import ranking, relational as J
from .ranking_queries import CLUB, PARTS, PHOTOS
from .registry import query, query_of

c = F.col
ROSTER = "SELECT concat(CAST(c_nationkey % 3 + 1 AS STRING), '-', CAST(c_nationkey AS STRING)) AS class, CAST(c_custkey % 61 AS INT) AS number, c_name AS name, c_custkey AS pos FROM customer WHERE c_custkey % 4 <> 1"
PRESENT = "SELECT concat(CAST(c_nationkey % 3 + 1 AS STRING), '-', CAST(c_nationkey AS STRING)) AS class, CAST(o_orderkey % 67 AS INT) AS number, o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 67 % 3 <> 0"
FIRST = "(SELECT class, number, name FROM (SELECT *, row_number() OVER (PARTITION BY class, number ORDER BY pos) AS n FROM {roster} AS r0) AS r1 WHERE n = 1)"


@query_of("j05_roster_lookup", {"rows": PRESENT, "roster": ROSTER}, "SELECT p.id, p.class, p.number, r.name FROM {rows} AS p LEFT JOIN " + FIRST + " AS r ON p.class = r.class AND p.number = r.number")
def j05(rows, roster):
    return J.looked_up(rows, roster, ["class", "number"], "pos").select("id", "class", "number", "name")


KEYED = "SELECT o_orderkey AS id, concat('k', CAST(o_orderkey % 900 AS STRING)) AS k1, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS k2, concat('m', CAST(o_custkey AS STRING)) AS k3 FROM orders"
KEYS = "SELECT concat(CASE c_custkey % 3 WHEN 0 THEN 'k' WHEN 1 THEN '' ELSE 'm' END, CAST(c_custkey AS STRING)) AS key, c_name AS name FROM customer"


@query_of("j06_multi_key_lookup", {"rows": KEYED, "roster": KEYS}, "SELECT s.id, coalesce(a.name, b.name, d.name) AS name FROM {rows} AS s LEFT JOIN {roster} AS a ON a.key = s.k1 LEFT JOIN {roster} AS b ON b.key = s.k2 LEFT JOIN {roster} AS d ON d.key = s.k3")
def j06(rows, roster):
    return J.looked_up_by_any(rows, "id", F.array("k1", "k2", "k3"), roster, "key", "name").select("id", "name")


@query("j07_roster_key", PRESENT, "SELECT id, CASE class WHEN '1-0' THEN 'X' WHEN '2-1' THEN 'Y' ELSE CAST(number AS STRING) END AS key FROM {source} AS s")
def j07(df):
    return df.select("id", J.roster_key(c("class"), c("number"), {"1-0": "X", "2-1": "Y"}).alias("key"))


@query_of("j08_absent", {"roster": ROSTER, "present": PRESENT}, "SELECT r.class, r.number, r.name FROM {roster} AS r WHERE NOT EXISTS (SELECT 1 FROM {present} AS p WHERE p.class = r.class AND p.number = r.number)")
def j08(roster, present):
    """J08, J09 and U03."""
    return J.absent(roster, present, ["class", "number"]).select("class", "number", "name")


@query_of("f27_present", {"roster": ROSTER, "present": PRESENT}, "SELECT r.class, r.number, r.name FROM {roster} AS r WHERE EXISTS (SELECT 1 FROM {present} AS p WHERE p.class = r.class AND p.number = r.number)")
def f27(roster, present):
    return J.only_present(roster, present, ["class", "number"]).select("class", "number", "name")


@query_of("u02_present_and_absent", {"roster": ROSTER, "present": PRESENT}, "SELECT class, number, true AS present FROM (SELECT DISTINCT class, number FROM {present} AS p) AS d UNION ALL SELECT class, number, false AS present FROM (SELECT DISTINCT class, number FROM {roster} AS r EXCEPT SELECT DISTINCT class, number FROM {present} AS p) AS e")
def u02(roster, present):
    """U01, U02 and U03 by set operations."""
    here = present.select("class", "number").distinct()
    gone = roster.select("class", "number").distinct().exceptAll(here)
    return here.withColumn("present", F.lit(True)).unionByName(gone.withColumn("present", F.lit(False))).orderBy("class", "number")


@query("u04_overlap", "SELECT o_orderkey AS id, o_custkey % 6 AS a, o_orderkey % 5 AS b FROM orders", "SELECT id, a IN (b, b + 1) OR a + 2 IN (b, b + 1) AS overlap, CASE WHEN a IN (b, b + 1) THEN 1 ELSE 0 END + CASE WHEN a + 2 IN (b, b + 1) THEN 1 ELSE 0 END AS n FROM {source} AS s")
def u04(df):
    left, right = F.array(c("a"), c("a") + 2), F.array(c("b"), c("b") + 1)
    return df.select("id", F.arrays_overlap(left, right).alias("overlap"), F.size(F.array_intersect(left, right)).alias("n"))


@query("u06_group_paths", "SELECT o_orderkey AS id, o_custkey % 3 AS a, o_orderkey % 4 AS b, o_custkey % 4 AS d FROM orders", "SELECT id, array_to_string(list_filter([a, b, a, d], lambda x, i: list_position([a, b, a, d], x) = i), ',') AS paths FROM {source} AS s")
def u06(df):
    """Distinct in first-seen order."""
    paths = F.array_distinct(F.concat(F.array("a", "b"), F.array("a", "d")))
    return df.select("id", F.array_join(F.transform(paths, lambda p: p.cast("string")), ",").alias("paths"))


ERRORS = "SELECT o_orderkey AS err, concat('e', CAST(o_orderkey AS STRING)) AS error_id, o_orderpriority AS error_type, CAST(o_custkey % 20 AS STRING) AS class_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 50 END AS number FROM orders"
RESOLUTIONS = "SELECT CASE WHEN l_linenumber = 1 THEN concat('e', CAST(l_orderkey AS STRING)) END AS error_id, CASE WHEN l_suppkey % 3 = 0 THEN 'resolved' WHEN l_suppkey % 3 = 1 THEN 'open' ELSE 'deleted' END AS status, CASE l_linenumber WHEN 2 THEN '1-URGENT' ELSE 'none' END AS error_type, CAST(l_partkey % 20 AS STRING) AS class_id, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_suppkey % 50 END AS number FROM lineitem WHERE l_linenumber <= 2"


@query_of("j10_unresolved", {"errors": ERRORS, "resolutions": RESOLUTIONS}, """SELECT err FROM {errors} AS e WHERE NOT EXISTS (SELECT 1 FROM {resolutions} AS r WHERE r.status IN ('resolved', 'deleted') AND r.error_id = e.error_id)
 AND NOT EXISTS (SELECT 1 FROM {resolutions} AS r WHERE r.status IN ('resolved', 'deleted') AND r.error_type IS NOT DISTINCT FROM e.error_type AND r.class_id IS NOT DISTINCT FROM e.class_id AND r.number IS NOT DISTINCT FROM e.number)""")
def j10(errors, resolutions):
    """J10 and F22."""
    return J.unresolved(errors, resolutions, ["error_type", "class_id", "number"]).select("err")


SEPARATORS = "SELECT user_id AS usr, event_id AS spot, concat('c', CAST(event_id AS STRING)) AS class_id FROM events WHERE event_type = 'purchase' OR event_id % 23 = 0"
POINTS = "SELECT user_id AS usr, event_id AS spot, event_id AS id FROM events"


@query_of("j11_segments", {"separators": SEPARATORS, "points": POINTS}, "SELECT p.id, s.class_id FROM {points} AS p LEFT JOIN (SELECT *, coalesce(lead(spot) OVER (PARTITION BY usr ORDER BY spot), 1000000) AS stop FROM {separators} AS t) AS s ON s.usr = p.usr AND s.spot <= p.spot AND p.spot < s.stop")
def j11(separators, points):
    """W10 and J11."""
    return J.in_segments(points, ranking.segments(separators, ["usr"], "spot", F.lit(1_000_000)), ["usr"], "spot").select("id", c("segment.class_id").alias("class_id"))


@query_of("w10_segment_ends", {"separators": SEPARATORS}, "SELECT class_id, spot AS start, coalesce(lead(spot) OVER (PARTITION BY usr ORDER BY spot), 1000000) AS stop FROM {separators} AS s")
def w10(separators):
    return ranking.segments(separators, ["usr"], "spot", F.lit(1_000_000)).select("class_id", "start", "stop")


GUIDES = "SELECT p_brand AS page, p_partkey AS guide, p_retailprice / 10 AS y FROM part"
ALL_FRAMES = "SELECT p_brand AS page, p_partkey AS frame, p_retailprice / 10 + 3.3 AS top, p_retailprice / 10 + 3.3 + p_size AS bottom FROM part"


@query_of("j12_guides_in_frames", {"guides": GUIDES, "frames": ALL_FRAMES}, "SELECT frame, count(*) AS n, round(min(y - top), 4) AS first_guide, round(max(y - top), 4) AS last_guide FROM {guides} AS g JOIN {frames} AS f ON g.page = f.page AND y > top + 0.5 AND y < bottom - 0.5 GROUP BY frame")
def j12(guides, frames):
    """First and last guide strictly inside each frame."""
    bands = frames.withColumn("low", c("top") + 0.5).withColumn("high", c("bottom") - 0.5)
    rows = bands.join(J.ends_within(guides, bands, ["page"], "y", "low", "high"), ["page", "low", "high"])
    return rows.groupBy("frame").agg(F.sum("n").alias("n"), F.round(F.min(c("first") - c("top")), 4).alias("first_guide"), F.round(F.max(c("last") - c("top")), 4).alias("last_guide"))


CARDS = "SELECT user_id AS usr, event_id AS card FROM events WHERE event_type = 'click'"
GROUPS = "SELECT user_id AS usr, event_id AS grp FROM events WHERE event_type = 'view'"


@query_of("j13_nearest_group", {"cards": CARDS, "groups": GROUPS}, "SELECT card, grp FROM (SELECT card, grp, row_number() OVER (PARTITION BY card ORDER BY abs(card - grp), grp) AS n FROM {cards} AS a JOIN {groups} AS g ON a.usr = g.usr AND abs(card - grp) <= 200) AS t WHERE n = 1")
def j13(cards, groups):
    return J.nearest(cards, groups, ["usr"], "card", "grp", 200).select("card", "grp")


LINES = "SELECT l_orderkey AS group_id, l_linenumber AS line, concat('p', CAST(l_partkey AS STRING)) AS path FROM lineitem"
ACCEPTED = "SELECT concat('p', CAST(p_partkey AS STRING)) AS path, p_size > 25 AS accepted, p_brand AS class_id, p_size AS student_number FROM part"


@query_of("j15_regroup", {"lines": LINES, "cards": ACCEPTED}, "SELECT g.group_id, coalesce(h.class_id, 'UNK') AS class_id, h.student_number, g.n AS n_paths FROM (SELECT group_id, count(*) AS n FROM {lines} AS l GROUP BY group_id) AS g LEFT JOIN (SELECT group_id, class_id, student_number FROM (SELECT group_id, class_id, student_number, row_number() OVER (PARTITION BY group_id ORDER BY line, l.path) AS k FROM {lines} AS l JOIN {cards} AS d ON d.path = l.path WHERE accepted) AS t WHERE k = 1) AS h ON h.group_id = g.group_id")
def j15(lines, cards):
    """J15 and J16."""
    groups = lines.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "path"))), lambda x: x["path"]).alias("paths"))
    return J.regrouped(groups, cards)


CHANGES = "SELECT p_brand AS club, concat('IMG_', CAST(p_partkey AS STRING), '.jpg') AS file, CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE 1 END AS final_rank, p_partkey % 14 = 0 AS excluded FROM part WHERE p_partkey % 7 = 0"


@query_of("j17_adjusted_ranks", {"rows": CLUB, "changes": CHANGES}, "SELECT s.club, s.file, CASE WHEN s.pos % 7 = 0 THEN CASE WHEN s.pos % 14 = 0 THEN NULL ELSE 1 END ELSE rank END AS final_rank, s.pos % 14 = 0 AS excluded FROM (SELECT club, file, pos, row_number() OVER (PARTITION BY club ORDER BY beauty DESC, pos) AS rank FROM {rows} AS t) AS s")
def j17(rows, changes):
    """J17 and K08; O14 is its order."""
    ranked = ranking.numbered(rows, ["club"], [F.desc("beauty"), "pos"]).select("club", "file", "rank")
    return J.adjusted(ranked, changes, ["club", "file"]).select("club", "file", "final_rank", "excluded").orderBy("club", F.coalesce("final_rank", F.lit(9999)), "file")


@query_of("j18_write_back", {"rows": "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS part FROM lineitem", "found": "SELECT p_partkey AS part, p_brand AS brand FROM part WHERE p_size > 20"}, "SELECT r.id, f.brand FROM {rows} AS r LEFT JOIN {found} AS f ON f.part = r.part")
def j18(rows, found):
    """Equi joins that keep every left row."""
    return rows.join(found, "part", "left").select("id", "brand")


TAGGED = "SELECT DISTINCT concat('g', CAST(o_custkey AS STRING)) AS group_key FROM orders"
NAMING = "SELECT o_orderpriority AS error_type, concat('g', CAST(o_custkey AS STRING)) AS k1, concat('g', CAST(o_custkey + 1 AS STRING)) AS k2 FROM orders WHERE o_orderkey % 6 = 0"


@query_of("j20_error_tags", {"groups": TAGGED, "errors": NAMING}, "SELECT g.group_key, coalesce(string_agg(DISTINCT e.error_type, '|' ORDER BY e.error_type), '') AS tags FROM {groups} AS g LEFT JOIN (SELECT error_type, k1 AS k FROM {errors} AS a UNION ALL SELECT error_type, k2 FROM {errors} AS b) AS e ON e.k = g.group_key GROUP BY g.group_key")
def j20(groups, errors):
    errors = errors.select("error_type", F.array("k1", "k2").alias("group_keys"))
    return J.tagged(groups, errors).select("group_key", F.array_join("tags", "|").alias("tags"))


@query_of("j22_positional_join", {"students": ROSTER.replace(" WHERE c_custkey % 4 <> 1", ""), "frames": ALL_FRAMES}, "SELECT s.pos, f.frame FROM (SELECT pos, row_number() OVER (ORDER BY class, number, pos) AS n FROM {students} AS a) AS s JOIN (SELECT frame, row_number() OVER (ORDER BY top, frame) AS n FROM {frames} AS b) AS f ON s.n = f.n")
def j22(students, frames):
    """Students in order beside frames in order, over whole tables; no task numbers all rows of either."""
    a = ranking.numbered_in_all(students, ["class", "number", "pos"], ranking.text_lead(c("class"), F.lit(0)), "n")
    b = ranking.numbered_in_all(frames, ["top", "frame"], F.floor(c("top") * 1000), "n")
    return a.join(b, "n").select("pos", "frame")


ANCHORS = "SELECT vec_id AS anchor, vec_id AS pos, embedding AS anchor_emb FROM embeddings WHERE vec_id % 10 = 0"
PORTRAITS = "SELECT vec_id AS id, embedding AS emb FROM embeddings WHERE vec_id % 10 <> 0"


@query_of("j03_best_anchor", {"portraits": PORTRAITS, "anchors": ANCHORS}, """SELECT id, CASE WHEN s > 0.199 THEN anchor END AS anchor, round(s, 5) AS score FROM (SELECT id, anchor, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, pos) AS n FROM
 (SELECT p.id, a.anchor, a.pos, list_sum(list_transform(list_zip(p.emb, a.anchor_emb), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS s FROM {portraits} AS p, {anchors} AS a) AS t) AS u WHERE n = 1""")
def j03(portraits, anchors):
    out = J.best_anchor(portraits, anchors, 0.2 - 0.001)
    return out.select("id", "anchor", F.round("score", 5).alias("score"))


INDEX = "SELECT vec_id AS id, embedding AS emb FROM embeddings"


@query_of("j25_top_similar", {"index": INDEX, "queries": "SELECT vec_id AS query, embedding AS query_emb FROM embeddings WHERE vec_id % 50 = 0"}, "SELECT query, id, rank FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM (SELECT q.query, p.id, list_cosine_similarity(list_transform(p.emb, lambda x: CAST(x AS DOUBLE)), list_transform(q.query_emb, lambda x: CAST(x AS DOUBLE))) AS s FROM {index} AS p, {queries} AS q) AS t) AS u WHERE rank <= 5")
def j25(index, queries):
    """Every fiftieth vector against all rows, itself among them."""
    return J.top_similar(index, queries, 5).select("query", "id", "rank")


@query("x04_cosine", PHOTOS, "SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(list_transform(a.emb, lambda x: CAST(x AS DOUBLE)), list_transform(b.emb, lambda x: CAST(x AS DOUBLE))), 6) AS cosine FROM {source} AS a JOIN {source} AS b ON a.grp = b.grp AND a.id < b.id")
def x04(df):
    """X04 and X05 over all pairs of a group, each row of which meets all others."""
    return J.pairs_of(df, "grp", "id", "emb").select("a", "b", scores.rounded_away(c("cosine"), 6).alias("cosine"))


VECTORS = "SELECT vec_id AS id, label AS grp, embedding AS emb FROM embeddings"


@query("x04_centroid_cosine", VECTORS, """SELECT s.id, round(list_cosine_similarity(list_transform(s.emb, lambda x: CAST(x AS DOUBLE)), m.mean), 6) AS cosine FROM {source} AS s JOIN
 (SELECT grp, list(x ORDER BY dim) AS mean FROM (SELECT grp, dim, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT grp, unnest(emb) AS x, generate_subscripts(emb, 1) AS dim FROM {source} AS a) AS b GROUP BY grp, dim) AS d GROUP BY grp) AS m ON m.grp = s.grp""")
def x04_centroid(df):
    """X04, X05 and A04 once per row: each vector against its group's centroid."""
    rows = df.join(J.small(vectors.centroids(df, ["grp"])), "grp")
    return rows.select("id", F.round(vectors.cosine(c("emb"), c("centroid")), 6).alias("cosine"))


RULES = ((0.30, 4 * 3600, 40), (0.15, 3600, 10), (0.10, 1800, None))
GAP_SQL = "abs(date_diff('microsecond', a.ts, b.ts)) / 1e6"


@query("f01_similar_pairs", PHOTOS, f"SELECT a.id AS a, b.id AS b FROM {{source}} AS a JOIN {{source}} AS b ON a.grp = b.grp AND a.id < b.id, LATERAL (SELECT list_cosine_similarity(list_transform(a.emb, lambda x: CAST(x AS DOUBLE)), list_transform(b.emb, lambda x: CAST(x AS DOUBLE))) AS s) AS k WHERE (s >= 0.30 AND ({GAP_SQL} <= 14400 OR abs(a.seq - b.seq) <= 40)) OR (s >= 0.15 AND ({GAP_SQL} <= 3600 OR abs(a.seq - b.seq) <= 10)) OR (s >= 0.10 AND {GAP_SQL} <= 1800)")
def f01(df):
    """F01 over J01."""
    return J.similar_pairs(df, "grp", RULES).select(c("a_id").alias("a"), c("b_id").alias("b"))


GROUPED = "SELECT CAST(o_custkey % 30 AS STRING) AS class_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 200 AS INT) END AS student_number, concat('g', CAST(o_orderkey AS STRING)) AS group_key, concat('p', CAST(o_orderkey AS STRING)) AS path FROM orders"


@query_of("a13_duplicate_numbers", {"groups": GROUPED, "separators": "SELECT concat('p', CAST(o_orderkey AS STRING)) AS path FROM orders WHERE o_orderkey % 10 = 0"}, "SELECT class_id, student_number, string_agg(group_key, ',' ORDER BY group_key) AS keys FROM {groups} AS g WHERE student_number IS NOT NULL AND path NOT IN (SELECT path FROM {separators} AS s) GROUP BY class_id, student_number HAVING count(*) > 1")
def a13(groups, separators):
    groups = groups.withColumn("paths", F.array("path"))
    return J.duplicate_numbers(groups, separators).select("class_id", "student_number", F.array_join("group_keys", ",").alias("keys"))


@query("a14_missing_numbers", ROSTER, "SELECT class, string_agg(CAST(n AS STRING), ',' ORDER BY n) AS missing FROM (SELECT m.class, CAST(k.n AS INT) AS n FROM (SELECT class, max(number) AS top FROM {source} AS a GROUP BY class) AS m, range(1, 100) AS k(n) WHERE k.n <= m.top AND NOT EXISTS (SELECT 1 FROM {source} AS b WHERE b.class = m.class AND b.number = k.n)) AS t GROUP BY class")
def a14(df):
    missing = J.missing_numbers(df, "class", "number").where(F.size("missing") > 0)
    return missing.select("class", F.array_join(F.transform(F.array_sort("missing"), lambda n: n.cast("string")), ",").alias("missing"))


@query("a15_repeated_numbers", ROSTER, "SELECT class, number, count(*) AS n FROM {source} AS s GROUP BY class, number HAVING count(*) > 1")
def a15(df):
    return J.repeated_keys(df, ["class", "number"])


@query("a17_error_histogram", ERRORS, "SELECT error_type, count(*) AS count FROM {source} AS s GROUP BY error_type")
def a17(df):
    return df.groupBy("error_type").count()


@query("a16_a18_error_union", GROUPED, "SELECT * FROM (SELECT 'missing_tag_shot' AS error_type, class_id, CAST(NULL AS INT) AS student_number, group_key FROM {source} AS a WHERE student_number IS NULL UNION ALL SELECT 'multiple_card_detected', class_id, student_number, min(group_key) FROM {source} AS b WHERE student_number IS NOT NULL GROUP BY class_id, student_number HAVING count(*) > 1) AS t")
def a18(df):
    """Both kinds of error, ordered by class, type, number as text and group."""
    missing = df.where("student_number is null").select(F.lit("missing_tag_shot").alias("error_type"), "class_id", "student_number", "group_key")
    double = df.where("student_number is not null").groupBy("class_id", "student_number").agg(F.min("group_key").alias("group_key"), F.count("*").alias("n")).where("n > 1")
    both = missing.unionByName(double.select(F.lit("multiple_card_detected").alias("error_type"), "class_id", "student_number", "group_key"))
    return both.orderBy("class_id", "error_type", F.coalesce(c("student_number").cast("string"), F.lit("")), "group_key")


@query("a27_path_index", GROUPED, "SELECT path, CASE WHEN hash_last THEN 'card' ELSE 'portrait' END AS role, class_id FROM (SELECT path, class_id, student_number % 2 = 1 AS hash_last FROM {source} AS s WHERE student_number IS NOT NULL) AS t")
def a27(df):
    df = df.where("student_number is not null").withColumn("pos", F.lit(0))
    portraits, cards = df.withColumn("role", F.lit("portrait")), df.where("student_number % 2 = 1").withColumn("role", F.lit("card"))
    return J.path_index([portraits, cards]).select("path", "role", "class_id")


@query("a29_modal_size", PARTS, "SELECT grp, n AS count, size FROM (SELECT grp, bright AS size, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, bright) AS k FROM {source} AS s GROUP BY grp, bright) AS t WHERE k = 1")
def a29(df):
    sizes = df.groupBy("grp", c("bright").alias("size")).count()
    return sizes.groupBy("grp").agg(F.max("count").alias("count"), F.max_by("size", F.struct("count", -c("size"))).alias("size"))


@query("a30_first_number", "SELECT user_id AS usr, event_id AS id, CASE WHEN event_id % 4 = 0 THEN event_id END AS number FROM events", "SELECT usr, arg_min(number, id) FILTER (WHERE number IS NOT NULL) AS value FROM {source} AS s GROUP BY usr")
def a30(df):
    return J.first_known(df, ["usr"], "number", "id")


@query("a31_upper_median", "SELECT user_id AS usr, event_id AS id FROM events", "SELECT usr, list_sort(list(id))[count(*) // 2 + 1] AS median FROM {source} AS s GROUP BY usr")
def a31(df):
    return J.upper_median(df, ["usr"], "id")


@query("a32_valid_numbers", ROSTER, "SELECT class, count(DISTINCT number) AS n, min(number) AS least FROM {source} AS s GROUP BY class")
def a32(df):
    numbers = df.groupBy("class").agg(F.collect_set("number").alias("numbers"))
    return numbers.select("class", F.size("numbers").cast("long").alias("n"), F.array_min("numbers").alias("least"))


@query("a12_faces_per_photo", "SELECT l_orderkey AS photo, l_linenumber AS face, l_tax AS ear FROM lineitem", "SELECT photo, count(*) AS faces, count(*) FILTER (WHERE ear <= 0.03) AS closed FROM {source} AS s GROUP BY photo")
def a12(df):
    faces = df.groupBy("photo").agg(F.collect_list("ear").alias("ears"))
    return faces.select("photo", F.size("ears").cast("long").alias("faces"), F.size(F.filter("ears", lambda e: e <= 0.03)).cast("long").alias("closed"))


RECORDS = "SELECT l_orderkey AS ent, l_shipmode AS subject, l_tax AS conf FROM (SELECT l_orderkey, l_returnflag AS l_shipmode, l_tax FROM lineitem) AS x"


@query("a19_entity_merge", RECORDS, "SELECT ent, string_agg(DISTINCT subject, ',' ORDER BY subject) AS subjects, max(conf) AS confidence FROM {source} AS s GROUP BY ent")
def a19(df):
    return df.groupBy("ent").agg(F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("subjects"), F.max("conf").alias("confidence"))


@query("a24_presence", RECORDS, "SELECT ent, CASE WHEN count(*) FILTER (WHERE subject = 'R') > 0 AND count(*) FILTER (WHERE subject = 'N') > 0 THEN 'both' WHEN count(*) FILTER (WHERE subject = 'N') > 0 THEN 'timetable_only' WHEN count(*) FILTER (WHERE subject = 'R') > 0 THEN 'roster_only' ELSE 'other' END AS presence FROM {source} AS s GROUP BY ent")
def a24(df):
    kinds = df.groupBy("ent").agg(F.collect_set("subject").alias("k"))
    both, one, two = F.array_contains("k", "R") & F.array_contains("k", "N"), F.array_contains("k", "N"), F.array_contains("k", "R")
    return kinds.select("ent", F.when(both, "both").when(one, "timetable_only").when(two, "roster_only").otherwise("other").alias("presence"))


@query("a20_a25_run_summary", GROUPED, "SELECT count(*) AS groups, count(DISTINCT class_id) AS classes, count(*) FILTER (WHERE student_number IS NULL) AS unknown, count(DISTINCT student_number) AS numbers FROM {source} AS s")
def a25(df):
    """Run counters."""
    return df.agg(F.count("*").alias("groups"), F.countDistinct("class_id").alias("classes"), F.count_if(c("student_number").isNull()).alias("unknown"), F.countDistinct("student_number").alias("numbers"))


READINGS = "SELECT l_orderkey AS image, l_linenumber * 100000 + l_partkey AS pos, CAST(l_suppkey AS INT) AS value, round(l_discount * 10, 2) AS conf FROM lineitem"


@query("f12_winning_number", READINGS, "SELECT image, value FROM (SELECT image, value, row_number() OVER (PARTITION BY image ORDER BY value % 4 = 0 DESC, value BETWEEN 1 AND 50 DESC, conf DESC, pos) AS n FROM {source} AS s WHERE conf >= 0.5) AS t WHERE n = 1")
def f12(df):
    """Readings that are sure enough, those in the roster first, then those in range, then the surest, then the first."""
    order = F.struct((c("value") % 4 == 0).alias("in_roster"), c("value").between(1, 50).alias("in_range"), "conf", (-c("pos")).alias("first"))
    return df.where("conf >= 0.5").groupBy("image").agg(F.max_by("value", order).alias("value"))


@query("o09_sorted_subjects", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '数学,国' WHEN 1 THEN '英語①,情報,英' ELSE 'zzz,校長' END AS raw FROM orders", "SELECT id, CASE id % 3 WHEN 0 THEN '国語,数学' WHEN 1 THEN '英語,情報' ELSE '校長,zzz' END AS sorted, CASE id % 3 WHEN 0 THEN '国語' WHEN 1 THEN '英語' ELSE '校長' END AS main FROM {source} AS s")
def o09(df):
    """O09 and X19."""
    subjects = F.split("raw", ",")
    return df.select("id", F.array_join(X.sorted_subjects(subjects), ",").alias("sorted"), X.main_subject(subjects).alias("main"))


@query("o01_capture_order", "SELECT event_id AS id, user_id AS usr, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS ts, event_type AS name FROM events", "SELECT id, row_number() OVER (PARTITION BY usr ORDER BY ts NULLS FIRST, name, id) AS place FROM {source} AS s")
def o01(df):
    return ranking.numbered(df, ["usr"], [F.col("ts").asc_nulls_first(), "name", "id"], "place").select("id", "place")


@query("o12_largest", ALL_FRAMES, "SELECT page, arg_max(frame, bottom - top) AS frame FROM (SELECT * FROM {source} AS a ORDER BY frame) AS s WHERE (page, bottom - top) IN (SELECT page, max(bottom - top) FROM {source} AS b GROUP BY page) AND frame = (SELECT min(frame) FROM {source} AS d WHERE d.page = s.page AND d.bottom - d.top = s.bottom - s.top) GROUP BY page")
def o12(df):
    return df.groupBy("page").agg(F.max_by("frame", F.struct(c("bottom") - c("top"), -c("frame"))).alias("frame"))


@query("o13_candidates", PHOTOS, "SELECT grp, id FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY focus DESC, id) AS n FROM {source} AS s) AS t WHERE n <= 15")
def o13(df):
    return ranking.numbered(df, ["grp"], [F.desc("focus"), "id"], "n").where("n <= 15").select("grp", "id")


@query("o16_job_list", "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS made FROM orders", "SELECT id, status FROM {source} AS s WHERE status = 'O' ORDER BY made DESC, id LIMIT 50")
def o16(df):
    return df.where("status = 'O'").orderBy(F.desc("made"), "id").limit(50).select("id", "status")


@query("f20_event_filter", "SELECT event_id AS id, event_type AS name, user_id AS usr FROM events", "SELECT id FROM {source} AS s WHERE usr = 7 OR name IN ('click', 'Click')")
def f20(df):
    """F20 and F21."""
    return df.where((c("usr") == 7) | c("name").isin("click", "Click")).select("id")


@query("j24_keyword_search", "SELECT doc_id AS id, text, source FROM documents", "SELECT id FROM {source} AS s WHERE contains(lower(text), 'tion') AND source = 'src3'")
def j24(df):
    return df.where(F.contains(F.lower("text"), F.lit("tion")) & (c("source") == "src3")).select("id")


@query("h16_score_bands", CLUB, "SELECT pos, CASE WHEN beauty >= 7 THEN 'high' WHEN beauty >= 5 THEN 'middle' ELSE 'low' END AS band FROM {source} AS s")
def h16(df):
    return df.select("pos", F.when(c("beauty") >= 7, "high").when(c("beauty") >= 5, "middle").otherwise("low").alias("band"))


@query("h22_teacher_slots", "SELECT p_brand AS page, p_partkey AS frame, concat('Teacher_', CAST(p_partkey % 3 + 1 AS STRING)) AS name FROM part WHERE p_partkey % 40 < 3", "SELECT page, min(CASE WHEN name = 'Teacher_1' THEN frame END) AS slot1, min(CASE WHEN name = 'Teacher_2' THEN frame END) AS slot2, min(CASE WHEN name = 'Teacher_3' THEN frame END) AS slot3 FROM {source} AS s GROUP BY page")
def h22(df):
    slot = F.concat(F.lit("slot"), F.regexp_extract("name", r"(\d+)$", 1))
    return df.withColumn("slot", slot).groupBy("page").pivot("slot", ["slot1", "slot2", "slot3"]).agg(F.min("frame"))


@query_of("h23_student_frames", {"frames": ALL_FRAMES, "teachers": "SELECT p_partkey AS frame FROM part WHERE p_partkey % 15 = 0"}, "SELECT frame FROM {frames} AS f WHERE frame NOT IN (SELECT frame FROM {teachers} AS t)")
def h23(frames, teachers):
    return frames.join(teachers, "frame", "left_anti").select("frame")


@query("p21_placement_fallback", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'abc' WHEN event_id % 3 = 1 THEN '12.5' ELSE NULL END AS raw FROM events", "SELECT id, CASE WHEN id % 3 = 1 THEN 12.5 ELSE -3.5 END AS offset_x, CASE WHEN id % 3 = 1 THEN 12.5 ELSE 127.0 END AS scale FROM {source} AS s")
def p21(df):
    return df.select("id", X.number_or(c("raw"), -3.5).alias("offset_x"), X.number_or(c("raw"), 127.0).alias("scale"))
