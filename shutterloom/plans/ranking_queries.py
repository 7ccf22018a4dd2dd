"""Scores, ranks, buckets, runs and aggregates as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import vectors
from ..operators import ranking as R
from .registry import query, query_of

c = F.col
PARTS = "SELECT p_brand AS grp, p_partkey AS pos, p_retailprice AS focus, CAST(p_size AS DOUBLE) AS bright, CAST(p_partkey % 97 AS DOUBLE) AS comp, CAST(p_partkey % 31 AS DOUBLE) AS rare FROM part"
CLUB = """SELECT p_brand AS club, p_partkey AS pos, concat('IMG_', CAST(p_partkey AS STRING), '.jpg') AS file, CAST(p_size % 11 AS DOUBLE) AS formality, CAST(p_partkey % 10 AS DOUBLE) AS beauty,
 CAST(p_partkey % 7 AS DOUBLE) AS expression, CAST(p_partkey % 9 AS DOUBLE) AS emotion, CAST(p_size % 10 AS DOUBLE) AS people, CAST(p_partkey % 4 AS DOUBLE) AS gesture,
 CAST(p_partkey % 5 AS INT) AS closed, p_partkey % 13 = 0 AS is_ng, p_partkey % 3 = 0 AS eyes_closed, p_partkey % 17 = 0 AS has_hand_gesture, p_partkey % 19 = 0 AS has_exaggerated_expression,
 p_partkey % 23 = 0 AS face_obscured, p_size = 7 AS subject_falling, p_size = 9 AS eating_or_mouth_full, false AS strange_obscene_posing, p_size = 11 AS bad_pose, false AS visible_underwear, p_size = 13 AS severe_framing_issue FROM part"""
EVALS = """SELECT o_orderkey AS id, CAST(o_custkey % 40 AS STRING) AS folder, concat('p', CAST(o_orderkey AS STRING)) AS path, CAST(o_orderkey % 10 AS DOUBLE) AS technical, CAST(o_custkey % 10 AS DOUBLE) AS expression,
 CAST(o_orderkey % 7 AS DOUBLE) AS composition, CAST(o_orderkey % 9 AS DOUBLE) AS rarity, CAST(o_orderkey % 5 AS DOUBLE) AS event_relevance, CAST(o_orderkey % 4 AS DOUBLE) AS grade_relevance,
 o_orderkey % 8 = 0 AS alike, o_orderkey % 15 = 0 AS duplicate, o_orderkey % 11 = 0 AS burst, o_orderkey % 20 = 0 AS is_ng, concat('class_', CAST(o_custkey % 6 AS STRING)) AS class_hint, o_orderpriority AS day_hint FROM orders"""

MINMAX = "CASE WHEN abs(max({0}) OVER w - min({0}) OVER w) <= 1e-9 * greatest(abs(max({0}) OVER w), abs(min({0}) OVER w)) THEN 0.5 ELSE ({0} - min({0}) OVER w) / nullif(max({0}) OVER w - min({0}) OVER w, 0) END"


@query("w01_minmax", PARTS, f"SELECT pos, round({MINMAX.format('focus')}, 6) AS focus_n, round({MINMAX.format('bright')}, 6) AS bright_n FROM {{source}} AS s WINDOW w AS (PARTITION BY grp)")
def w01(df):
    return df.select("pos", F.round(S.between_extremes(c("focus"), ["grp"]), 6).alias("focus_n"), F.round(S.between_extremes(c("bright"), ["grp"]), 6).alias("bright_n"))


def _scored(df):
    parts = {n: S.between_extremes(c(n), ["grp"]) for n in ("focus", "bright", "comp", "rare")}
    return df.select("grp", "pos", *[x.alias(n) for n, x in parts.items()]).withColumn("score", F.round(S.snap_score(c("focus"), c("bright"), c("comp"), c("rare")), 9))


N4 = ", ".join(f"{MINMAX.format(n)} AS {n}" for n in ("focus", "bright", "comp", "rare"))
SNAP_SCORES = f"SELECT grp, pos, round(0.30 * focus + 0.25 * (1 - abs(bright - 0.55)) + 0.25 * comp + 0.20 * rare, 9) AS score, focus, bright, comp, rare FROM (SELECT grp, pos, {N4} FROM {{source}} AS s WINDOW w AS (PARTITION BY grp)) AS n"
BUCKETS = f"""SELECT grp, pos, rank, round(score, 6) AS score, CASE WHEN rank > n - CASE WHEN n <= 1 THEN 0 ELSE least(greatest(1, CAST(round_even(n * 0.05, 0) AS INT)), n - 1) END THEN 'ng'
 WHEN rank <= {{best}} THEN 'final_selected' ELSE 'other_passing' END AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, pos) AS rank, count(*) OVER (PARTITION BY grp) AS n FROM ({SNAP_SCORES}) AS x) AS r"""


@query("snap_buckets", PARTS, BUCKETS.replace("{best}", "greatest(1, CAST(round_even(n * 0.30, 0) AS INT))"))
def snap_buckets(df):
    """P01, O02 to O05 and W01, W02 in one plan; the flagship."""
    return R.buckets(_scored(df), ["grp"], "score", "pos").select("grp", "pos", "rank", F.round("score", 6).alias("score"), "bucket")


@query("o03_buckets_with_count", PARTS, BUCKETS.replace("{best}", "10"))
def o03(df):
    return R.buckets(_scored(df), ["grp"], "score", "pos", 10).select("grp", "pos", "rank", F.round("score", 6).alias("score"), "bucket")


@query("p02_score_report", PARTS, f"SELECT pos, round(focus * 10, 2) AS technical, round((1 - abs(bright - 0.55)) * 10, 2) AS expression, round(comp * 10, 2) AS composition, round(rare * 10, 2) AS rarity, round(score * 10, 2) AS total FROM ({SNAP_SCORES}) AS x")
def p02(df):
    df = _scored(df)
    return df.select("pos", F.round(c("focus") * 10, 2).alias("technical"), F.round((1 - F.abs(c("bright") - 0.55)) * 10, 2).alias("expression"), F.round(c("comp") * 10, 2).alias("composition"), F.round(c("rare") * 10, 2).alias("rarity"), F.round(c("score") * 10, 2).alias("total"))


@query("o04_o05_counts", "SELECT DISTINCT CAST(o_custkey AS INT) AS n FROM orders", "SELECT n, CASE WHEN n < 1 THEN 0 ELSE greatest(1, CAST(round_even(n * 0.3, 0) AS INT)) END AS best, CASE WHEN n <= 1 THEN 0 ELSE least(greatest(1, CAST(round_even(n * 0.05, 0) AS INT)), n - 1) END AS ng FROM {source} AS s")
def o04(df):
    return df.select("n", S.recommended_best(c("n")).alias("best"), S.rejected_tail(c("n")).alias("ng"))


@query_of("p03_representative_quality", {"photos": PARTS}, """WITH s AS (SELECT *, comp * 1000 AS res FROM {photos}), q AS (SELECT quantile_cont(focus, 0.05) AS f5, quantile_cont(focus, 0.95) AS f95, quantile_cont(rare, 0.05) AS r5, quantile_cont(rare, 0.95) AS r95, quantile_cont(res, 0.05) AS z5, quantile_cont(res, 0.95) AS z95 FROM s)
 SELECT pos, round(0.48 * greatest(0, least(1, (focus - f5) / (f95 - f5))) + 0.22 * greatest(0, 1 - abs(bright * 4 - 128) / 128) + 0.15 * greatest(0, least(1, (rare - r5) / (r95 - r5))) + 0.15 * greatest(0, least(1, (res - z5) / (z95 - z5))) - CASE WHEN (pos % 9 + 1) / 4.0 > 2.5 OR (pos % 9 + 1) / 4.0 < 0.4 THEN 0.06 ELSE 0 END, 6) AS quality FROM s, q""")
def p03(photos):
    """P03 with A05: percentiles of the whole table, then arithmetic."""
    photos = photos.withColumn("res", c("comp") * 1000)
    df = photos
    for n in ("focus", "rare", "res"):
        df = df.join(F.broadcast(R.quantiles(photos, [], n, (0.05, 0.95)).withColumnRenamed("quantiles", f"q_{n}")), F.lit(True))  # one row
    n = {x: S.within_percentiles(c(x), c(f"q_{x}")[0], c(f"q_{x}")[1]) for x in ("focus", "rare", "res")}
    q = S.representative_quality(n["focus"], c("bright") * 4, n["rare"], n["res"], (c("pos") % 9 + 1).cast("double"), F.lit(4.0))
    return df.select("pos", F.round(q, 6).alias("quality"))


QUALITY = "0.30 * technical + 0.25 * expression + 0.25 * composition + 0.20 * rarity"
PENALTY = "0.15 * CAST(alike AS INT) + 0.10 * CAST(burst AS INT) + 0.20 * CAST(duplicate AS INT)"
TOTAL = f"CASE WHEN is_ng THEN 0.0 ELSE (0.80 * ({QUALITY}) + 0.15 * event_relevance + 0.05 * grade_relevance) * (1 - ({PENALTY})) END"


def _totals(df):
    quality, penalty = S.integrated_quality(c("technical"), c("expression"), c("composition"), c("rarity")), S.redundancy_penalty(c("alike"), c("duplicate"), c("burst"))
    return df.withColumn("quality", F.round(quality, 6)).withColumn("penalty", F.round(penalty, 6)).withColumn("total", F.round(S.integrated_total(quality, c("event_relevance"), c("grade_relevance"), penalty, c("is_ng")), 6))


@query("p04_integrated_total", EVALS, f"SELECT id, round({QUALITY}, 6) AS quality, round({PENALTY}, 6) AS penalty, round({TOTAL}, 6) AS total FROM {{source}} AS s")
def p04(df):
    return _totals(df).select("id", "quality", "penalty", "total")


@query("o06_selection_order", EVALS, f"SELECT id, row_number() OVER (PARTITION BY folder ORDER BY event_relevance DESC, grade_relevance DESC, round({TOTAL}, 6) DESC, path) AS place FROM {{source}} AS s WHERE NOT is_ng")
def o06(df):
    """O06 after F03."""
    return R.numbered(_totals(df).where("not is_ng"), ["folder"], [F.desc("event_relevance"), F.desc("grade_relevance"), F.desc("total"), "path"], "place").select("id", "place")


@query("f03_ng_split", EVALS, "SELECT folder, count(*) FILTER (WHERE is_ng) AS ng, count(*) FILTER (WHERE NOT is_ng) AS kept FROM {source} AS s GROUP BY folder")
def f03(df):
    return df.groupBy("folder").agg(F.count_if("is_ng").alias("ng"), F.count_if(~c("is_ng")).alias("kept"))


WEIGHTED = "formality * 0.30 + beauty * 0.25 + expression * 0.15 + emotion * 0.10 + people * 0.20"
CLUB_SCORE = f"round({WEIGHTED} - gesture - closed * 0.75, 3)"
CLUB_NG = "is_ng OR (eyes_closed AND closed > 0)"


def _club(df):
    weighted = S.club_weighted(*[c(x) for x in ("formality", "beauty", "expression", "emotion", "people")])
    return df.withColumn("score", S.club_score(weighted, c("gesture"), c("closed"))).withColumn("ng", S.club_rejected(c("is_ng"), c("eyes_closed"), c("closed")))


@query("w03_club_rank", CLUB, f"SELECT pos, {CLUB_SCORE} AS score, {CLUB_NG} AS ng, row_number() OVER (PARTITION BY club ORDER BY {CLUB_NG}, {CLUB_SCORE} DESC, pos) AS rank FROM {{source}} AS s")
def w03(df):
    """P05 and W03."""
    return R.numbered(_club(df), ["club"], ["ng", F.desc("score"), "pos"]).select("pos", "score", "ng", "rank")


@query("p06_fallback_evaluation", CLUB, "SELECT pos, greatest(0, 8 - closed) AS formality, least(10, greatest(1, CAST(people AS INT))) AS people_count, closed > 0 AS eyes_closed, CAST(people AS INT) = 0 AS is_ng, CASE WHEN CAST(people AS INT) = 0 THEN 'no face detected' ELSE '' END AS ng_reason FROM {source} AS s")
def p06(df):
    df = df.select("pos", S.fallback_evaluation(c("people").cast("int"), c("closed")).alias("e"))
    return df.select("pos", "e.formality", "e.people_count", "e.eyes_closed", "e.is_ng", "e.ng_reason")


HARD = " OR ".join(S.HARD_FLAGS)
RULES = "gesture * 0.7 + CAST(has_hand_gesture AS INT) * 2.0 + CAST(has_exaggerated_expression AS INT) * 1.5"


@query("p07_club_rank_strict", CLUB, f"SELECT pos, round({WEIGHTED} - ({RULES}), 6) AS total, row_number() OVER (PARTITION BY club ORDER BY round({WEIGHTED} - ({RULES}), 6) DESC, pos) AS rank FROM {{source}} AS s WHERE NOT (is_ng OR {HARD})")
def p07(df):
    """P07, F04 and W04."""
    weighted = S.club_weighted(*[c(x) for x in ("formality", "beauty", "expression", "emotion", "people")])
    total = weighted - S.rule_penalty(c("gesture"), c("has_hand_gesture"), c("has_exaggerated_expression"))
    df = df.where(~(c("is_ng") | S.any_flag())).withColumn("total", F.round(total, 6))
    return R.numbered(df, ["club"], [F.desc("total"), "pos"]).select("pos", "total", "rank")


@query("p08_club_rank_older", CLUB, f"SELECT pos, round(formality * 0.35 + beauty * 0.30 + expression * 0.20 + emotion * 0.15 - ({RULES}), 6) AS total FROM {{source}} AS s WHERE NOT (is_ng OR {' OR '.join(S.OLD_HARD_FLAGS)})")
def p08(df):
    total = S.club_weighted_old(*[c(x) for x in ("formality", "beauty", "expression", "emotion")]) - S.rule_penalty(c("gesture"), c("has_hand_gesture"), c("has_exaggerated_expression"))
    return df.where(~(c("is_ng") | S.any_flag(S.OLD_HARD_FLAGS))).select("pos", F.round(total, 6).alias("total"))


@query("f05_tiers", CLUB, f"SELECT pos, tier FROM (SELECT *, min(tier) OVER (PARTITION BY club, closed, formality) AS least FROM (SELECT *, CASE WHEN NOT (is_ng OR {HARD}) THEN 0 WHEN NOT is_ng THEN 1 ELSE 2 END AS tier FROM {{source}} AS s) AS t) AS u WHERE tier <= least")
def f05(df):
    return R.least_tier(df, ["club", "closed", "formality"], [~(c("is_ng") | S.any_flag()), ~c("is_ng")]).select("pos", "tier")


@query("p09_portrait_composite", CLUB, "SELECT pos, CASE WHEN is_ng THEN -1.0 ELSE round(0.50 * formality + 0.30 * beauty + 0.20 * expression, 4) END AS composite, CASE WHEN closed = 0 THEN round(people, 2) ELSE round(0.50 * formality + 0.30 * expression + 0.20 * beauty, 2) END AS model FROM {source} AS s")
def p09(df):
    """P09 and P11."""
    model = S.portrait_model_score(F.when(c("closed") > 0, c("formality")), c("expression"), c("beauty"), F.round("people", 2))
    return df.select("pos", S.portrait_composite(c("formality"), c("beauty"), c("expression"), c("is_ng")).alias("composite"), model.alias("model"))


@query("w05_portrait_rank", CLUB, "SELECT pos, row_number() OVER (PARTITION BY club ORDER BY is_ng, CASE WHEN NOT is_ng THEN -beauty END NULLS FIRST, pos) AS rank FROM {source} AS s")
def w05(df):
    return R.portrait_ranks(df, ["club"], "beauty", "is_ng", "pos").select("pos", "rank")


@query("w06_best_shot", CLUB, "SELECT club, closed, pos, is_ng FROM (SELECT *, row_number() OVER (PARTITION BY club, closed ORDER BY is_ng, beauty DESC, pos) AS n FROM {source} AS s) AS t WHERE n = 1")
def w06(df):
    return R.first_of(df, ["club", "closed"], ["is_ng", F.desc("beauty"), "pos"]).select("club", "closed", "pos", "is_ng")


@query("w07_backups", CLUB, "SELECT club, pos, n AS backup_rank FROM (SELECT *, row_number() OVER (PARTITION BY club ORDER BY beauty DESC, pos) AS n FROM {source} AS s) AS t WHERE n BETWEEN 2 AND 4")
def w07(df):
    return R.backups(df, ["club"], "beauty", "pos", 3).select("club", "pos", "backup_rank")


@query("w08_counters", CLUB, "SELECT pos, row_number() OVER (PARTITION BY club, closed ORDER BY file) AS n FROM {source} AS s")
def w08(df):
    return R.numbered(df, ["club", "closed"], ["file"], "n").select("pos", "n")


@query("w09_cluster_numbers", CLUB, "SELECT pos, number FROM (SELECT club, closed, row_number() OVER (PARTITION BY club ORDER BY min(pos), closed) AS number FROM {source} AS s GROUP BY club, closed) AS g JOIN {source} AS s USING (club, closed)")
def w09(df):
    return R.group_numbers(df, ["club"], "closed", "pos").select("pos", "number")


STREAM = "SELECT user_id AS usr, event_id AS id, ts, event_type AS kind, value FROM events"


@query("w11_islands", STREAM, "SELECT id, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY usr ORDER BY ts, id) AS island FROM (SELECT *, lag(ts) OVER (PARTITION BY usr ORDER BY ts, id) AS p FROM {source} AS s) AS t")
def w11(df):
    """Runs of a user's events at most four hours apart."""
    df = R.numbered(df, ["usr"], ["ts", "id"], "n")
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("usr").orderBy("n"))
    return R.islands(df, ["usr"], "n", F.timestamp_diff("MICROSECOND", before, c("ts")) <= 4 * 3600 * 1_000_000).select("id", "island")


@query("w12_chunks", STREAM, "SELECT id, CAST(floor((row_number() OVER (PARTITION BY usr ORDER BY id) - 1) / 7) AS INT) AS chunk FROM {source} AS s")
def w12(df):
    return R.chunks(df, ["usr"], "id", 7).select("id", "chunk")


@query("w13_sized_groups", STREAM, "SELECT id, CASE WHEN n <= 3 THEN 0 WHEN n <= 8 THEN 1 WHEN n <= 10 THEN 2 ELSE 3 END AS chunk FROM (SELECT id, row_number() OVER (PARTITION BY usr ORDER BY id) AS n FROM {source} AS s) AS t")
def w13(df):
    return R.sized_groups(df, ["usr"], "id", [3, 5, 2]).select("id", "chunk")


@query("w14_prompt_chunks", STREAM, "SELECT usr, chunk, count(*) AS rows, string_agg(kind, chr(10) ORDER BY id) AS text FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY usr ORDER BY id) - 1) / 18) AS INT) AS chunk FROM {source} AS s) AS t GROUP BY usr, chunk")
def w14(df):
    return R.chunk_texts(df, ["usr"], "id", "kind")


@query("w15_balanced_order", EVALS, "SELECT id, row_number() OVER (PARTITION BY folder ORDER BY r, n, class_hint) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY folder, class_hint ORDER BY technical DESC, path) AS r, count(*) OVER (PARTITION BY folder, class_hint) AS n FROM {source} AS s) AS t")
def w15(df):
    return R.balanced_order(df, ["folder"], "class_hint", "technical", "path").select("id", "pick")


@query("c08_last_number", "SELECT user_id AS usr, event_id AS id, CASE WHEN event_id % 3 = 0 THEN event_id END AS number FROM events", "SELECT id, last_value(number IGNORE NULLS) OVER (PARTITION BY usr ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM {source} AS s")
def c08(df):
    return R.last_known(df, ["usr"], "id", "number").select("id", "previous")


# --- aggregates ---

PHOTOS = "SELECT e.vec_id AS id, e.label AS grp, v.ts AS ts, v.event_id AS seq, e.embedding AS emb, v.value AS focus, v.user_id AS usr FROM embeddings e JOIN events v ON v.event_id = e.vec_id"


@query("a02_representative", PHOTOS, "SELECT grp, id FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY focus DESC, id) AS n FROM {source} AS s) AS t WHERE n = 1")
def a02(df):
    best = F.max_by("id", F.struct("focus", -c("id")))
    return df.groupBy("grp").agg(best.alias("id"))


@query("a03_representative_by_quality", PHOTOS, "SELECT grp, id FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY focus DESC, ts DESC NULLS LAST, id DESC) AS n FROM {source} AS s) AS t WHERE n = 1")
def a03(df):
    return df.groupBy("grp").agg(F.max_by("id", F.struct("focus", "ts", "id")).alias("id"))


@query("a04_centroids", PHOTOS, """WITH d AS (SELECT grp, i, avg(CAST(emb[i] AS DOUBLE)) AS m FROM {source} AS s, range(1, 65) AS r(i) GROUP BY grp, i), n AS (SELECT grp, sqrt(sum(m * m)) AS n FROM d GROUP BY grp)
 SELECT d.grp, i - 1 AS dim, round(m / (n + 1e-12), 6) AS x, lo, hi FROM d JOIN n ON d.grp = n.grp JOIN (SELECT grp, min(seq) AS lo, max(seq) AS hi FROM {source} AS s GROUP BY grp) AS g ON g.grp = d.grp""")
def a04(df):
    ends = df.groupBy("grp").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    rows = vectors.centroids(df, ["grp"]).join(ends, "grp")
    return rows.select("grp", "lo", "hi", F.posexplode("centroid").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("a06_rarity", PHOTOS, """WITH d AS (SELECT i, avg(CAST(emb[i] AS DOUBLE)) AS m FROM {source} AS s, range(1, 65) AS r(i) GROUP BY i), v AS (SELECT list(m ORDER BY i) AS c FROM d)
 SELECT id, round(1 - list_cosine_similarity(list_transform(emb, lambda x: CAST(x AS DOUBLE)), c), 6) AS rarity FROM {source} AS s, v""")
def a06(df):
    center = vectors.centroids(df.withColumn("all", F.lit(1)), ["all"]).drop("all")
    return df.join(F.broadcast(center), F.lit(True)).select("id", F.round(1 - vectors.cosine(c("emb"), c("centroid")), 6).alias("rarity"))  # one row


@query("a05_percentiles", PARTS, "SELECT grp, round(quantile_cont(focus, 0.05), 6) AS p5, round(quantile_cont(focus, 0.95), 6) AS p95 FROM {source} AS s GROUP BY grp")
def a05(df):
    q = c("quantiles")
    return R.quantiles(df, ["grp"], "focus", (0.05, 0.95)).select("grp", F.round(q[0], 6).alias("p5"), F.round(q[1], 6).alias("p95"))


@query("a07_snap_summary", PARTS, BUCKETS.replace("{best}", "greatest(1, CAST(round_even(n * 0.30, 0) AS INT))").join(["SELECT grp, count(*) AS representatives, count(*) FILTER (WHERE bucket = 'final_selected') AS best, count(*) FILTER (WHERE bucket = 'ng') AS ng, count(*) FILTER (WHERE bucket = 'other_passing') AS other, round(100 * (1 - count(*) / 100.0), 2) AS reduction_percent, round(1 - count(*) / 100.0, 4) AS reduction FROM (", ") AS b GROUP BY grp"]))
def a07(df):
    """The same reduction in percent and as a fraction (Q13)."""
    b = R.buckets(_scored(df), ["grp"], "score", "pos")
    counts = [F.count_if(c("bucket") == k).alias(n) for k, n in (("final_selected", "best"), ("ng", "ng"), ("other_passing", "other"))]
    kept = F.count("*") / F.lit(100.0)
    return b.groupBy("grp").agg(F.count("*").alias("representatives"), *counts, F.round(100 * (1 - kept), 2).alias("reduction_percent"), F.round(1 - kept, 4).alias("reduction"))


@query("a09_cluster_gallery", PHOTOS, "SELECT s.grp, count(*) AS size, max(CASE WHEN n = 1 THEN id END) AS representative, round(max(CASE WHEN n = 1 THEN focus END), 6) AS focus FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY focus DESC, id) AS n FROM {source} AS t) AS s GROUP BY s.grp")
def a09(df):
    top = F.max_by(F.struct("id", "focus"), F.struct("focus", -c("id")))
    return df.groupBy("grp").agg(F.count("*").alias("size"), top.alias("x")).select("grp", "size", c("x.id").alias("representative"), F.round("x.focus", 6).alias("focus"))


@query("a10_club_summary", CLUB, f"SELECT club, count(*) AS input, count(*) FILTER (WHERE NOT ng) AS ranked, count(*) FILTER (WHERE ng) AS ng, min_by(file, rank) AS best FROM (SELECT *, row_number() OVER (PARTITION BY club ORDER BY ng, score DESC, pos) AS rank FROM (SELECT club, pos, file, {CLUB_SCORE} AS score, {CLUB_NG} AS ng FROM {{source}} AS s) AS t) AS u GROUP BY club")
def a10(df):
    ranked = R.numbered(_club(df), ["club"], ["ng", F.desc("score"), "pos"])
    return ranked.groupBy("club").agg(F.count("*").alias("input"), F.count_if(~c("ng")).alias("ranked"), F.count_if("ng").alias("ng"), F.min_by("file", "rank").alias("best"))


@query("a11_eye_closure_totals", CLUB, "SELECT CAST(sum(people) AS BIGINT) AS faces, count(*) FILTER (WHERE closed > 0) AS closed_photos, CAST(sum(closed) AS BIGINT) AS closed_faces, round(100.0 * count(*) FILTER (WHERE closed > 0) / count(*), 2) AS closed_percent FROM {source} AS s")
def a11(df):
    return df.agg(F.sum("people").cast("long").alias("faces"), F.count_if(c("closed") > 0).alias("closed_photos"), F.sum("closed").alias("closed_faces"), F.round(F.lit(100.0) * F.count_if(c("closed") > 0) / F.count("*"), 2).alias("closed_percent"))


@query("a21_event_summary", EVALS, f"SELECT folder, count(*) AS photos, count(DISTINCT class_hint) AS classes, count(DISTINCT day_hint) AS days, count(*) FILTER (WHERE is_ng) AS ng, round(avg(round({TOTAL}, 6)), 2) AS mean_total, CASE WHEN count(DISTINCT class_hint) < 6 THEN 'few classes' ELSE '' END AS warning FROM {{source}} AS s GROUP BY folder")
def a21(df):
    warning = F.when(F.countDistinct("class_hint") < 6, "few classes").otherwise("")
    return _totals(df).groupBy("folder").agg(F.count("*").alias("photos"), F.countDistinct("class_hint").alias("classes"), F.countDistinct("day_hint").alias("days"), F.count_if("is_ng").alias("ng"), F.round(F.avg("total"), 2).alias("mean_total"), warning.alias("warning"))


@query("a22_bucket_counts", PARTS, BUCKETS.replace("{best}", "greatest(1, CAST(round_even(n * 0.30, 0) AS INT))").join(["SELECT grp, count(*) FILTER (WHERE bucket = 'final_selected') AS final_selected, count(*) FILTER (WHERE bucket = 'ng') AS ng, count(*) FILTER (WHERE bucket = 'other_passing') AS other_passing FROM (", ") AS b GROUP BY grp"]))
def a22(df):
    return R.buckets(_scored(df), ["grp"], "score", "pos").groupBy("grp").pivot("bucket", ["final_selected", "ng", "other_passing"]).count().na.fill(0)


@query("a23_means", EVALS, "SELECT round(avg(technical), 2) AS technical, round(avg(expression), 2) AS expression, round(avg(composition), 2) AS composition, round(avg(rarity), 2) AS rarity FROM {source} AS s")
def a23(df):
    return df.agg(*[F.round(F.avg(n), 2).alias(n) for n in ("technical", "expression", "composition", "rarity")])


@query("a26_class_sample", EVALS, "SELECT class_hint, folder, n FROM (SELECT class_hint, folder, count(*) AS n, row_number() OVER (PARTITION BY class_hint ORDER BY folder) AS r, dense_rank() OVER (ORDER BY class_hint) AS k FROM {source} AS s GROUP BY class_hint, folder) AS t WHERE r = 1 AND k <= 3")
def a26(df):
    groups = df.groupBy("class_hint", "folder").agg(F.count("*").alias("n"))
    return R.first_of(groups, ["class_hint"], ["folder"]).orderBy("class_hint").limit(3)


# --- faces and geometry ---

FACES = """SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity - 25 AS DOUBLE) AS pitch, CAST(l_partkey % 90 - 45 AS DOUBLE) AS yaw, CAST(l_suppkey % 80 - 40 AS DOUBLE) AS roll, l_discount * 4 AS left_ear, l_tax * 5 AS right_ear, (l_partkey % 300) * 1.0137717 AS sharp,
 (l_suppkey % 256) * 0.9971713 AS bright, l_tax * 9.8765432 AS gesture, CAST(l_partkey % 40 + 20 AS INT) AS w, CAST(l_suppkey % 50 + 25 AS INT) AS h, CAST(l_partkey % 200 AS INT) AS x FROM lineitem"""
CLIP = "greatest(0.0, least(1.0, {0}))"
POSE = f"least(1.0, CASE WHEN pitch > 18 THEN {CLIP.format('(pitch - 18) / 20')} WHEN pitch < -15 THEN {CLIP.format('(-pitch - 15) / 20')} * 0.5 ELSE 0 END + CASE WHEN abs(yaw) > 25 THEN {CLIP.format('(abs(yaw) - 25) / 25')} ELSE 0 END + CASE WHEN abs(roll) > 20 THEN {CLIP.format('(abs(roll) - 20) / 20')} * 0.6 ELSE 0 END)"
EYE = CLIP.format("(0.30 - (left_ear + right_ear) / 2) / 0.14")
FRONTAL = f"{CLIP.format('(w / CAST(h AS DOUBLE) - 0.45) / 0.45')} * 0.6 + {CLIP.format('1 - abs((x + w / 2.0) / 320.0 - 0.5) / 0.30')} * 0.4"


@query("p13_pose_penalty", FACES, f"SELECT id, round({POSE}, 6) AS pose, round({EYE}, 6) AS eye, round({FRONTAL}, 6) AS frontal, (left_ear <= 0.24 OR right_ear <= 0.24) AS closed FROM {{source}} AS s")
def p13(df):
    """P12, P13, P14 and F11."""
    box = F.struct(c("x"), F.lit(0).alias("y"), c("w"), c("h"))
    return df.select("id", F.round(S.pose_penalty(c("pitch"), c("yaw"), c("roll")), 6).alias("pose"), F.round(S.eye_penalty(c("left_ear"), c("right_ear")), 6).alias("eye"), F.round(S.frontal_score(box, F.lit(320.0)), 6).alias("frontal"), S.eyes_closed(c("left_ear"), c("right_ear")).alias("closed"))


@query("p10_portrait_local", FACES, f"SELECT id, round((0.9 * 10 * 0.10 + (1 - {POSE}) * 10 * 0.30 + (1 - {EYE}) * 10 * 0.30 + least(sharp / 200, 1.0) * 10 * 0.15 + (1 - abs(bright - 140) / 140) * 10 * 0.15) * (1 - gesture * 0.80), 2) AS score, round((least(sharp / 200, 1.0) * 10 * 0.25 + (1 - abs(bright - 140) / 140) * 10 * 0.20 + least(0.05 / 0.08, 1.0) * 10 * 0.20 + ({FRONTAL}) * 10 * 0.35) * (1 - gesture * 0.80), 2) AS fallback FROM {{source}} AS s")
def p10(df):
    pose, eye = S.pose_penalty(c("pitch"), c("yaw"), c("roll")), S.eye_penalty(c("left_ear"), c("right_ear"))
    frontal = S.frontal_score(F.struct(c("x"), F.lit(0).alias("y"), c("w"), c("h")), F.lit(320.0))
    full = S.portrait_local(F.lit(0.9), pose, eye, c("sharp"), c("bright"), c("gesture"))
    return df.select("id", full.alias("score"), S.portrait_fallback(c("sharp"), c("bright"), F.lit(0.05), frontal, c("gesture")).alias("fallback"))


@query("x06_eye_ratio", FACES, "SELECT id, CASE WHEN w - 20 < 1 THEN NULL ELSE round((h - 24) / CAST(w - 20 AS DOUBLE), 4) END AS ratio, CASE WHEN w - 20 < 1 THEN 0.0 ELSE round((h - 24) / CAST(w - 20 AS DOUBLE), 6) END AS plain FROM {source} AS s")
def x06(df):
    """X06 and X07 over a landmark array whose eye points span w - 20 by h - 24."""
    def point(i):
        return F.struct((F.when(F.lit(i == 35), c("w") - 20).otherwise(0)).cast("double").alias("x"), (F.when(F.lit(i == 36), c("h") - 24).otherwise(0)).cast("double").alias("y"))

    df = df.withColumn("lmk", F.array(*[point(i) for i in range(43)]))
    return df.select("id", S.eye_ratio_or_null(c("lmk"), *S.LEFT_EYE).alias("ratio"), F.round(S.eye_ratio(c("lmk"), *S.LEFT_EYE), 6).alias("plain"))


@query("p15_exposure_orientation", FACES, "SELECT id, round(greatest(0.0, 1 - abs(bright - 128) / 128), 6) AS exposure, CASE WHEN w > h THEN 'horizontal' WHEN w < h THEN 'vertical' ELSE 'square' END AS shape FROM {source} AS s")
def p15(df):
    """P15 and P16."""
    return df.select("id", F.round(S.exposure_balance(c("bright")), 6).alias("exposure"), S.orientation(c("w"), c("h")).alias("shape"))


FIT = """WITH s AS (SELECT id, w * 10.0 AS iw, h * 10.0 AS ih, 36.0 AS fw, 44.0 AS fh, 0.3 + (x % 40) / 97.3171 AS cx, 0.5 + (x % 30) / 93.7177 AS chin, 0.1 + (x % 20) / 100.0 AS eyes FROM {source} AS t),
 f AS (SELECT *, CASE WHEN iw / ih > fw / fh THEN fh * (iw / ih) ELSE fw END AS gw, CASE WHEN iw / ih > fw / fh THEN fh ELSE fw / (iw / ih) END AS gh FROM s),
 g AS (SELECT *, (fw - gw) / 2 AS ox, (fh - gh) / 2 AS oy, greatest(125.0, least(145.0, 0.22 * fw / (eyes * gw) * 100)) AS sc FROM f) """


@query("p19_placement", FACES, FIT + "SELECT id, round(gw, 4) AS fit_w, round(oy, 4) AS fit_y, round(0.5 * fw - (fw / 2 + (ox + cx * gw - fw / 2) * sc / 100), 2) AS offset_x, round(0.86 * fh - (fh / 2 + (oy + chin * gh - fh / 2) * sc / 100), 2) AS offset_y, round(sc, 1) AS scale FROM g")
def p19(df):
    """P18 and P19."""
    share = lambda low, k, by: F.lit(low) + (c("x") % k) / F.lit(by)
    face = {"image_w": c("w") * 10.0, "image_h": c("h") * 10.0, "center_x": share(0.3, 40, 97.3171), "chin_y": share(0.5, 30, 93.7177), "eye_dist": share(0.1, 20, 100.0)}
    fit = S.filled(face["image_w"], face["image_h"], F.lit(36.0), F.lit(44.0))
    p = S.placement(face, F.lit(36.0), F.lit(44.0), F.lit(0.86), F.lit(0.22), 125.0, 145.0)
    return df.select("id", F.round(fit["w"], 4).alias("fit_w"), F.round(fit["y"], 4).alias("fit_y"), p["offset_x"].alias("offset_x"), p["offset_y"].alias("offset_y"), p["scale"].alias("scale"))


@query("p17_target_params", FACES, "SELECT id, greatest(0.16, least(0.32, round((0.9 - w / 100.0) * 44 * 0.55 / 36, 3))) AS eyes FROM {source} AS s")
def p17(df):
    return df.select("id", S.target_eye_distance(c("w") / F.lit(100.0), F.lit(0.9), F.lit(36.0), F.lit(44.0)).alias("eyes"))


@query("f19_final_name", CLUB, "SELECT pos, CASE pos % 3 WHEN 0 THEN NULL WHEN 1 THEN 'card' ELSE CASE WHEN beauty / 10 >= 0.9 THEN 'roster' ELSE 'card' END END AS name, CASE pos % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'card' ELSE CASE WHEN beauty / 10 >= 0.9 THEN 'roster' ELSE 'card' END END AS source FROM {source} AS s")
def f19(df):
    method = F.when(c("pos") % 3 == 0, "none").when(c("pos") % 3 == 1, "exact").otherwise("fuzzy")
    return df.select("pos", S.final_name(method, c("beauty") / 10, F.lit("roster"), F.lit("card")).alias("x")).select("pos", "x.name", "x.source")


@query("f25_rank_input", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'exclude' WHEN 1 THEN concat(' ', CAST(o_orderkey % 999 + 1 AS STRING)) WHEN 2 THEN NULL ELSE '7' END AS raw FROM orders", "SELECT id, CASE id % 4 WHEN 1 THEN CAST(id % 999 + 1 AS INT) WHEN 3 THEN 7 END AS rank FROM {source} AS s")
def f25(df):
    return df.select("id", S.final_rank(c("raw")).alias("rank"))
