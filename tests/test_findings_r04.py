"""What the findings of the fourth round named."""

import math
import random
import re

from pyspark.sql import functions as F

from shutterloom.functions import vectors
from shutterloom.operators import relational, staff
from shutterloom.plans import fold_queries, ranking_queries, relational_queries, report_queries, scalar_queries, table_queries  # noqa: F401
from shutterloom.plans.registry import QUERIES


def test_pairs_of_odd_vectors_meet_as_matrices(spark):
    draw = random.Random(6)
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0], [3.0, 4.0]]
    photos = [(draw.choice(("a", "b", None)), draw.choice((f"k{k}", f"k{k}", f"k{k // 2}", None)), odd[k // 3 % 8] if k % 3 == 0 else [draw.random() - 0.5 for _ in range(3)]) for k in range(150)]
    df = spark.createDataFrame(photos, "grp string, id string, emb array<double>")
    a, b = (df.select("grp", *[F.col(n).alias(f"{side}_{n}") for n in ("id", "emb")]) for side in "ab")
    wanted = a.join(b, "grp").where("a_id < b_id").select("grp", "a_id", "b_id", vectors.cosine(F.col("a_emb"), F.col("b_emb")).alias("cosine"))
    form = lambda rows: sorted((r[0], r[1], r[2], "null" if r[3] is None else str(round(r[3], 9) + 0.0)) for r in rows)
    for block in (4, 2_048):
        got = relational.pairs_of(df, "grp", "id", "emb", block)
        assert form(got.collect()) == form(wanted.collect())
    assert any(r.cosine is not None and math.isnan(r.cosine) for r in wanted.collect())


def test_cosines_of_a_group_are_no_join_of_rows(spark, sf):
    text = QUERIES["x04_cosine"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in text and "FlatMapGroupsInArrow" in text


def test_pairs_near_in_time_meet_as_matrices(spark, monkeypatch):
    import datetime

    draw, start = random.Random(8), datetime.datetime(2024, 5, 1)
    odd = [None, [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], [float("nan"), 1.0, 0.0]]
    photos = [(k, draw.choice("ab"), start + datetime.timedelta(seconds=draw.randrange(2_000)) if k % 7 else None, draw.randrange(200) if k % 5 else None, odd[k // 9 % 5] if k % 9 == 0 else [draw.random() - 0.5 for _ in range(3)]) for k in range(220)]
    df = spark.createDataFrame(photos, "id long, grp string, ts timestamp_ntz, seq long, emb array<float>")
    rules = ((0.6, 400, 20), (0.2, 100, 5), (-0.5, 0, None))
    a, b = (df.select("grp", *[F.col(n).alias(f"{side}_{n}") for n in ("id", "ts", "seq", "emb")]) for side in "ab")
    cosine, gap, apart = vectors.cosine(F.col("a_emb"), F.col("b_emb")), F.abs(F.timestamp_diff("SECOND", F.col("a_ts"), F.col("b_ts"))), F.abs(F.col("a_seq") - F.col("b_seq"))
    wanted = F.lit(False)
    for least, within, steps in rules:
        wanted = wanted | ((cosine >= least) & (F.coalesce(gap <= within, F.lit(False)) | (F.coalesce(apart <= steps, F.lit(False)) if steps is not None else F.lit(False))))
    wanted = sorted(map(tuple, a.join(b, "grp").where("a_id < b_id").where(wanted).select("a_id", "b_id").collect()))
    for block in (2_048, 8):
        monkeypatch.setattr(relational.vector_blocks, "BLOCK", block)
        got = relational.similar_pairs(df, "grp", rules)
        assert sorted((r.a_id, r.b_id) for r in got.collect()) == wanted and len(wanted) > 300
        assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert any(odd[k // 9 % 5] and k % 9 == 0 for pair in wanted for k in pair)


def test_cards_meet_staff_without_passing_the_driver(spark, sf, monkeypatch):
    plans, written = [], staff.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(staff, "written", lambda df, name: (plans.append(plan(df)), written(df, name))[1])
    plans.append(plan(QUERIES["j04_card_matches"](spark, sf)))
    joins = [line for text in plans for line in text.splitlines() if "Join" in line]
    assert len(joins) > 5
    # The numbers of lists of a school, one row for each school, are all that is sent to every machine.
    sent = [line for line in joins if "Broadcast" in line]
    assert all(re.search(r"BroadcastHashJoin \[school#\d+\], \[school#\d+\],", line) for line in sent), sent


def parts_of(spark, folder):
    """A table of parts whose frames hold guides."""
    draw = random.Random(9)
    rows = [(k, f"Brand#{k % 2}", draw.randrange(9_000, 14_000) / 10, draw.randrange(1, 50)) for k in range(120)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_retailprice double, p_size int").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_every_frame_of_the_table_meets_guides(spark, tmp_path):
    sf = parts_of(spark, tmp_path)
    parts = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS frame", "p_brand AS page", "p_retailprice / 10 AS y", "p_retailprice / 10 + 3.3 AS top", "p_retailprice / 10 + 3.3 + p_size AS bottom").collect()
    wanted = {}
    for f in parts:
        inside = [g.y - f.top for g in parts if g.page == f.page and f.top + 0.5 < g.y < f.bottom - 0.5]
        if inside:
            wanted[f.frame] = len(inside), round(min(inside), 3), round(max(inside), 3)
    got = {r.frame: (r.n, round(r.first_guide, 3), round(r.last_guide, 3)) for r in QUERIES["j12_guides_in_frames"](spark, sf).collect()}
    assert got.keys() == wanted.keys() and any(k % 5 for k in wanted)
    assert all(got[k][0] == wanted[k][0] and abs(got[k][1] - wanted[k][1]) < 2e-3 and abs(got[k][2] - wanted[k][2]) < 2e-3 for k in wanted)


def test_every_frame_of_the_table_has_ratios(spark, tmp_path):
    rows = QUERIES["p22_guide_ratios"](spark, parts_of(spark, tmp_path)).collect()
    assert sorted(r.frame for r in rows) == list(range(120))
    assert any(r.frame % 5 and r.top_ratio is not None for r in rows)
