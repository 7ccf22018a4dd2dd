"""Percentiles and numbers over whole tables, searches in blocks, and workbooks."""

import random
import zipfile
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shutterloom.functions import scalars, tables
from shutterloom.operators import clustering, ranking, relational, reports
from shutterloom.sources import sinks, workbooks


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_percentiles_equal_numpy(spark, accuracy):
    rng = random.Random(3)
    rows = [("big", float(rng.randint(0, 400))) for _ in range(3000)] + [("flat", 7.0)] * 900 + [("one", 2.5)] + [("two", 1.0), ("two", None), ("two", 4.0)] + [(None, 9.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {r.g: r.quantiles for r in ranking.quantiles(df.where("g is not null"), ["g"], "v", shares, accuracy).collect()}
    for g in ("big", "flat", "one", "two"):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], shares))
    (whole,) = ranking.quantiles(df, [], "v", shares, accuracy).collect()
    assert np.allclose(whole.quantiles, np.quantile([v for _, v in rows if v is not None], shares))


def test_numbers_over_the_whole_table(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["", "a", "ab", "éa", "a" * 30, "a" * 29 + "b", "zz%d" % rng.randrange(40)]), rng.randrange(3)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, name string, kind int").repartition(6)
    got = ranking.numbered_in_all(df, ["kind", "name", "id"], ranking.text_lead(F.col("name"), F.col("kind")), "place", 9)
    assert got.columns == ["id", "name", "kind", "place"]
    wanted = sorted(rows, key=lambda r: (r[2], r[1].encode(), r[0]))
    assert [r.id for r in got.orderBy("place").collect()] == [r[0] for r in wanted]
    assert [r.place for r in got.orderBy("place").collect()] == list(range(1, 701))


def test_searches_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 6))
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    index = spark.createDataFrame(rows, "id long, emb array<double>")
    asked = spark.createDataFrame(rows[:25], "query long, query_emb array<double>")
    anchors = spark.createDataFrame([(i, i, e) for i, e in rows[:25]], "anchor long, pos long, anchor_emb array<double>")
    whole = sorted(map(tuple, relational.top_similar(index, asked, 3).select("query", "id", "rank").collect()))
    best = sorted((r.id, r.anchor, round(r.score, 9)) for r in relational.best_anchor(index, anchors, -9.0).collect())
    monkeypatch.setattr(relational, "blocks", lambda df, key, real=relational.blocks: real(df, key, 4))
    assert len(relational.blocks(asked, "query")) > 3
    assert sorted(map(tuple, relational.top_similar(index, asked, 3).select("query", "id", "rank").collect())) == whole
    assert sorted((r.id, r.anchor, round(r.score, 9)) for r in relational.best_anchor(index, anchors, -9.0).collect()) == best
    assert [b[1] for b in best] == (x @ x[:25].T).argmax(1).tolist()


@given(st.integers(0, 10**6), st.booleans())
@settings(max_examples=30, deadline=None)
def test_best_fit_equals_the_plain_loop(seed, unknown):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    base = rng.normal(size=(4, 5))
    emb = base[rng.integers(0, 4, n)] + rng.normal(size=(n, 5)) * rng.choice([0.05, 0.4])
    seconds, steps = np.round(rng.random(n) * 600), rng.integers(0, 60, n).astype(float)
    seconds[rng.random(n) < 0.2] = np.nan
    shape, quality = rng.choice(["h", "v"], n).tolist(), [(float(q),) for q in rng.random(n)]
    got = clustering.best_fit(emb, seconds, steps, shape, quality, unknown)
    clusters: list[list[int]] = []
    unit = emb / np.linalg.norm(emb, axis=1, keepdims=True)
    for i in range(n):
        best = None
        for k, own in enumerate(clusters):
            rep = max(own, key=lambda j: (quality[j], -j))
            center = emb[own].mean(0)
            score = max(center @ unit[i] / np.linalg.norm(center), unit[rep] @ unit[i])
            known = [seconds[j] for j in own if not np.isnan(seconds[j])]
            to_rep = abs(seconds[rep] - seconds[i])
            gaps = [abs(t - seconds[i]) for t in (min(known), max(known))] if known and not np.isnan(seconds[i]) else []
            gaps += [] if np.isnan(to_rep) or (unknown and to_rep == 0) else [to_rep]
            jump = min(abs(s - steps[i]) for s in (steps[rep], min(steps[own]), max(steps[own])))
            gap = min(gaps, default=np.inf)
            strict, wide, narrow = clustering.INTEGRATED
            near = lambda limit: gap <= limit or jump <= clustering.STEPS  # noqa: B023, E731
            rule = "strict" if score >= strict else "relaxed" if score >= wide and near(clustering.WIDE_SECONDS) else "relaxed_near" if score >= narrow and (near(clustering.NARROW_SECONDS) or shape[i] != shape[rep]) else None
            if rule and (best is None or score > best[1]):
                best = (k, score, rule)
        if best is None:
            best = (len(clusters), 1.0, "new_cluster")
            clusters.append([])
        clusters[best[0]].append(i)
        assert (got[i][0], got[i][2]) == (best[0], best[2]) and got[i][1] == pytest.approx(best[1])


def test_a_workbook_reads_back_whatever_it_holds(spark, tmp_path):
    rows = [(1, "a <&> \"b\"\n　", 1.5, True, ["x", "y"], date(2024, 5, 1)), (2, None, None, None, None, None), (3, "\x07bell", float("nan"), False, [], None)]
    df = spark.createDataFrame(rows, "n int, t string, d double, b boolean, l array<string>, day date").orderBy("n")
    path = str(tmp_path / "out" / "book.xlsx")
    names = workbooks.write_workbook({"a/b": df, "A b": df.limit(0), "": df.select("n")}, path, 3)
    assert names == ["a b", "a b (2)", "A b (3)", "Sheet", "Sheet (2)"]
    got = {(r.sheet, r.row, r.col): r.value for r in workbooks.read_cells(spark, str(tmp_path / "out")).collect()}
    assert [got["a b", 1, k] for k in range(1, 7)] == ["n", "t", "d", "b", "l", "day"]
    assert [got["a b", 2, k] for k in range(1, 7)] == ["1", 'a <&> "b"\n　', "1.5", "true", "x, y", "2024-05-01"]
    assert got["a b", 3, 1] == "2" and ("a b", 3, 2) not in got
    assert got["a b (2)", 2, 2] == "bell" and got["a b (2)", 1, 1] == "n"
    assert [k for k in got if k[0] == "A b (3)"] == [("A b (3)", 1, c) for c in range(1, 7)]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and "[Content_Types].xml" in z.namelist()
    (tmp_path / "out" / "broken.xlsx").write_bytes(b"no zip")
    assert workbooks.read_cells(spark, str(tmp_path / "out")).select("file").distinct().count() == 1


def test_columns_of_sheets():
    for k in (1, 26, 27, 52, 703, 16384):
        assert workbooks.column_number(workbooks.column_name(k)) == k
    assert [workbooks.column_name(k) for k in (1, 26, 27)] == ["A", "Z", "AA"]


def test_an_event_report_has_its_sheets_and_words(spark):
    photos = spark.createDataFrame([("a.jpg", "final_selected", 9.0), ("b.jpg", "ng", 1.0), ("c.jpg", "other_passing", 4.0)], "file string, bucket string, total double")
    photos = photos.select("*", *[F.lit(1.0).alias(n) for n in ("technical", "expression", "composition", "rarity")], F.lit(3).alias("cluster"), F.lit("t").alias("taken"))
    sheets = reports.event_report(photos, 4, 3, 1)
    assert list(sheets) == ["ベストショット一覧", "NG写真一覧", "未選定写真一覧", "統計サマリー"]
    assert sheets["ベストショット一覧"].columns == ["ファイル名", "区分", "総合スコア", "技術スコア", "表情/明るさスコア", "構図スコア", "希少性スコア", "類似グループID", "撮影日時", "コメント", "選定理由"]
    assert sheets["ベストショット一覧"].first()["コメント"] == "総合評価が高く、ベストショット候補として選定されました。"
    stats = {r["項目"]: r["値"] for r in sheets["統計サマリー"].collect()}
    assert (stats["代表候補数"], stats["重複削減率"], stats["ベストショット指定数"], stats["NG写真数"]) == ("3", "0.25", "1", "1")
    counts = reports.event_counts(photos.withColumn("event", F.when(F.col("file") != "c.jpg", "trip")))
    assert [tuple(r) for r in counts.collect()] == [("trip", 1, 1, 0)]


def test_display_names():
    assert scalars.header("Original Filename") == "元ファイル名" and scalars.header("Card Name (OCR)") == "札氏名（OCR）"
    assert scalars.header("Match Results") == tables.STAFF_SHEETS["Match Results"] == "照合結果"
    assert scalars.header("detection_layer") == "検出レイヤー" and scalars.header("eyes closed") == "目つぶり"


def test_versions_of_two_writers(spark, tmp_path):
    df = spark.range(3)
    assert sinks.write_version({"t": df}, str(tmp_path)).endswith("/v1")
    assert sinks.write_version({"t": df.limit(1)}, str(tmp_path)).endswith("/v2")
    assert sinks.read_latest(spark, str(tmp_path), "t").count() == 1
