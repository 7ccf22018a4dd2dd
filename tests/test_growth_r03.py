"""Findings of the third round about growth: the whole job by other ways, equal to plain loops."""

import random

from pyspark.sql import functions as F

from shutterloom.operators import clustering, geometry, relational


def test_ends_of_bands_without_pairs(spark):
    draw = random.Random(3)
    points = [(draw.choice("ab"), float(draw.randrange(40))) for _ in range(200)] + [("a", None), (None, 3.0)]
    bands = [(draw.choice("abc"), float(low), float(low + draw.randrange(-1, 9))) for low in [draw.randrange(-5, 45) for _ in range(150)]]
    got = relational.ends_within(spark.createDataFrame(points, "p string, y double"), spark.createDataFrame(bands, "p string, low double, high double"), ["p"], "y", "low", "high")
    wanted = set()
    for p, low, high in bands:
        inside = [y for q, y in points if p == q and y is not None and low < y < high]
        if inside:
            wanted.add((p, low, high, len(inside), min(inside), max(inside)))
    rows = [tuple(r) for r in got.select("p", "low", "high", "n", "first", "last").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted
    # No join of places with bands is left that grows with the points of a band.
    assert not any(word in got._jdf.queryExecution().optimizedPlan().toString() for word in ("explode(sequence", "Cartesian"))


def test_bands_of_equal_guides_meet_once(spark):
    draw = random.Random(4)
    frames = [("a", k, top, top + 44.0) for k, top in enumerate(round(draw.randrange(0, 900) / 10, 1) for _ in range(60))]
    guides = [("a", round(draw.randrange(0, 1400) / 10, 1)) for _ in range(50)] * 3
    f, g = spark.createDataFrame(frames, "page string, frame long, top double, bottom double"), spark.createDataFrame(guides, "page string, y double")
    found = geometry.canonical_offsets(f, g, "page")
    tops, lower = [], []
    for _, _, top, bottom in frames:
        inside = [y for _, y in guides if top + 0.5 < y < bottom - 0.5]
        tops += [y - top for y in inside if y == min(inside)]
        lower += [y - top for y in inside if y > min(inside) + 5]
    row = found.first()
    assert (row.top_offset, row.bottom_offset) == (clustering.modal_bin(tops, 1.5)[0], clustering.modal_bin(lower, 1.5)[0])
    # Ten times the frames and guides are ten times as heavy, at no more places.
    many = lambda df: df.crossJoin(spark.range(10).select(F.col("id").alias("copy")))
    more = geometry.canonical_offsets(many(f).withColumn("frame", F.col("frame") * 10 + F.col("copy")).drop("copy"), many(g).drop("copy"), "page")
    assert more.first() == row
    ratios = {r.frame: (r.top_ratio, r.bottom_ratio) for r in geometry.guide_ratios(f, g, found, "page").collect()}
    for _, k, top, bottom in frames:
        near = [min((abs(y - t), y) for _, y in guides)[1] if min(abs(y - t) for _, y in guides) <= geometry.REACH else None for t in (top + row.top_offset, top + row.bottom_offset)]
        wanted = tuple(round((y - top) / 44.0, 4) for y in near) if None not in near else (None, None)
        assert all(a == b or abs(a - b) < 2e-4 for a, b in zip(ratios[k], wanted, strict=True))
    taken = {t for _, _, top, _ in frames for t in (top + row.top_offset, top + row.bottom_offset)}
    own = [y for _, y in guides if not any(abs(y - t) < 1.5 + 1e-9 for t in taken)]
    assert sorted(r.y for r in geometry.own_guides(g, f, found, "page").collect()) == sorted(own)


def test_values_that_stand_for_many(spark):
    rows = spark.createDataFrame([("a", 1.0, 5), ("a", 1.4, 1), ("a", 9.0, 4), ("a", 9.3, 1), ("b", 2.0, 1)], "g string, v double, times long")
    assert {tuple(r) for r in clustering.modal_values(rows, "g", "v", rows_of="times").collect()} == {("a", 1.1, 6), ("b", 2.0, 1)}


def test_pairs_near_in_time_without_a_shuffle_of_pairs(spark):
    import datetime

    draw, start = random.Random(5), datetime.datetime(2024, 5, 1)
    photos = [(k, draw.choice("ab"), start + datetime.timedelta(seconds=draw.randrange(9000)) if draw.random() < 0.9 else None, k if draw.random() < 0.9 else None, [draw.random() - 0.5 for _ in range(4)]) for k in range(120)]
    rules = ((0.5, 1200, 8), (0.1, 300, None))
    df = spark.createDataFrame(photos, "id long, grp string, ts timestamp, seq long, emb array<double>")
    got = relational.similar_pairs(df, "grp", rules)
    wanted = set()
    for i, g, t, s, x in photos:
        for j, h, u, z, y in photos:
            if i < j and g == h:
                cosine = sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5)
                seconds = None if t is None or u is None else abs((t - u).total_seconds())
                steps = None if s is None or z is None else abs(s - z)
                if any(cosine >= least and ((seconds is not None and seconds <= within) or (apart is not None and steps is not None and steps <= apart)) for least, within, apart in rules):
                    wanted.add((i, j))
    rows = [(r.a_id, r.b_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted and len(wanted) > 50
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_order_of_a_report_rounds_as_its_sql(spark, monkeypatch):
    from shutterloom.plans import report_queries

    # The shortest decimals of these doubles are ties of four places; scaled, they lie just below.
    rows = spark.createDataFrame([("a", 1, 0.00015), ("a", 2, 0.00145), ("a", 3, 0.00465)], "grp string, pos long, score double").withColumns({n: F.lit(0.5) for n in ("focus", "bright", "comp", "rare")})
    monkeypatch.setattr(report_queries, "_scored", lambda df: rows)
    got = {r.file: r.total for r in report_queries._photos(rows).collect()}
    wanted = {f"IMG_{k}.jpg": int(abs(x) * 10000 + 0.5) / 10000 for k, x in ((1, 0.00015), (2, 0.00145), (3, 0.00465))}
    assert got == wanted and any(wanted[f"IMG_{r.pos}.jpg"] != r.old for r in rows.select("pos", F.round("score", 4).alias("old")).collect())


def test_sheets_that_go_on_are_read_as_one(spark, tmp_path):
    from shutterloom.sources import workbooks

    df = spark.range(0, 23, numPartitions=3).select(F.concat(F.lit("f"), "id").alias("file"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("n"), F.lit("z").alias("z")).orderBy("n", "file")
    path = str(tmp_path / "book.xlsx")
    parts = workbooks.write_sheets({"a": df, "a (2)": df.limit(2)}, path, 6)
    assert parts == {"a": ["a", "a (2)", "a (3)", "a (4)", "a (5)"], "a (2)": ["a (2) (2)"]}
    got = workbooks.as_table(workbooks.read_back(spark, path, {"a": parts["a"]}, 6), "a", ["file", "n", "z"]).orderBy("row").collect()
    assert [(r.row, r.file, r.n, r.z) for r in got] == [(k, r.file, None if r.n is None else str(r.n), r.z) for k, r in enumerate(df.collect(), 2)]
    assert {r.sheet for r in workbooks.read_cells(spark, path, ["a (3)"]).collect()} == {"a (3)"}


def test_equal_pictures_are_looked_at_once(spark):
    import numpy as np

    from shutterloom.functions import pixels

    def picture(x, y, w):
        out = np.full((80, 120, 3), 20, np.uint8)
        out[y : y + 16, x : x + w] = 255
        return out

    shapes = [(20, 40, 40), (20, 40, 40), (5, 40, 40), (20, 8, 40)]
    rows = [(k, 80, 120, bytearray(picture(*s).tobytes())) for k, s in enumerate(shapes)] + [(4, 80, 120, bytearray(80 * 120 * 3)), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id long, height int, width int, rgb binary").coalesce(1)
    got = {r.id: (r.found, r.x1, r.y1, r.x2, r.y2) for r in pixels.cards(df, placard=False).collect()}
    assert got == {0: (True, 8, 28, 72, 68), 1: (True, 8, 28, 72, 68)} | {k: (False, None, None, None, None) for k in (2, 3, 4)} | {5: (None,) * 5}
    assert [r.placard for r in pixels.cards(df).orderBy("id").collect()] == [pixels.has_placard(picture(*s)) for s in shapes] + [False, None]


def test_lists_of_keys_meet_without_grams(spark, monkeypatch):
    from difflib import SequenceMatcher

    from shutterloom.operators import fuzzy

    monkeypatch.setattr(fuzzy, "KEYS_AT_ONCE", 7)
    draw = random.Random(6)
    sides = [[(draw.choice("xy"), "".join(draw.choice("abcé") for _ in range(draw.randrange(0, 9)))) for _ in range(60)] for _ in "ab"]
    left, right = (spark.createDataFrame(s, "school string, key string") for s in sides)
    true = {(s, a, b): SequenceMatcher(None, a, b).ratio() for s, a in sides[0] for t, b in sides[1] if s == t and a and b}
    got = [tuple(r) for r in fuzzy.similar_keys(left, right, 0.6).select("school", "a", "b", "similarity").collect()]
    assert len(got) == len({g[:3] for g in got}) and {g[:3]: g[3] for g in got} == {k: v for k, v in true.items() if v >= 0.6}
    near = {(r.school, r.a, r.b): r.similarity for r in fuzzy.nearest_keys(left, right, 3, 0.3).collect()}
    for s, a in {k[:2] for k in true}:
        mine = {k: v for k, v in true.items() if k[:2] == (s, a) and v >= 0.3}
        least = sorted(mine.values(), reverse=True)[2] if len(mine) > 2 else 0.3
        assert {k: v for k, v in near.items() if k[:2] == (s, a) and v >= least} == {k: v for k, v in mine.items() if v >= least}
    # Two lists meet in one row, however many letters their keys have in common.
    assert "explode" not in fuzzy.similar_keys(left, right, 0.6)._jdf.queryExecution().optimizedPlan().toString()


def test_ratios_and_their_bounds_are_those_of_difflib():
    from difflib import SequenceMatcher

    import numpy as np

    from shutterloom.functions import names
    from shutterloom.operators import fuzzy

    draw = random.Random(8)
    for letters, most in (("ab", 12), ("abcdé", 70), ("ab0123456789", 150)):
        keys = ["".join(draw.choice(letters) for _ in range(draw.randrange(0, most))) for _ in range(40)]
        table = fuzzy.KeyTable(keys[20:])
        table.put(3, "b" * 5 + "a")
        true = np.array([[SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for b in table.keys] for a in keys[:20]])
        assert [[names.ratio_of(a, b) for b in table.keys] for a in keys[:20]] == true.tolist()
        bounds = table.bounds(keys[:20])
        assert (bounds >= true).all() and (bounds < 1).any()


def test_pairs_of_nearest_keys_are_scored_best_first(spark, monkeypatch):
    from shutterloom.functions import names
    from shutterloom.operators import fuzzy

    left, right = [f"supplier#{k:06d}" for k in range(20)], [f"supplier#{k * 977 % 10**6:06d}" for k in range(300)]
    scored = []
    monkeypatch.setattr(names, "ratio_of", lambda a, b, f=names.ratio_of: (scored.append(1), f(a, b))[1])
    found = list(fuzzy._best_first(left, right, fuzzy._bounds(left, right), 5, 0.3))
    assert len(scored) < 0.5 * len(left) * len(right)
    for i, a in enumerate(left):
        every = {j: names.ratio_of(a, b) for j, b in enumerate(right)}
        least = sorted(every.values())[-5]
        assert {j: r for k, j, r in found if k == i} == {j: r for j, r in every.items() if r >= least}
    # Of ties at the end those that come first stay.
    few = [(i, j) for i, j, _ in fuzzy._best_first(left, right, fuzzy._bounds(left, right), 5, 0.3, [-j for j in range(300)])]
    assert few == [(i, j) for i, a in enumerate(left) for j in sorted(sorted(range(300), key=lambda j: (-names.ratio_of(a, right[j]), -j))[:5], key=[y for x, y in few if x == i].index)]


def test_people_of_a_fold_are_those_of_comparing_all(spark):
    from shutterloom.functions import names
    from shutterloom.operators import staff

    draw = random.Random(9)
    for _ in range(40):
        people = staff.People()
        for _ in range(draw.randrange(0, 12)):
            people.add(staff.Person("".join(draw.choice("abc") for _ in range(5)), {draw.choice("xyz")}))
        if people.list:
            people.take(0, staff.Person("abcabcabc", {"z"}), longer_name=True)
        record = staff.Person("".join(draw.choice("abc") for _ in range(5)), {draw.choice("xyz"), "y"})
        every = [(names.similarity_of(record.name, p.name) + (0.3 if record.subjects & p.subjects else 0.0), -k) for k, p in enumerate(people.list)]
        score, k = max(every, default=(-1.0, 1))
        same = next((k for k, p in enumerate(people.list) if p.key == record.key), None)
        assert people.best(record, 0.3)[:2] == ((-k, score) if same is None else (same, 999.0))
        if people.list:
            times = [(staff.timetable_score(record, p), -k) for k, p in enumerate(people.list)]
            got = people.highest(record, people.shared(record, 0.35), people.same_main(record, 0.25), staff.np.full(len(people.list), -0.0))
            assert (got[1], -got[0]) == max(times)


def test_searches_meet_as_matrices(spark, monkeypatch):
    import numpy as np

    from shutterloom.operators import vector_index

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 6)), np.repeat(rng.normal(size=(30, 6)), 2, axis=0)
    x[3] = 0
    lists = np.sort(rng.integers(0, 5, 60))
    wanted = [rng.permutation(5)[: rng.integers(0, 6)].astype("int32") for _ in x]
    norms = [np.linalg.norm(v, axis=1) for v in (x, y)]
    for cosine in (True, False):
        i, j, s = vector_index._met(x, norms[0], wanted, y, norms[1], lists, 3, cosine)
        for q in range(40):
            every = {}
            for m in range(60):
                if lists[m] in wanted[q]:
                    dot = 0.0
                    for d in range(6):
                        dot += float(x[q, d]) * float(y[m, d])
                    every[m] = dot / (norms[0][q] * norms[1][m] + vector_index.TINY) if cosine else dot
            least = sorted(every.values())[-3:][:1]
            got = dict(zip(j[i == q].tolist(), s[i == q].tolist(), strict=True))
            assert all(every[m] == v for m, v in got.items())
            assert q == 3 or got == {m: v for m, v in every.items() if v >= least[0]}
            assert q != 3 or {min(m for m in every if lists[m] == n) for n in {lists[m] for m in every}} <= got.keys()
    # A query and a part of a list make no row of their own.
    rows = spark.createDataFrame([(k, k, v.tolist()) for k, v in enumerate(y)], "id long, pos long, emb array<double>")
    found = vector_index.VectorIndex.build(rows).nearest(rows.select(F.col("id").alias("query"), "emb"), 2)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_memory_of_reading_a_workbook_does_not_grow_with_its_rows(spark, tmp_path):
    import tracemalloc
    from unittest.mock import MagicMock

    import pyarrow as pa

    from shutterloom.sources import workbooks

    # The function that read_cells() gives to the tasks.
    reader = MagicMock()
    workbooks.read_cells(reader, "any")
    (call,) = [c for c in reader.mock_calls if c[0].endswith("mapInArrow")]
    task = call.args[0]

    def peak(read):
        tracemalloc.start()
        n = sum(read())
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, most

    few, many = [], []
    for rows, found in ((16_000, few), (96_000, many)):
        path = tmp_path / f"{rows}.xlsx"
        workbooks.write_workbook({"a": spark.range(rows, numPartitions=1).select(F.concat(F.lit("IMG_"), "id").alias("file"), "id")}, f"file://{path}")
        content = path.read_bytes()
        frame = pa.RecordBatch.from_pydict({"path": pa.array(["f"]), "content": pa.array([content], pa.binary())})
        found += [peak(lambda: (1 for _ in workbooks.cells_of(content))), peak(lambda: (b.num_rows for b in task(iter([frame]))))]
        assert [n for n, _ in found] == [2 * rows + 2] * 2
    assert all(most < 1.5 * least for (_, least), (_, most) in zip(few, many, strict=True)), (few, many)
