"""Decoding, scaling, regions, readers and the individual pipeline."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.functions import pixels, providers, readings
from shutterloom.operators import individual
from shutterloom.operators import tables as T


def png(x, filters):
    h, w, depth = x.shape
    lines, before = b"", np.zeros((w, depth), np.int32)
    for y in range(h):
        line, kind = x[y].astype(np.int32), filters[y % len(filters)]
        left = np.vstack((np.zeros((1, depth), np.int32), line[:-1]))
        corner = np.vstack((np.zeros((1, depth), np.int32), before[:-1]))
        if kind == 4:
            p = left + before - corner
            a, b, c = abs(p - left), abs(p - before), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, before, corner))
        else:
            guess = {0: 0 * line, 1: left, 2: before, 3: (left + before) // 2}[kind]
        lines += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        before = line
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    color = {1: 0, 3: 2, 4: 6}[depth]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_png_filters(depth):
    x = np.random.default_rng(depth).integers(0, 256, (11, 7, depth), dtype=np.uint8)
    got = pixels.decode(png(x, [0, 1, 2, 3, 4]))
    assert (got == (np.repeat(x, 3, 2) if depth == 1 else x[..., :3])).all()


def test_pnm_and_unreadable():
    x = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (pixels.decode(b"P6\n# note\n4 2\n255\n" + x.tobytes()) == x).all()
    assert pixels.decode(b"P5 4 2 255\n" + bytes(8)).shape == (2, 4, 3)
    for bad in (None, b"", b"P6 4 2 255\n1", b"\x89PNG\r\n\x1a\nxx", b"JFIF", b"P6"):
        assert pixels.decode(bad) is None
    assert pixels.decode(b"JFIF", lambda b: x) is x


def test_decoded_table(spark):
    x = np.zeros((3, 2, 3), np.uint8)
    df = spark.createDataFrame([("a", bytearray(b"P6 2 3 255\n" + x.tobytes())), ("b", bytearray(b"no")), ("c", None)], "path string, content binary")
    assert sorted((r.path, r.height, r.width) for r in pixels.decoded(df).collect()) == [("a", 3, 2), ("b", None, None), ("c", None, None)]


def test_scaling_marks_and_regions():
    x = np.full((40, 80, 3), 20, np.uint8)
    assert pixels.resized(x, 100) is x and pixels.resized(x, 20).shape == (10, 20, 3)
    assert (pixels.resized(x, 20) == 20).all()
    card = x.copy()
    card[20:32, 20:50] = 250
    assert pixels.has_placard(card) and not pixels.has_placard(x)
    assert pixels.card_region(card).shape[0] >= 12 and not pixels.mostly_white(card) and pixels.mostly_white(np.full_like(x, 255))
    assert pixels.regions(pixels.white(card))[0] == (360, 20, 20, 50, 32)
    marked = pixels.framed(x, (5, 5, 20, 15))
    assert (marked[5, 5] == (255, 0, 0)).all() and (marked[10, 12] == 20).all() and (x == 20).all()
    dots = np.full((60, 60, 3), 255, np.uint8)
    dots[5:60:8, 5:60:8] = 0
    assert pixels.dense_text(dots) and not pixels.dense_text(x[:4, :4] + 200)
    assert len(pixels.card_variants(card)) == 2


def test_regions_equal_a_flood_fill():
    rng = np.random.default_rng(3)
    for share in (0.05, 0.3, 0.5, 0.9, 0.0, 1.0):
        mask = rng.random((23, 31)) < share
        left, wanted = {tuple(p) for p in np.argwhere(mask)}, []
        while left:
            todo, region = [left.pop()], []
            while todo:
                y, x = todo.pop()
                region.append((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                todo += near
            ys, xs = zip(*region, strict=True)
            wanted.append((len(region), min(xs), min(ys), max(xs) + 1, max(ys) + 1))
        assert sorted(pixels.regions(mask)) == sorted(wanted)
        assert [r[0] for r in pixels.regions(mask)] == sorted((r[0] for r in wanted), reverse=True)


def test_gaps_are_closed_and_specks_taken_away():
    mask = np.zeros((60, 80), bool)
    mask[20:45, 20:60] = True
    mask[30:33, 25:50] = False  # writing on the card
    mask[5:9, 5:9] = True
    wanted = np.zeros_like(mask)
    wanted[20:45, 20:60] = True
    assert (pixels.closed_and_opened(mask, 9) == wanted).all()


def test_injected_readers(spark):
    df = spark.createDataFrame([(1, "3-1|12"), (2, ""), (3, "boom")], "id long, raw string")

    def load():
        def read(row):
            if row.raw == "boom":
                raise RuntimeError
            return [(t, 0.9) for t in row.raw.split("|") if t]

        return read

    texts = readings.read_texts(df, load)
    assert sorted((r.id, r.pos, r.text) for r in texts.collect()) == [(1, 0, "3-1"), (1, 1, "12")]
    (got,) = readings.separators(texts).collect()
    assert (got.label, got.student_number) == ("3-1", 12)

    def detector():
        return lambda row: [{"x1": 0, "y1": 0, "x2": k, "y2": k, "det_score": 0.9, "emb": [1.0, 0.0]} for k in (3, 5)] if row.id == 1 else []

    faces = readings.detect_faces(df, detector)
    (face,) = readings.largest_face(faces).collect()
    assert (face.id, face.face_index, face.x2) == (1, 1, 5)


def test_provider_failures_are_null_and_retried(spark):
    calls = spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, t string")

    def answer(text):
        if text == "bad":
            raise ValueError
        return '{"technical": 3, "is_ng": "false"}'

    rows = providers.asked(calls, F.col("t"), providers.FunctionProvider(answer), attempts=2)
    got = {r.id: r for r in rows.select("id", "answer", providers.evaluation(F.col("answer")).alias("e")).collect()}
    assert got[2].answer is None and got[2].e.is_ng and got[2].e.ng_reason == "evaluation failed"
    assert not got[1].e.is_ng and got[1].e.technical == 3.0 and got[1].e.event_relevance == 5.0
    stored = providers.answered_from(calls, spark.createDataFrame([(1, "x")], "id long, answer string"), "id")
    assert {r.id: r.answer for r in stored.collect()} == {1: "x", 2: None}


def test_people_in_classes(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [
        ("f", 0, "sep1", None, "3-1", 9, None), ("f", 1, "a1", None, None, None, a), ("f", 2, "card", 4, None, None, None), ("f", 3, "a2", None, None, None, a),
        ("f", 4, "sep2", None, "3-2", 7, None), ("f", 5, "b1", None, None, None, b), ("f", 6, "b2", None, None, None, b),
    ]
    df = spark.createDataFrame(rows, "folder string, idx long, path string, card_number int, separator_label string, separator_number int, emb array<double>").repartition(3)
    got = {r.group_id: (r.number, r.class_label, r.paths, r.cards) for r in individual.grouped_people(df).collect()}
    assert got == {0: (4, "3-1", ["a1", "a2"], ["card"]), 1: (9, "3-2", ["b1", "b2"], [])}
    early = spark.createDataFrame([("f", 0, "a1", None, None, None, a), ("f", 1, "s", None, "3-1", None, None)], df.schema)
    assert individual.grouped_people(early).first().class_label == "pre-separator"


def test_small_tables(spark):
    assert T.empty_evaluations(spark).count() == 0
    both = T.united([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")])
    assert sorted(map(tuple, both.collect()), key=str) == [(1, None), (None, 2)]
    assert T.public(spark.createDataFrame([(1, 2)], "a int, _b int")).columns == ["a"]
    df = spark.createDataFrame([(2, False, "b"), (1, True, "a"), (2, True, "c")], "cluster int, representative boolean, file string")
    assert [r.file for r in T.report_order(df).collect()] == ["a", "c", "b"]
