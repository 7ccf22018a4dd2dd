"""Folds cut into islands equal the folds over whole events; components of links."""

import datetime
import random

import numpy as np
import pytest

from shutterloom.operators import clustering, islands
from shutterloom.operators.components import components

PHOTO = "event string, id long, name string, ts timestamp_ntz, seq double, emb array<double>, focus double"
RULES = ((0.75, 240.0, 10), (0.60, 120.0, 10), (0.55, 120.0, None))


def photos(seed, n, span, numbers):
    rng = random.Random(seed)
    begin = datetime.datetime(2024, 3, 31)
    out = []
    for k in range(n):
        base = rng.choice([(1, 0, 0), (0, 1, 0), (0, 0, 1)])
        emb = [float(x + rng.gauss(0, 0.35)) for x in base]
        ts = None if rng.random() < 0.1 else begin + datetime.timedelta(microseconds=rng.randrange(span * 1_000_000))
        seq = None if rng.random() < 0.2 else float(rng.randrange(numbers))
        out.append((rng.choice(["a", "a", "a", "b", None]), k, f"IMG_{rng.randrange(n)}", ts, seq, emb, rng.choice([1.0, 2.0, float(k)])))
    return out


def folded(rows, rules):
    out = []
    for event in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == event), key=lambda r: (r[3] is not None, r[3] or datetime.datetime.min, r[2], r[1]))
        seconds = np.array([np.nan if r[3] is None else (r[3] - datetime.datetime(1970, 1, 1)).total_seconds() for r in own])
        steps = np.array([np.nan if r[4] is None else r[4] for r in own])
        clusters = clustering.first_fit(np.array([r[5] for r in own]), seconds, steps, np.array([r[6] for r in own]), rules)
        out += [(event, r[1], pos, k) for pos, (r, k) in enumerate(zip(own, clusters, strict=True))]
    return sorted(map(str, out))


@pytest.mark.parametrize(("seed", "span", "numbers"), [(1, 20_000, 10_000), (3, 3_000, 100), (4, 4_000_000, 100_000)])
def test_islands_equal_the_whole_fold(spark, seed, span, numbers):
    rows = photos(seed, 300, span, numbers)
    df = spark.createDataFrame(rows, PHOTO).repartition(5)
    got = islands.first_fit_islands(df, "event", RULES).collect()
    assert sorted(str(tuple(r)) for r in got) == folded(rows, RULES)


def test_rules_without_steps_and_rows_that_repeat(spark):
    rows = photos(5, 120, 40_000, 1)
    rules = ((0.6, 300.0, None),)
    got = islands.first_fit_islands(spark.createDataFrame(rows, PHOTO), "event", rules).collect()
    assert sorted(str(tuple(r)) for r in got) == folded(rows, rules)
    assert islands.first_fit_islands(spark.createDataFrame([], PHOTO), "event", RULES).collect() == []
    long_and_short = islands.first_fit_clusters(spark.createDataFrame(rows, PHOTO), "event", rules, whole=40).collect()
    assert sorted(str(tuple(r)) for r in long_and_short) == folded(rows, rules)


def test_a_long_event_is_many_islands(spark):
    begin = datetime.datetime(2024, 1, 1)
    rows = [("day", k, f"n{k}", begin + datetime.timedelta(seconds=(k // 10) * 1000 + k % 10), None if k % 3 else float((k // 10) * 1000 + k % 10), [1.0, 0.0, 0.0], 1.0) for k in range(3000)]
    found = islands.with_islands(spark.createDataFrame(rows, PHOTO), "event", 240.0, 10)
    sizes = [r["count"] for r in found.groupBy("island").count().collect()]
    assert len(sizes) == 300 and max(sizes) == 10
    chained = [("day", k, f"n{k}", begin + datetime.timedelta(seconds=k * 1000), float(k * 5), [1.0, 0.0, 0.0], 1.0) for k in range(300)]
    assert islands.with_islands(spark.createDataFrame(chained, PHOTO), "event", 240.0, 10).select("island").distinct().count() == 1


def test_components_of_paths_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(100, 400)] + [(1000, k) for k in range(1001, 1200)] + [(5, 6), (6, 7), (7, 5), (None, 3), (9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 401), 100), **dict.fromkeys(range(1000, 1200), 1000), **dict.fromkeys((5, 6, 7), 5)}
