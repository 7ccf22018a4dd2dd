"""Folds without SQL equal plain loops over the same rows."""

import pytest

from shutterloom.operators.clustering import STAFF_COLUMNS
from shutterloom.plans.fold_queries import ALL_FRAMES, GUIDES, WORDS
from shutterloom.plans.registry import QUERIES, inputs


def grouped(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_page_rows(spark, sf):
    wanted = []
    for page, words in grouped(inputs(spark, sf, WORDS).collect(), "page").items():
        width = max(w.x1 for w in words)
        lines = []
        for w in sorted(words, key=lambda w: ((w.y0 + w.y1) / 2, w.x0)):
            y = (w.y0 + w.y1) / 2
            if lines and abs(y - mean) <= 4.0:
                lines[-1].append(w)
                mean += (y - mean) / len(lines[-1])
            else:
                lines.append([w])
                mean = y
        for k, line in enumerate(lines):
            line = sorted(line, key=lambda w: w.x0)
            if sum(len(w.text) for w in line) >= 3:
                cells = [sorted(w.text for w in line if a * width <= (w.x0 + w.x1) / 2 < b * width) for a, b in STAFF_COLUMNS.values()]
                wanted.append((page, k + 1, sorted(w.text for w in line), cells))
    got = [(r.page, r.row, sorted(r.text.split()), [sorted(r[n].split()) for n in STAFF_COLUMNS]) for r in QUERIES["c06_page_rows"](spark, sf).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted)) and len(got) > 100


def test_reading_order(spark, sf):
    wanted = []
    for page, frames in grouped(inputs(spark, sf, ALL_FRAMES).collect(), "page").items():
        column, start, placed = -1, None, []
        for f in sorted(frames, key=lambda f: (f.left, f.top, f.frame)):
            if start is None or f.left - start > 10.0:
                column, start = column + 1, f.left
            placed.append((column, f.top, f.frame))
        wanted += [(page, frame, n + 1) for n, (_, _, frame) in enumerate(sorted(placed))]
    assert sorted(tuple(r) for r in QUERIES["o10_reading_order"](spark, sf).collect()) == sorted(wanted)


@pytest.mark.parametrize("name", ["o11_thinned_guides"])
def test_thinned_guides(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    pages = grouped(inputs(spark, sf, GUIDES).collect(), "page")
    kept = grouped(rows, "page")
    for page, guides in pages.items():
        out = []
        for y in sorted(g.y for g in guides):
            if not out or y - out[-1] > 0.5:
                out.append(y)
        assert sorted(r.y for r in kept[page]) == out
