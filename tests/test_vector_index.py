"""Searches of a stored index equal comparing all with all, whatever the vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.operators import relational, vector_index
from shutterloom.operators.vector_index import VectorIndex

VECTORS = "id long, pos long, emb array<double>"


def vectors(seed, n, clusters, spread, dim=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dim))
    out = [(k, int(k % 7), [float(x) for x in (centers[k % clusters] + rng.normal(size=dim) * spread) * rng.uniform(0.5, 2)]) for k in range(n)]
    out[3] = (3, 3, out[10][2])
    out[4] = (4, 4, out[10][2])
    return [*out, (n, 0, None), (n + 1, 0, [0.0] * dim), (n + 2, 0, [1.0, None] * (dim // 2)), (n + 3, 0, [1.0])]


def scores(a, b, cosine):
    clean = [np.array(v, float) if v is not None and len(v) == 8 and None not in v else np.zeros(8) for v in (a, b)]
    dot = float(np.cumsum(clean[0] * clean[1])[-1])
    return dot / (np.linalg.norm(clean[0]) * np.linalg.norm(clean[1]) + 1e-12) if cosine else dot


@pytest.mark.parametrize(("clusters", "spread", "cosine", "k", "block"), [(12, 0.05, True, 5, 9999), (12, 0.05, False, 1, 60), (200, 1.0, False, 3, 9999)])
def test_searches_equal_comparing_all(spark, monkeypatch, clusters, spread, cosine, k, block):
    monkeypatch.setattr(vector_index, "MEMBERS", 7)
    monkeypatch.setattr(vector_index, "BLOCK", block)
    rows = vectors(1, 240, clusters, spread)
    index = VectorIndex.build(spark.createDataFrame(rows, VECTORS).repartition(3))
    again = VectorIndex(spark, index.path)
    # More queries than vectors send the index, fewer send the queries.
    asked = [(r[0], r[2]) for r in rows[:: 1 if block < 100 else 3]] + [(10**6, None)]
    got = again.nearest(spark.createDataFrame(asked, "query long, emb array<double>"), k, cosine).collect()
    wanted = set()
    for q, emb in asked:
        best = sorted(((scores(emb, v, cosine), pos, i) for i, pos, v in rows), key=lambda x: (-round(x[0], 9), x[1], x[2]))[:k]
        wanted |= {(q, i, rank + 1) for rank, (_, _, i) in enumerate(best)}
    assert {(r.query, r.id, r["rank"]) for r in got} == wanted


def test_lists_of_far_clusters_are_left_out(spark):
    rows = [r for r in vectors(2, 4000, 40, 0.02) if r[2] is not None and len(r[2]) == 8 and None not in r[2] and any(r[2])]
    index = VectorIndex.build(spark.createDataFrame(rows, VECTORS))
    met = []
    searched = index._searched
    index._searched = lambda asked, *a: (met.append(asked.agg(F.sum(F.size("lists"))).first()[0] or 0), searched(asked, *a))[1]
    asked = spark.createDataFrame([(r[0], r[2]) for r in rows[::40]], "query long, emb array<double>")
    assert index.nearest(asked, 1).where("score < 0.999").isEmpty()
    assert sum(met) < 0.2 * 100 * len(index.numbers), "most lists are never searched"


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame([(1, 1, [1.0, 0.0])], VECTORS)
    index = VectorIndex.build(nothing)
    assert index.nearest(some.select(F.col("id").alias("query"), "emb"), 3).collect() == []
    assert VectorIndex.build(some).nearest(nothing.select(F.col("id").alias("query"), "emb"), 3).collect() == []
    out = relational.best_anchor(some.select("id", "emb"), nothing.select(F.col("id").alias("anchor"), "pos", F.col("emb").alias("anchor_emb")), 0.5).collect()
    assert [tuple(r) for r in out] == [(1, None, None)]
