"""Streams in several batches and over restarts: people, numbers, arrivals and the merged log."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shutterloom.operators import clustering
from shutterloom.sources import arrivals
from shutterloom.streaming import people
from shutterloom.streaming.log import Log

FACES = "folder int, id long, name string, emb array<double>"


def ran(df, out, checkpoint, **trigger):
    query = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(**trigger or {"availableNow": True}).start()
    ended = query.awaitTermination(60)
    query.stop()
    assert ended


def test_people_over_batches_and_a_restart_equal_the_fold(spark, tmp_path):
    rng = np.random.default_rng(2)
    emb = rng.normal(size=(60, 4))
    emb /= np.linalg.norm(emb, axis=1, keepdims=True)
    rows = [(i % 2, i, f"n{i:02d}", [float(x) for x in emb[i]]) for i in range(60)]
    batches = [rows[:20], rows[20:40], rows[40:]]

    def stream():
        return people.recognised(spark.readStream.schema(FACES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))

    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, FACES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their times
        if k:
            ran(stream(), tmp_path / "out", tmp_path / "checkpoint")
    got = sorted((r.folder, r.id, r.person) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.folder, r.id, r.person) for r in clustering.people(spark.createDataFrame(rows, FACES), "folder").collect())


def test_people_who_are_not_seen_are_forgotten(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(1, k, f"n{k}", [1.0, 0.0])], FACES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ran(people.recognised(spark.readStream.schema(FACES).parquet(str(tmp_path / "in")), forget="500"), tmp_path / "out", tmp_path / "checkpoint", once=True)
        time.sleep(2)
    assert sorted((r.id, r.person) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0), (1, 1)]


def test_numbers_carry_over_batches(spark, tmp_path):
    schema = "folder int, id long, pos int, number long"
    rows = [(k % 2, k, k, [None, 7, None, 3, 9, None][k % 6]) for k in range(24)]
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ran(people.previous_numbers(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path / "out", tmp_path / "checkpoint")
    wanted = pd.DataFrame(rows, columns=["folder", "id", "pos", "number"])
    wanted["number"] = wanted.number.astype("Int64")
    wanted["previous"] = wanted.groupby("folder").number.transform(lambda s: s.ffill().shift(1))
    got = {r.id: r.previous for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {int(r.id): None if pd.isna(r.previous) else int(r.previous) for r in wanted.itertuples()}


def test_arrivals_are_told_once_over_restarts(spark, tmp_path):
    arrivals.registered(spark)
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)

    def run():
        stream = spark.readStream.format("arrivals").option("journal", str(tmp_path / "journal")).option("suffixes", ".jpg").option("maxfiles", 3).load(str(folder))
        ran(stream, tmp_path / "out", tmp_path / "checkpoint")
        return sorted((r.path.rpartition("/")[2], r.size) for r in spark.read.schema("path string, size long").parquet(str(tmp_path / "out")).collect())

    for k in range(7):
        (folder / f"a{k}.jpg").write_bytes(b"x" * k)
    for name in ("a.txt", ".part.jpg", "_part.jpg"):
        (folder / name).write_bytes(b"")
    first = run()
    while len(first) < 7:  # a run that ends with what was there when it began takes one batch
        more = run()
        assert len(more) > len(first)
        first = more
    assert first == [(f"a{k}.jpg", k) for k in range(7)] and run() == first
    (folder / "deep" / "late.jpg").write_bytes(b"late")
    import os

    os.utime(folder / "deep" / "late.jpg", (1, 1))  # older than all before, yet new
    assert run() == [*first, ("late.jpg", 4)]
    # An entry that was written down before the query could finish it is taken at the next start.
    (folder / "z.jpg").write_bytes(b"")
    reader = arrivals.ArrivalsReader({"path": str(folder), "journal": str(tmp_path / "journal")})
    reader.suffixes = (".jpg",)
    reader.latestOffset()
    assert ("z.jpg", 0) in run() and len(run()) == 9


def test_the_log_keeps_the_latest_rows_and_stays_short(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", "key string, seq long, status string", ["key"], ["seq"], parts=3)
    assert log.read().collect() == []
    wanted = {}
    for number in range(11):
        rows = [(f"k{(number * 3 + k) % 7}" if k else None, k, f"{number}-{k}") for k in range(5)]
        batch = spark.createDataFrame(rows, "key string, seq long, status string").withColumn("more", F.lit(1))
        log.write(batch, number)
        log.write(batch.withColumn("status", F.lit("repeated")), number)
        wanted.update({key: status for key, _, status in rows})
        assert len(log.numbers("base")) <= 1 and len(log.numbers("part")) < 3
    assert {r.key: r.status for r in log.read().collect()} == wanted
    log.write(spark.createDataFrame([("k1", 99, "old")], "key string, seq long, status string"), 2)
    assert {r.key: r.status for r in log.read().collect()} == wanted
    # A merge that broke off after its base was put in place: what it holds is not counted twice.
    log._put(log._rows(), f"base-{max(log.numbers('part'))}")
    assert len(log.numbers("part")) and {r.key: r.status for r in log.read().collect()} == wanted
    log.merge()
    assert log.numbers("part") == [] and {r.key: r.status for r in log.read().collect()} == wanted
