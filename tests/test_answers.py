"""Stored answers: a killed run asks nothing twice."""

import json
import os
import signal
import time

import pytest
from pyspark.sql import functions as F

from shutterloom.functions.answers import AnswerStore, _appending, last_key
from shutterloom.functions.providers import FunctionProvider


def test_a_killed_run_asks_nothing_twice(spark, tmp_path):
    calls, flag = str(tmp_path / "calls"), str(tmp_path / "mended")
    os.makedirs(calls)

    def answer(text):
        if text == "r7" and not os.path.exists(flag):
            raise SystemExit("killed")
        if text == "r3":
            raise ValueError("no answer")
        with open(f"{calls}/{text}-{time.time_ns()}", "w"):
            pass
        return None if text == "r5" else f"{text}!"

    rows = spark.createDataFrame([(k, None if k == 90 else f"r{k % 30}") for k in range(91)], "id long, request string")
    store = AnswerStore(spark, f"file://{tmp_path}/store", "m")
    with pytest.raises(Exception):
        store.ask(rows, F.col("request"), FunctionProvider(answer), tasks=2).collect()
    asked = len(os.listdir(calls))
    with open(flag, "w"):
        pass
    got = {r.id: r.answer for r in store.ask(rows, F.col("request"), FunctionProvider(answer), tasks=2).collect()}
    assert got == {k: None if k == 90 or k % 30 in (3, 5) else f"r{k % 30}!" for k in range(91)}
    sent = [n.rpartition("-")[0] for n in os.listdir(calls)]
    assert 0 < asked < len(sent) and sorted(x for x in sent if x != "r5") == sorted(f"r{k}" for k in range(30) if k not in (3, 5))
    before = len(sent)
    store.ask(rows, F.col("request"), FunctionProvider(answer)).collect()
    assert len(os.listdir(calls)) == before + 1, "only the request without an answer is sent again"
    other = AnswerStore(spark, f"file://{tmp_path}/store", "another")
    other.ask(rows.limit(1), F.col("request"), FunctionProvider(answer)).collect()
    assert len(os.listdir(calls)) > before + 1


def test_tasks_share_the_rate(spark, tmp_path):
    rows = spark.range(12).select(F.col("id").cast("string").alias("request"))
    began = time.time()
    AnswerStore(spark, f"file://{tmp_path}/store").ask(rows, F.col("request"), FunctionProvider(str), tasks=2, per_second=8).count()
    assert time.time() - began > 0.9


def test_answers_of_a_task_are_one_log(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").cast("string").alias("request"))
    store = AnswerStore(spark, f"file://{tmp_path}/store")
    assert store.ask(rows, F.col("request"), FunctionProvider(lambda text: text + "\n!"), tasks=4).where("answer = concat(request, '\n!')").count() == 500
    assert len([n for n in os.listdir(tmp_path / "store" / "loose") if n.endswith(".json")]) <= 4
    store.gather()
    assert store.answers().count() == 500 and not os.path.exists(tmp_path / "store" / "loose")


def test_logs_outlive_the_kill_of_a_worker(spark, tmp_path):
    calls = str(tmp_path / "calls")
    os.makedirs(calls)

    def answer(text):
        if len(os.listdir(calls)) == 40 and not os.path.exists(f"{tmp_path}/killed"):
            with open(f"{tmp_path}/killed", "w"):
                pass
            os.kill(os.getpid(), signal.SIGKILL)
        with open(f"{calls}/{text}-{time.time_ns()}", "w"):
            pass
        return text

    rows = spark.range(100).select(F.col("id").cast("string").alias("request"))
    store = AnswerStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(Exception):
        store.ask(rows, F.col("request"), FunctionProvider(answer), tasks=1)
    assert store.answers().count() == 40
    # The system cut the last line of a log: its request is sent again, the others are not.
    (log,) = (tmp_path / "store" / "loose").glob("*.json")
    lines = log.read_bytes().splitlines(keepends=True)
    log.write_bytes(b"".join(lines)[:-9])
    assert store.answers().count() == 39 and last_key([str(log)]) == max(json.loads(x)["key"] for x in lines[:-1])
    assert store.ask(rows, F.col("request"), FunctionProvider(answer), tasks=1).where("answer = request").count() == 100
    assert len(os.listdir(calls)) == 101


def test_a_second_attempt_goes_on_behind_the_first(tmp_path):
    answered, put = _appending(str(tmp_path), "run-3")
    assert not answered("a")
    put("a", "1")
    put("c", "2")
    other = _appending(str(tmp_path), "run-31")[0]
    assert not other("a")
    again, put_again = _appending(str(tmp_path), "run-3")
    assert again("a") and again("b") and again("c") and not again("d")
    # Another run gathers the logs; what follows is stored in a new one.
    put_again("d", "3")
    for n in os.listdir(tmp_path):
        os.unlink(tmp_path / n)
    put_again("e", "4")
    (log,) = tmp_path.glob("*.json")
    assert log.read_bytes() == b'{"key": "e", "answer": "4"}\n'
