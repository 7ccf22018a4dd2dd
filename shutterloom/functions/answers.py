"""Model calls that are made once: answers are stored by their request, and what is stored is not asked again."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .providers import Provider

STORED = "key string, answer string"


def _line(key: str, answer: str) -> bytes:
    return json.dumps({"key": key, "answer": answer}, ensure_ascii=False).encode() + b"\n"


def last_key(logs: list[str]) -> str:
    """The greatest key of logs; a line that a kill has cut counts for nothing."""
    last = ""
    for log in logs:
        with open(log, "rb") as lines:
            for line in lines:
                try:
                    last = max(last, json.loads(line)["key"])
                except ValueError:
                    pass
    return last


def _appending(folder: str, task: str) -> tuple[Callable[[str], bool], Callable[[str, str], None]]:
    """Whether an earlier attempt of `task` has come past a key, and what puts an answer into this attempt's log.

    A line is handed to the system by one unbuffered write, so it outlives the process as soon as the call is over.
    """
    last = last_key([f"{folder}/{n}" for n in os.listdir(folder) if n.startswith(f"{task}-")])
    log = None

    def put(key: str, answer: str) -> None:
        nonlocal log
        # A log that another run has gathered meanwhile is not there any more.
        if log is None or not os.fstat(log.fileno()).st_nlink:
            os.makedirs(folder, exist_ok=True)
            log = open(f"{folder}/{task}-{uuid.uuid4().hex}.json", "ab", buffering=0)
        line = _line(key, answer)
        while line:
            line = line[log.write(line) :]

    return lambda key: key <= last, put


def _putting(system: pafs.FileSystem, folder: str) -> tuple[Callable[[str], bool], Callable[[str, str], None]]:
    """As _appending(), with a file for each answer, moved to its place when it is whole."""

    def put(key: str, answer: str) -> None:
        with system.open_output_stream(part := f"{folder}/.{uuid.uuid4().hex}") as f:
            f.write(_line(key, answer))
        system.move(part, f"{folder}/{key}.json")

    return lambda key: system.get_file_info(f"{folder}/{key}.json").type == pafs.FileType.File, put


class AnswerStore:
    """Answers under `root`, a folder that all tasks see and that outlives the run.

    loose/ has the answers of this run, stored as soon as they are there, so a run that is killed loses at most the calls
    in flight: a log for each task, or, where `root` is no local or mounted folder, so that nothing can be appended that
    others see at once, a file for each answer. kept/ is a table to which loose ones are moved before the next run. A key
    is the digest of a request and of `model`, so another model's answers are others.
    """

    def __init__(self, spark: SparkSession, root: str, model: str = ""):
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        return self.fs.exists(self.path(f"{self.root}/{name}"))

    def _loose(self) -> DataFrame:
        """A line that a kill has cut is left out."""
        rows = self.spark.read.schema(STORED).option("pathGlobFilter", "*.json").json(f"{self.root}/loose")
        return rows.where("key IS NOT NULL AND answer IS NOT NULL")

    def answers(self) -> DataFrame:
        """(key, answer) of all stored answers."""
        rows = self.spark.createDataFrame([], STORED)
        if self._there("kept"):
            rows = rows.unionByName(self.spark.read.schema(STORED).parquet(f"{self.root}/kept"))
        if self._there("loose"):
            rows = rows.unionByName(self._loose())
        return rows.dropDuplicates(["key"])

    def gather(self) -> None:
        """Move loose answers to the table. Broken off, it leaves some in both places, which answers() sees once."""
        if self._there("loose"):
            aside = f"{self.root}/loose-{uuid.uuid4().hex}"
            self._loose().write.mode("append").parquet(f"{self.root}/kept")
            self.fs.rename(self.path(f"{self.root}/loose"), self.path(aside))
            self.fs.delete(self.path(aside), True)

    def key(self, request: Column) -> Column:
        return F.sha2(F.concat_ws("\n", F.lit(self.model), request), 256)

    def ask(self, rows: DataFrame, request: Column, provider: Provider, tasks: int = 8, per_second: float | None = None, name: str = "answer") -> DataFrame:
        """`rows` with the answer to `request`; each distinct request that has no answer yet is sent once.

        `tasks` tasks share the calls, and each keeps to its share of `per_second`. A call that fails or gives null has a
        null answer and is sent again in the next run. A null request is not sent. Requests of a task are sent in the
        order of their keys, so that a second attempt goes on behind the last answer of the first; a speculative copy of
        a task that still runs sends what comes after again.
        """
        self.gather()
        keyed = rows.withColumn("_request", request).withColumn("_key", F.when(F.col("_request").isNotNull(), self.key(F.col("_request"))))
        open_ = keyed.where("_key IS NOT NULL").select(F.col("_key").alias("key"), F.col("_request").alias("request")).dropDuplicates(["key"])
        open_ = open_.join(self.answers().select("key"), "key", "left_anti").repartition(tasks, "key").sortWithinPartitions("key")
        folder, pause, this = f"{self.root}/loose", tasks / per_second if per_second else 0.0, uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            system, inner = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
            system.create_dir(inner, recursive=True)
            local = isinstance(system, pafs.LocalFileSystem)
            answered, put = _appending(inner, f"{this}-{TaskContext.get().partitionId()}") if local else _putting(system, inner)
            answer, following = provider.load(), 0.0
            for p in batches:
                for key, text in zip(p.key, p.request, strict=True):
                    if answered(key):
                        continue
                    time.sleep(max(0.0, following - time.monotonic()))
                    following = time.monotonic() + pause
                    try:
                        got = answer(text)
                    except Exception:
                        got = None
                    if got is not None:
                        put(key, got)
                yield p[["key"]]

        open_.mapInPandas(run, "key string").write.format("noop").mode("overwrite").save()
        found = self.answers().select(F.col("key").alias("_key"), F.col("answer").alias(name))
        return keyed.drop("_request").join(found, "_key", "left").drop("_key")
