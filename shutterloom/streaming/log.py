"""A log of changes that stays short: batches are added once, and merged into the latest row of each key now and then."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts after which a log is merged.
PARTS = 16


class Log:
    """Rows of `schema` (DDL), of which the latest of each of `keys` holds: of the highest batch, and in a batch
    the last by `order`.

    Under `root`, part-n is batch n, and base-n is all up to batch n, merged. Each is written aside and put in place by
    a rename, so a batch that is repeated, or a merge that broke off, changes nothing. A read sees one base and at most
    PARTS parts. One writer at a time, as foreachBatch has; keys may be null, and rows that tie in `order` are one of them.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], order: Sequence[str], parts: int = PARTS):
        self.spark, self.root, self.keys, self.order, self.parts = spark, root.rstrip("/"), list(keys), list(order), parts
        self.schema = spark.createDataFrame([], schema).withColumn("_batch", F.lit(0).cast("long")).schema
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self, kind: str) -> list[int]:
        """Numbers of the bases or parts that are there."""
        if not self.fs.exists(self.path(self.root)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.root))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{kind}-(\d+)", n)))

    def _put(self, rows: DataFrame, name: str) -> None:
        aside = f"{self.root}/_{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        if self.fs.exists(self.path(f"{self.root}/{name}")) or not self.fs.rename(self.path(aside), self.path(f"{self.root}/{name}")):
            self.fs.delete(self.path(aside), True)

    def write(self, batch: DataFrame, number: int) -> None:
        """Add batch `number`, for foreachBatch; one that is there already, or in the base, is left as it is."""
        if number <= max(self.numbers("base"), default=-1) or number in self.numbers("part"):
            return
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields[:-1]]
        self._put(batch.select(*columns, F.lit(number).cast("long").alias("_batch")), f"part-{number}")
        if len(self.numbers("part")) >= self.parts:
            self.merge()

    def _rows(self) -> DataFrame:
        base = max(self.numbers("base"), default=-1)
        paths = [f"{self.root}/base-{base}"] * (base >= 0) + [f"{self.root}/part-{n}" for n in self.numbers("part") if n > base]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        order = Window.partitionBy(*self.keys).orderBy(F.desc("_batch"), *[F.desc(c) for c in self.order])
        return rows.select(*self.schema.fieldNames()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")

    def merge(self) -> None:
        """Merge all parts into a new base, and remove what it holds."""
        parts, bases = self.numbers("part"), self.numbers("base")
        if not parts:
            return
        last = max([*parts, *bases])
        if last not in bases:
            self._put(self._rows(), f"base-{last}")
        for name in (*(f"part-{n}" for n in parts if n <= last), *(f"base-{n}" for n in bases if n < last)):
            self.fs.delete(self.path(f"{self.root}/{name}"), True)

    def read(self) -> DataFrame:
        """The latest row of each key."""
        return self._rows().drop("_batch")
