"""Writers of result tables. Every run is a new version; a reader finds it only when it is whole."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    where, fs = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def write_version(tables: Mapping[str, DataFrame], root: str, partitions: Mapping[str, list[str]] | None = None) -> str:
    """Tables of a report under v{n + 1}, put in place by one rename when all are written."""
    spark = next(iter(tables.values())).sparkSession
    number = max(versions(spark, root), default=0) + 1
    # Writers at the same time have drafts of their own; of two that end up at one version the later fails.
    draft, final = f"{root.rstrip('/')}/.draft-{uuid.uuid4().hex}", f"{root.rstrip('/')}/v{number}"
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(partitions or {}).get(name, [])).parquet(f"{draft}/{name}")
    source, fs = _fs(spark, draft)
    if fs.exists(_fs(spark, final)[0]) or not fs.rename(source, _fs(spark, final)[0]):
        raise FileExistsError(final)
    return final


def read_latest(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/v{versions(spark, root)[-1]}/{name}")


def write_sheet(df: DataFrame, path: str) -> None:
    """A table as CSV with display headers and values, lists joined."""
    columns = [scalars.sheet_value(F.col(f"`{n}`"), kind).alias(scalars.header(n)) for n, kind in df.dtypes]
    df.select(*columns).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested tables as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON with a declared schema; a missing path is an empty table."""
    where, fs = _fs(spark, path)
    return spark.read.schema(schema).json(path) if fs.exists(where) else spark.createDataFrame([], schema)
