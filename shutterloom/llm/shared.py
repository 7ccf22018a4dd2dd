"""What the corpus operators share: written tables in the cluster's shared folder, column safety, session settings."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared_folder

#: Rows and bytes per Arrow batch: texts can be long, so a batch is bounded by both (a single row may be larger).
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20
#: The setting by which shuffle files go at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tuned(spark: SparkSession) -> SparkSession:
    """Keep the Arrow batches of text rows small enough for two Python workers beside the heap.

    The session's settings are read when a query runs, which is after this returns, so they stay as they are set here.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker gives freed memory back: it lives on, and what comes next may need it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return whole


class Tables:
    """Tables written for one run of an operator: reread from storage, so a lost executor costs one stage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.written = spark, shared_folder(spark), 0
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread; the shuffle files behind `df` go when it is written, so they never add up over the steps."""
        self.written += 1
        path, schema = f"{self.root}/{self.written:03d}-{name}", df.schema
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that put() returned and that nothing will read again."""
        path = self.paths.pop(id(df))
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sent_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A written table of a few narrow columns, marked for broadcasting if it has at most `rows` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def text_mark(column: str = "text"):
    """Tells the texts of rows that share a doc_id apart."""
    return F.xxhash64(text_or_empty(column))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has."""
    taken = {c.lower() for c in columns}
    return [next(n for k in range(len(taken) + 1) if (n := f"_{w}{k}") not in taken) for w in wanted]


def one_row_each(rows: DataFrame, several: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Columns `names` of `rows`; of rows with equal doc_id and text that are in `several` by the columns `by` one stays,
    the least by its other columns (any, where these have no order)."""
    (row,) = free_names([*names, *by], "row")
    several = sent_if_small(several)
    rest = [F.col(f"`{c}`") for c in names if c not in ("doc_id", "text")]
    least = F.first if any("map<" in kind for _, kind in rows.dtypes) else F.min
    one = rows.join(several, by, "left_semi").groupBy(*dict.fromkeys([*by, "doc_id", "text"])).agg(least(F.struct(F.lit(0), *rest)).alias(row))
    one = one.select(*[F.col(c) if c in ("doc_id", "text", *by) else F.col(row)[c].alias(c) for c in dict.fromkeys([*names, *by])])
    return rows.join(several, by, "left_anti").select(*[F.col(f"`{c}`") for c in one.columns]).unionByName(one)


def one_of_each(docs: DataFrame, tables: Tables) -> DataFrame:
    """`docs` without rows that repeat both doc_id and text of another row; of such rows the least by other columns stays.

    Rows without doc_id, and null texts or texts without words, all stay. Where nothing repeats, `docs` is returned.
    """
    (mark,) = free_names(docs.columns, "mark")
    marked = docs.withColumn(mark, text_mark())
    worded = marked.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[^ \\t-\\r]"))
    several = tables.put(worded.groupBy("doc_id", mark).count().where("count > 1").select("doc_id", mark), "copies")
    return docs if several.isEmpty() else one_row_each(marked, several, ["doc_id", mark], docs.columns).select(*[F.col(f"`{c}`") for c in docs.columns])
