"""Where tables between stages and written results of queries go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder inside spark.checkpoint.dir, the one place that all machines see.

    Where the session names none and runs inside one machine (tests), a temporary folder is taken.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shutterloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


_paths: dict[int, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table of its own in the shared folder, reread: what follows starts there, also after a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that written() returned and that nothing will read again."""
    if path := _paths.pop(id(df), None):
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
