"""Picture folders as tables: listings, their groups, dates and names. Nothing is opened until pixels are asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.tables import IMAGE_SUFFIXES
from ..operators.relational import small

LISTING = "path string, modified timestamp, size long"


def listing(spark: SparkSession, root: str, suffixes: Sequence[str] = IMAGE_SUFFIXES, recursive: bool = True) -> DataFrame:
    """(path, rel, name, folder, depth, modified, size) of the files with one of the suffixes.

    The content column is not read, so this lists and does not load.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    files = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return described(files, root, suffixes)


def described(files: DataFrame, root: str, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """A listing (path, modified, size) with the parts of each path below `root`."""
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), "^" + "".join(f"\\x{{{ord(ch):x}}}" for ch in base) + "/", "")
    files = files.withColumn("rel", rel).where(scalars.suffix_of(F.col("path")).isin(*suffixes))
    parts = F.split("rel", "/")
    return files.select("path", "rel", F.element_at(parts, -1).alias("name"), F.when(F.size(parts) > 1, F.element_at(parts, 1)).alias("folder"), (F.size(parts) - 1).alias("depth"), "modified", "size")


def grouped_by_folder(files: DataFrame) -> DataFrame:
    """Pictures by their first folder; those in the root belong to none and are left out."""
    return files.where("folder is not null")


def events_of(files: DataFrame) -> DataFrame:
    """The multi-event split: first folders are events in the order of their names, pictures in the root make one if they are alone."""
    named = files.withColumn("event_name", F.coalesce("folder", F.lit("")))
    events = named.select("event_name").distinct()
    number = F.row_number().over(Window.orderBy("event_name"))  # one row per event
    return named.join(small(events.withColumn("event_id", F.concat(F.lit("event_"), number.cast("string")))), "event_name")


def flattened(files: DataFrame) -> DataFrame:
    """Names that carry their folders, joined by underscores."""
    return files.withColumn("flat", F.replace(F.col("rel"), F.lit("/"), F.lit("_")))


def without_collisions(files: DataFrame) -> DataFrame:
    """One flat folder; of equal names the second gets _1, the third _2, before the suffix."""
    n = F.row_number().over(Window.partitionBy("name").orderBy("path")) - 1
    ending = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    stem = F.substring("name", F.lit(1), F.length("name") - F.length(ending))
    return files.withColumn("_n", n).withColumn("flat", F.when(F.col("_n") == 0, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ending))).drop("_n")


def class_folders(files: DataFrame) -> DataFrame:
    """Pictures in folders named like a class (3A) at the first level, or, only if there are none there, at the second."""
    first, second = F.split_part("rel", F.lit("/"), F.lit(1)), F.split_part("rel", F.lit("/"), F.lit(2))
    pattern = r"^\d+[A-Za-z]$"
    rows = files.withColumn("_one", first.rlike(pattern) & (F.col("depth") >= 1)).withColumn("_two", second.rlike(pattern) & (F.col("depth") >= 2))
    any_first = rows.agg(F.coalesce(F.max("_one"), F.lit(False)).alias("_any"))
    rows = rows.join(F.broadcast(any_first), F.lit(True))
    return rows.where(F.when(F.col("_any"), F.col("_one")).otherwise(F.col("_two"))).withColumn("class_id", F.when(F.col("_any"), first).otherwise(second)).drop("_one", "_two", "_any")


def photo_root(files: DataFrame) -> str:
    """Where pictures are, relative to the root: in the root itself, in its only folder, or (several folders) in the root."""
    row = files.agg(F.count_if(F.col("depth") == 0).alias("direct"), F.countDistinct("folder").alias("folders"), F.min("folder").alias("only")).first()
    return row["only"] if not row["direct"] and row["folders"] == 1 else ""


def captured(exif: Sequence[Column], modified: Column) -> Column:
    """The first tag that is a time, else when the file was changed."""
    tags = [F.try_to_timestamp(t, F.lit("yyyy:MM:dd HH:mm:ss")) for t in exif]
    return F.coalesce(*tags, modified)


def catalog(files: DataFrame, marker: str = "selected") -> DataFrame:
    """Output pictures with event, bucket, media type and an encoded link."""
    parts = F.split("rel", "/")
    bucket = F.when(F.size(parts) >= 3, F.element_at(parts, 2)).otherwise(F.lit(None))
    return files.select("rel", "name", F.element_at(parts, 1).alias("event"), bucket.alias("bucket"), scalars.media_type(F.col("rel")).alias("media_type"), F.concat(F.lit("/preview?path="), F.url_encode("rel")).alias("link"), scalars.cluster_title(F.col("folder")).alias("title"))


def safe_relative(path: Column) -> Column:
    """relative, without climbing, and a picture."""
    climbs = F.exists(F.split(path, "/"), lambda p: p == "..")
    return ~F.startswith(path, F.lit("/")) & ~climbs & scalars.suffix_of(path).isin(*IMAGE_SUFFIXES)


def absent_numbers(spark: SparkSession, path: str) -> DataFrame:
    """The whole numbers of a text file, separated by commas or lines."""
    lines = spark.read.text(path)
    values = lines.select(F.explode(F.split("value", "[,\\s]+")).alias("raw"))
    return values.select(F.col("raw").try_cast("int").alias("number")).where("number is not null").distinct()


def lowest_files(files: DataFrame) -> DataFrame:
    """Per student and kind the package file of lowest priority."""
    parsed = files.withColumn("x", scalars.student_file(F.col("name"))).where("x is not null")
    return parsed.groupBy(F.col("x.student").alias("student"), F.col("x.kind").alias("kind")).agg(F.min_by("name", F.struct(F.col("x.priority").alias("p"), "name")).alias("file"))
