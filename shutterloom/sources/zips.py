"""Zip archives as a data source: one partition per archive, one row per member, names checked before anything is read."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members handed on at once, and bytes of their content.
ROWS, BYTES = 1_000, 4 << 20
MEMBERS = "archive string, member string, size long, content binary"


class UnsafeMember(ValueError):
    """A member's name would leave the folder it is unpacked to."""


def checked(name: str) -> str:
    """A member's name with forward slashes; absolute names and names that climb are refused."""
    name = name.replace("\\", "/")
    parts = name.split("/")
    if name.startswith("/") or ".." in parts or (parts and parts[0].endswith(":")):
        raise UnsafeMember(name)
    return name


def members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The members of all archives under `path`, by Spark's reader, so any store will do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return unpacked(files.select(F.col("path").alias("archive"), "content"), suffixes)


def unpacked(archives: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The members of archives (archive, content), one row each, folders left out; with `suffixes` those that end so."""

    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def unpack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for archive, content in zip(*(frame.column(n) for n in ("archive", "content")), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    for info in z.infolist():
                        checked(info.filename)
                    rows, size = [], 0
                    for info in z.infolist():
                        name = checked(info.filename)
                        if not info.is_dir() and (not suffixes or name.lower().endswith(suffixes)):
                            rows.append((archive.as_py(), name, info.file_size, z.read(info)))
                            size += info.file_size
                            if len(rows) == ROWS or size >= BYTES:
                                yield batch(rows)
                                rows, size = [], 0
                    if rows:
                        yield batch(rows)

    return archives.select("archive", "content").mapInArrow(unpack, MEMBERS)


def top_folders(rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Members whose first folder is one of those handed out."""
    return rows.where(F.split_part("member", F.lit("/"), F.lit(1)).isin(*allowed))


def archives(rows: DataFrame) -> DataFrame:
    """Members (archive, member, content) as one zip per archive: (archive, content). An archive is built in one task,
    through which its members pass in order, so the task holds the packed archive and what its directory says."""

    def packed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> pa.RecordBatch:
            z.close()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.string()), pa.array([out.getbuffer()], pa.binary())], ["archive", "content"])

        z = out = current = None
        for frame in frames:
            for archive, member, content in zip(*(frame.column(n).to_pylist() for n in ("archive", "member", "content")), strict=True):
                if z is None or archive != current:
                    if z is not None:
                        yield ended()
                    out, current = io.BytesIO(), archive
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(checked(member), content)
        if z is not None:
            yield ended()

    rows = rows.select("archive", "member", "content")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "archive").sortWithinPartitions("archive", "member").mapInArrow(packed, "archive string, content binary")
