"""Zip archives as a data source of Spark: `spark.read.format("zip").load(folder)`.

Small archives share a partition; a large one is parted by its table of contents, which alone is read when the read is
planned, so many tasks read it and none holds more than a few members at a time. A read names only the columns it wants:
without `content` no member is unpacked.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .zips import checked

#: Bytes of archives, or of members as they are packed, that one partition reads, about.
PARTITION = 64 << 20
#: Members or archives of one partition at most.
NAMED = 10_000
#: Bytes of rows handed on at once.
BATCH = 8 << 20
SCHEMA = "archive string, member string, size long, packed long, content binary"


class Members(InputPartition):
    """Whole archives (places is None), or some members of one by their places in its table of contents."""

    def __init__(self, archives: list[str], places: list[int] | None = None):
        super().__init__((archives, places))
        self.archives, self.places = archives, places


def _opened(path: str):
    """A file of a store that pyarrow knows (local paths, file:, hdfs:, s3: ...), to be read at any place."""
    system, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def archives_under(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the zip files in a folder and the folders in it, or of one file, in order of name."""
    system, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    found = system.get_file_info(inner)
    if found.type == pafs.FileType.File:
        return [(path, found.size)]
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    prefix = path[: path.index(inner)] if inner in path else ""
    return sorted((prefix + i.path, i.size) for i in infos if i.type == pafs.FileType.File and i.path.lower().endswith(".zip"))


class ZipReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.fieldNames()
        self.path = options["path"]
        self.partition = int(options.get("partitionbytes", PARTITION))
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip())
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on archive and member decide which members are dealt out at all; the rest Spark applies."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("archive",), ("member",)):
                self.tests.append(f)
            else:
                yield f

    def _passes(self, archive: str, member: str) -> bool:
        for f in self.tests:
            value = archive if f.attribute == ("archive",) else member
            fine = {EqualTo: lambda f, v: v == f.value, In: lambda f, v: v in f.value, StringStartsWith: lambda f, v: v.startswith(f.value), StringEndsWith: lambda f, v: v.endswith(f.value)}[type(f)](f, value)
            if not fine:
                return False
        return not self.suffixes or member.lower().endswith(self.suffixes)

    def partitions(self) -> list[Members]:
        out, held, size = [], [], 0
        for archive, n in archives_under(self.path):
            if n > self.partition:
                with _opened(archive) as f, zipfile.ZipFile(f) as z:
                    out += [Members([archive], places) for places in self._parted([i.compress_size for i in z.infolist()])]
                continue
            if held and (size + n > self.partition or len(held) >= NAMED):
                out.append(Members(held))
                held, size = [], 0
            held.append(archive)
            size += n
        return out + ([Members(held)] if held else [])

    def _parted(self, sizes: list[int]) -> Iterator[list[int]]:
        places, size = [], 0
        for place, n in enumerate(sizes):
            if places and (size + n > self.partition or len(places) >= NAMED):
                yield places
                places, size = [], 0
            places.append(place)
            size += n
        if places:
            yield places

    def read(self, partition: Members | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no archive
            return
        kinds = {"archive": pa.string(), "member": pa.string(), "size": pa.int64(), "packed": pa.int64(), "content": pa.binary()}
        schema = pa.schema([(n, kinds[n]) for n in self.names])
        rows, size = [], 0
        for archive in partition.archives:
            with _opened(archive) as f, zipfile.ZipFile(f) as z:
                infos = z.infolist()
                members = [checked(i.filename) for i in infos]
                for place in range(len(infos)) if partition.places is None else partition.places:
                    info, member = infos[place], members[place]
                    if info.is_dir() or not self._passes(archive, member):
                        continue
                    row = {"archive": archive, "member": member, "size": info.file_size, "packed": info.compress_size}
                    if "content" in self.names:
                        row["content"] = z.read(info)
                        size += info.file_size
                    rows.append({n: row[n] for n in self.names})
                    if size >= BATCH or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class ZipSource(DataSource):
    """Members of zip archives: path, member, size unpacked and packed, and content.

    Options: path (a folder or a file of a store that pyarrow reads), suffixes (endings of members, by commas),
    partitionbytes. The schema may be any of the source's columns in any order, as in
    `spark.read.format("zip").schema("member string, size long")`; members are unpacked only where it has `content`.
    An archive that is damaged or names a member outside its folder fails the read; no archives give no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ZipReader:
        unknown = set(schema.fieldNames()) - {"archive", "member", "size", "packed", "content"}
        if unknown:
            raise ValueError(f"a zip archive has no columns {sorted(unknown)}")
        return ZipReader(schema, dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """The session, in which the format "zip" is known and conditions reach Python data sources (both stay so)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipSource)
    return spark


def written_archives(packed: DataFrame, folder: str) -> DataFrame:
    """Rows (archive, content) as files `archive`.zip in `folder`, which all tasks see: (archive, path). A file is put in
    place whole, so a task that runs again changes nothing."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, inner = pafs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        for p in batches:
            paths = []
            for archive, content in zip(p.archive, p.content, strict=True):
                path = f"{inner}/{checked(archive).removesuffix('.zip').replace('/', '_')}.zip"
                with system.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
                    f.write(bytes(content))
                system.move(part, path)
                paths.append(path)
            yield pd.DataFrame({"archive": p.archive, "path": paths})

    return packed.select("archive", "content").mapInPandas(write, "archive string, path string")
