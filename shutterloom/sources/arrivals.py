"""Files that arrive in a folder as a stream: `spark.readStream.format("arrivals").option("journal", ...).load(folder)`.

A listing has no order in which new files come last, so what is new is written down: each batch's files are an entry of
a journal, and an offset is the number of its last entry. A query that starts again finds the entries it has not
finished, and files in any entry are never taken twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Files of one partition at most, and of one batch.
PARTITION, BATCH = 1_000, 100_000


class Listed(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(files)
        self.files = files


class ArrivalsReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.journal = options["path"], options["journal"]
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip())
        self.most = int(options.get("maxfiles", BATCH))
        self.recursive = options.get("recursive", "true") == "true"
        self.known: set[str] = set()
        self.last = 0

    def _at(self, path: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    def _entry(self, number: int) -> list[tuple[str, int, int]] | None:
        system, inner = self._at(self.journal)
        path = f"{inner}/{number:012d}.json"
        if system.get_file_info(path).type != pafs.FileType.File:
            return None
        with system.open_input_stream(path) as f:
            return [tuple(x) for x in json.loads(f.read())]

    def _caught_up(self) -> None:
        while (files := self._entry(self.last + 1)) is not None:
            self.last += 1
            self.known.update(path for path, _, _ in files)

    def _arrived(self) -> list[tuple[str, int, int]]:
        system, inner = self._at(self.folder)
        infos = system.get_file_info(pafs.FileSelector(inner, allow_not_found=True, recursive=self.recursive))
        files = [(i.path, i.size, int((i.mtime_ns or 0) // 1000)) for i in infos if i.type == pafs.FileType.File]
        fine = lambda path: not path.rpartition("/")[2].startswith((".", "_")) and (not self.suffixes or path.lower().endswith(self.suffixes))
        return sorted((f for f in files if f[0] not in self.known and fine(f[0])), key=lambda f: (f[2], f[0]))[: self.most]

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        self._caught_up()
        if new := self._arrived():
            system, inner = self._at(self.journal)
            system.create_dir(inner, recursive=True)
            part = f"{inner}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                f.write(json.dumps(new).encode())
            system.move(part, f"{inner}/{self.last + 1:012d}.json")
            self._caught_up()
        return {"entry": self.last}

    def partitions(self, start: dict, end: dict) -> list[Listed]:
        files = [f for n in range(start["entry"] + 1, end["entry"] + 1) for f in self._entry(n) or []]
        return [Listed(files[k : k + PARTITION]) for k in range(0, len(files), PARTITION)]

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        paths, sizes, times = zip(*partition.files, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.timestamp("us", "UTC"))], ["path", "size", "modified"])

    def commit(self, end: dict) -> None:
        """Entries stay: they are what tells which files have been taken."""


class ArrivalsSource(DataSource):
    """S01 to S11 as a stream: path, size and time of modification of each file of a folder (and the folders in it), once.

    Options: path, journal (a folder of its own that outlives the query, beside its checkpoint; one query each),
    suffixes (endings by commas), recursive (true), maxfiles (of one batch). Files whose name begins with . or _ are not
    yet there. A file that is changed later is not told of again. The paths of all files taken so far are held on the
    driver, as Spark's own file source holds them.
    """

    @classmethod
    def name(cls) -> str:
        return "arrivals"

    def schema(self) -> str:
        return "path string, size long, modified timestamp"

    def streamReader(self, schema: StructType) -> ArrivalsReader:
        return ArrivalsReader(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """The session, in which the format "arrivals" is known."""
    spark.dataSource.register(ArrivalsSource)
    return spark
