"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards, each arrival a run: a folder of files that is written once. Runs whose
sizes fall into one tier (a power of `fanout`) are similar; when a tier has `fanout` of them they are merged into one
larger run, in files of the target size. Every change is a new version of the manifest: a small file that names the runs
added and removed, and now and then all live ones, so a commit costs no more than its change and a reader folds a
bounded number of files. A version is written under a name of its own and then renamed to its place, which fails if
another writer took that version first: readers see the old or the new state, never part of one. The file system has to
rename atomically without overwriting. Runs that no kept version lists are removed a folder at a time.

The driver holds one entry per live run, whatever the number of files and rows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import free_names

#: Bytes of a merged file, and how many runs of a tier are merged.
TARGET_BYTES, FANOUT = 128 << 20, 4
#: Versions after which one lists all live runs.
WHOLE_EVERY = 32


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Run:
    """One immutable folder of files: its path below the store, files, bytes, rows, and merges behind it."""

    path: str
    files: int
    size: int
    rows: int
    level: int


class Store:
    """A folder of shards and manifests in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _versions(self) -> list[int]:
        folder = self.path("manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The last committed version, 0 if there is none."""
        return max(self._versions(), default=0)

    def _entry(self, version: int) -> dict:
        stream = self.fs.open(self.path(f"manifests/v{version:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _state(self, version: int) -> tuple[dict[str, Run], dict | None]:
        """Live runs by path, and the schema of the rows."""
        entries = []
        while version:
            entries.append(self._entry(version))
            if entries[-1]["whole"]:
                break
            version -= 1
        live: dict[str, Run] = {}
        for e in reversed(entries):
            live |= {r["path"]: Run(**r) for r in e["added"]}
            for path in e["removed"]:
                del live[path]
        return live, entries[0]["schema"] if entries else None

    def manifest(self, version: int | None = None) -> list[Run]:
        """The live runs of a version, by default the last."""
        live, _ = self._state(self.version() if version is None else version)
        return sorted(live.values(), key=lambda r: r.path)

    def commit(self, base: int, added: list[Run], removed: list[str], schema: dict | None = None) -> int:
        """Version base + 1: that of `base` with runs added and removed; or raise Conflict."""
        version = base + 1
        live, known = self._state(base)
        whole = version % WHOLE_EVERY == 1
        if whole:
            live |= {r.path: r for r in added}
            added, removed = [r for p, r in live.items() if p not in set(removed)], []
        body = json.dumps({"version": version, "whole": whole, "schema": known or schema, "added": [asdict(r) for r in added], "removed": removed})
        draft, final = self.path(f"manifests/.draft-{uuid.uuid4().hex}"), self.path(f"manifests/v{version:012d}.json")
        self.fs.mkdirs(self.path("manifests"))
        stream = self.fs.create(draft, False)
        stream.write(bytearray(body.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(final), none)
        except Exception as e:
            self.fs.delete(draft, False)
            if self.fs.exists(final):
                raise Conflict(f"version {version} is taken") from e
            raise
        return version

    def _retried(self, change: Callable[[dict[str, Run]], tuple[list[Run], list[str]]], schema: dict | None = None, times: int = 10) -> int:
        for _ in range(times):
            base = self.version()
            try:
                return self.commit(base, *change(self._state(base)[0]), schema)
            except Conflict:
                continue
        raise Conflict(f"no version could be committed in {times} tries")

    def _checked(self, df: DataFrame) -> dict:
        """The schema of `df`, which has to be that of the store."""
        own = json.loads(df.schema.json())
        known = self._state(self.version())[1]
        kinds = lambda s: [(f.name, f.dataType) for f in StructType.fromJson(s).fields]
        if known and kinds(known) != kinds(own):
            raise ValueError("rows have to have the columns of the store")
        return own

    def written(self, run: str, rows: int, level: int) -> list[Run]:
        """The run of a finished write, none if it holds no row."""
        sizes = [s.getLen() for s in self.fs.listStatus(self.path(f"shards/{run}")) if s.getPath().getName().startswith("part-")]
        return [Run(f"shards/{run}", len(sizes), sum(sizes), rows, level)] if rows else []

    def append(self, df: DataFrame, per_file: int | None = None) -> int:
        """Write an arrival as it is partitioned, and commit; with `per_file`, files of at most so many rows.

        All rows and columns are kept as they are: nulls, empty and very long texts, repeated rows. An arrival without
        rows commits a version without a new run. Columns have to be those of earlier arrivals.
        """
        schema, run = self._checked(df), f"a-{uuid.uuid4().hex[:12]}"
        writer = df.write.option("compression", "zstd")
        if per_file:
            writer = writer.option("maxRecordsPerFile", per_file)
        writer.parquet(f"{self.root}/shards/{run}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/shards/{run}").count()
        added = self.written(run, rows, 0)
        return self._retried(lambda live: (added, []), schema)

    def append_arrivals(self, df: DataFrame, arrival: Column) -> int:
        """Several arrivals in one write: rows with the same value of `arrival`, an integer or null, are one arrival.

        Each is committed as a version of its own, in ascending order, null first. Rows and columns are kept as append()
        keeps them; without rows one version without a new run is committed.
        """
        schema, run = self._checked(df), f"b-{uuid.uuid4().hex[:12]}"
        (name,) = free_names(df.columns, "arrival")
        df.withColumn(name, arrival.cast("long")).write.partitionBy(name).option("compression", "zstd").parquet(f"{self.root}/shards/{run}")
        folders = {s.getPath().getName() for s in self.fs.listStatus(self.path(f"shards/{run}"))}
        folders = [f for f in folders if f.startswith(f"{name}=")]
        if not folders:
            return self._retried(lambda live: ([], []), schema)
        number = lambda f: int(f.split("=")[1]) if f.split("=")[1].lstrip("-").isdigit() else -math.inf
        folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
        read = self.spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{self.root}/shards/{run}")
        rows = {r.f: r["count"] for r in read.groupBy(folder.alias("f")).count().collect()}
        version = 0
        for f in sorted(folders, key=number):
            added = self.written(f"{run}/{f}", rows.get(f, 0), 0)
            version = self._retried(lambda live, added=added: (added, []), schema)
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """All live rows, and in `shard` (`_shard0` or so if the rows have a column of that name) their file's path below the store.

        A store whose versions hold no row gives an empty table with their columns; one without a version has none, which is an error.
        """
        live, schema = self._state(self.version() if version is None else version)
        if schema is None:
            raise ValueError("nothing was ever appended")
        kind = StructType.fromJson(schema)
        name = "shard" if "shard" not in {f.name.lower() for f in kind.fields} else free_names([f.name for f in kind.fields], "shard")[0]
        if not live:
            return self.spark.createDataFrame([], kind).withColumn(name, F.lit(""))
        df = self._runs(live.values(), kind)
        return df.withColumn(name, F.regexp_extract("_metadata.file_path", r"(shards/.*)$", 1))

    def _runs(self, runs, kind: StructType) -> DataFrame:
        return self.spark.read.schema(kind).option("recursiveFileLookup", True).parquet(*[f"{self.root}/{r.path}" for r in runs])

    def remove_dead(self, keep: int = 1) -> int:
        """Delete runs that none of the last `keep` versions lists, and versions that nobody needs; the number of runs deleted.

        Runs of writers that have not committed yet count as dead, so only one process may remove at a time, while none appends.
        """
        now, dead = self.version(), 0
        kept = range(max(1, now - keep + 1), now + 1)
        listed = {path for v in kept for path in self._state(v)[0]} if now else set()
        if self.fs.exists(self.path("shards")):
            for top in self.fs.listStatus(self.path("shards")):
                name = f"shards/{top.getPath().getName()}"
                inner = [f"{name}/{s.getPath().getName()}" for s in self.fs.listStatus(top.getPath()) if s.isDirectory() and not s.getPath().getName().startswith("_temporary")]
                for path in inner or [name]:
                    if path not in listed:
                        dead += bool(self.fs.delete(self.path(path), True))
                if inner and not any(path in listed for path in inner):
                    self.fs.delete(top.getPath(), True)
        # Versions back to the last whole one before the oldest that is kept are needed to read that.
        oldest = next((v for v in range(now - keep + 1, 0, -1) if self._entry(v)["whole"]), 0) if now else 0
        for v in self._versions():
            if v < oldest:
                self.fs.delete(self.path(f"manifests/v{v:012d}.json"), False)
        return dead

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Merge tiers that are due until none is; the version reached. Rows and columns are kept as they are.

        A merge reads the runs of one tier, writes files of about `target` bytes and commits them in the place of what
        it read. If another writer commits in between, the merge is committed on top, unless its input is gone.
        """
        while True:
            base = self.version()
            live, schema = self._state(base)
            due = due_runs(list(live.values()), target, fanout)
            if not due:
                return base
            taken = [r for p, r in live.items() if p in due]
            size, run = sum(r.size for r in taken), f"m-{uuid.uuid4().hex[:12]}"
            df = self._runs(taken, StructType.fromJson(schema))
            files = max(1, round(size / target))
            df = df.coalesce(files) if files < df.rdd.getNumPartitions() else df.repartition(files)
            df.write.option("compression", "zstd").parquet(f"{self.root}/shards/{run}")
            # A merge holds the rows that its runs held.
            merged = self.written(run, sum(r.rows for r in taken), 1 + max(r.level for r in taken))

            def swap(now: dict[str, Run], merged=merged, due=due) -> tuple[list[Run], list[str]]:
                if not due <= now.keys():
                    raise RuntimeError("a merge's input was merged by another writer")
                return merged, sorted(due)

            self._retried(swap)


def due_runs(live: list[Run], target: int, fanout: int) -> set[str]:
    """Paths of the runs of the lowest tier that has `fanout` of them; a run whose files have the target size is left alone."""
    tiers: dict[int, list[str]] = {}
    for r in live:
        if r.size / max(1, r.files) < target / 2:
            tiers.setdefault(int(math.log(max(r.size, 1), fanout)), []).append(r.path)
    # Sizes near a border of tiers count as similar, so neighbours are joined to the lower one.
    for tier in sorted(tiers):
        near = tiers[tier] + tiers.get(tier + 1, [])
        if len(near) >= fanout:
            return set(near)
    return set()
