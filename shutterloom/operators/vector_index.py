"""A stored index of vectors: lists around pivots with bounds by the triangle inequality, for exact searches.

A vector lies in the list of the pivot at the smallest angle. By the angle of a query to a pivot, less the list's widest
angle, no vector of the list can score above a bound; lists whose bound is below the best scores found so far are left
out, the others are searched whole. So results are those of comparing all with all. How many lists fall out depends on
the vectors: all but a few where they lie in clusters, hardly any where they point everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import shared_folder, written
from .relational import blocks

#: Pivots at most; they are sent to every machine. Beside them, vectors without a direction have a list.
PIVOTS = 1024
#: Vectors of a list part, and of the parts that are sent to every machine at once, about.
MEMBERS, BLOCK = 256, 10_000
#: Vectors of the matrices that meet: queries, and members of lists.
QUERIES_AT_ONCE, MEMBERS_AT_ONCE = 1_024, 4_096
#: What a product of matrices can differ from a sum in order, for vectors of length one; all that may be best is summed again in order.
LOST = 1e-11
#: Added to bounds, for what is lost in angles and products.
SLACK = 1e-6
TINY = 1e-12


def _rows(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of double precision; those that are null or hold nulls count as zero, as their products do."""
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        if v is not None and len(v) == width:
            x = np.array([np.nan if y is None else y for y in v], float)
            if not np.isnan(x).any():
                out[k] = x
    return out


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.linalg.norm(x, axis=1)
    return x / np.where(n > 0, n, 1)[:, None], n


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes."""
    return [r.tobytes() for r in np.ascontiguousarray(x)]


def _unpacked(rows: Iterable[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), float).reshape(-1, width)


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


class VectorIndex:
    """Vectors (id, pos, emb) in lists, written under `path`: a table `lists` of (list, part, members), where a part has
    some MEMBERS vectors, and a table `pivots` of (list, pivot, widest, longest, rows).

    id may be of any type that orders; pos is a number that breaks ties, the smaller wins, then the smaller id. Vectors
    that are null, hold nulls or have another length than most are zero vectors, which have a list of their own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.lists = spark.read.parquet(f"{path}/lists")
        stats = spark.read.parquet(f"{path}/pivots").orderBy("list").toPandas()  # at most PIVOTS + 1 rows
        self.numbers = stats.list.to_numpy(int)
        self.pivots = np.stack([np.asarray(p, float) for p in stats["pivot"]]) if len(stats) else np.zeros((0, 1))
        self.widest, self.longest, self.sizes = (stats[c].to_numpy(float) for c in ("widest", "longest", "rows"))

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None) -> VectorIndex:
        """Index all rows of `vectors`. Pivots are a sample by hash of about the square root of the rows, at most PIVOTS."""
        spark = vectors.sparkSession
        path = path or f"{shared_folder(spark)}/index"
        vectors = vectors.select("id", "pos", "emb")
        known = vectors.where("emb IS NOT NULL AND size(emb) > 0")
        wanted = int(min(PIVOTS, max(1, round(known.count() ** 0.5))))
        sample = known.orderBy(F.xxhash64("id", "pos"), "id", "pos").limit(wanted).select("emb").toPandas().emb
        widths = [len(v) for v in sample]
        width = max(set(widths), key=widths.count) if widths else 1
        pivots, norms = _unit(_rows(sample, width))
        pivots = np.unique(pivots[norms > 0], axis=0)

        def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                clean = _rows(p.emb, width)
                unit, norm = _unit(clean)
                zero = norm == 0
                near, angle = np.full(len(p), len(pivots)), np.full(len(p), np.pi)
                if len(pivots):
                    cosine = unit @ pivots.T
                    near = np.where(zero, near, cosine.argmax(axis=1))
                    angle = np.where(zero, angle, np.arccos(np.clip(cosine.max(axis=1), -1, 1)))
                yield p.assign(list=near.astype("int32"), angle=angle, norm=norm, emb=_packed(clean))

        kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
        rows = written(vectors.mapInPandas(dealt, f"id {kinds['id']}, pos {kinds['pos']}, emb binary, list int, angle double, norm double"), "dealt")
        lists = rows.groupBy("list").agg(F.max("angle").alias("widest"), F.max("norm").alias("longest"), F.count("*").alias("rows"))
        centers = spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate([*pivots, np.zeros(width)])], "list int, pivot array<double>")
        lists.join(F.broadcast(centers), "list").write.parquet(f"{path}/pivots")
        sizes = spark.read.parquet(f"{path}/pivots").select("list", F.greatest(F.lit(1), F.ceil(F.col("rows") / MEMBERS)).cast("int").alias("parts"))
        rows = rows.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id", "pos"), F.col("parts")).cast("int"))  # PIVOTS + 1 rows
        rows.groupBy("list", "part").agg(F.count("*").alias("rows"), F.collect_list(F.struct("pos", "id", "emb", "norm")).alias("members")).write.parquet(f"{path}/lists")
        return cls(spark, path)

    def nearest(self, queries: DataFrame, k: int = 1, cosine: bool = True) -> DataFrame:
        """(query, id, pos, score, rank) of the k best for each of `queries` (query, emb) by cosine, or by inner product:
        higher scores first, of equal ones the smaller pos, then id. A zero vector's scores are 0. A query that occurs
        several times must do so with one vector."""
        kind = queries.schema["query"].dataType.simpleString()
        pivots, widest, longest, sizes, numbers, width = self.pivots, self.widest, self.longest, self.sizes, self.numbers, self.pivots.shape[1]

        def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                x = _rows(p.emb, width)
                yield p.assign(emb=_packed(x), norm=np.linalg.norm(x, axis=1))

        def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Of each query the lists of highest bounds that hold k vectors; with `least`, all others that could hold a better one."""
            for p in batches:
                unit, norm = _unit(_unpacked(p.emb, width))
                angle = np.arccos(np.clip(unit @ pivots.T, -1, 1)) - widest
                most = np.cos(np.clip(angle, 0, np.pi)) * (1 if cosine else norm[:, None] * longest) + SLACK
                order = np.argsort(-most, axis=1, kind="stable")
                first = np.minimum((np.cumsum(sizes[order], axis=1) < k).sum(axis=1) + 1, len(numbers))
                after = np.arange(len(numbers)) >= first[:, None]
                wanted = after & (np.take_along_axis(most, order, axis=1) >= p.least.to_numpy(float)[:, None]) if "least" in p else ~after
                yield p[["query", "emb", "norm"]].assign(lists=[numbers[o[w]].astype("int32") for o, w in zip(order, wanted, strict=True)])

        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        asked = queries.select("query", "emb").distinct().repartition(tasks, "query").mapInPandas(clean, f"query {kind}, emb binary, norm double")
        asked = written(asked, "asked").repartition(tasks, "query")
        shape = f"query {kind}, emb binary, norm double, lists array<int>"
        found = written(self._searched(asked.mapInPandas(lists, shape), k, cosine), "first")
        least = found.groupBy(F.col("query").alias("_query")).agg(F.min("score").alias("least"), F.count("*").alias("n"))
        rest = asked.join(least, F.col("query").eqNullSafe(F.col("_query")), "left").select("query", "emb", "norm", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("least"))
        rest = rest.repartition(tasks, "query").mapInPandas(lists, shape).where("size(lists) > 0")
        return self._best(found.drop("rank").unionByName(self._searched(rest, k, cosine).drop("rank")), k)

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "pos", "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _searched(self, asked: DataFrame, k: int, cosine: bool) -> DataFrame:
        """The k best of the lists of each query (query, emb, norm, lists). Queries and members of lists meet as matrices; the
        side with fewer vectors is sent to the other, in blocks."""
        queries, width = self._matrices_of(asked), self.pivots.shape[1]
        kinds = {f.name: f.dataType.simpleString() for f in self.lists.schema["members"].dataType.elementType.fields}
        kind = asked.schema["query"].dataType.simpleString()
        if self.sizes.sum() <= asked.count():
            pairs = [queries.crossJoin(F.broadcast(self._members(block, k))) for block in self._blocks()]
        else:
            tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            members = self._members(self.lists.repartitionByRange(tasks, "list", "part"), k)
            pairs = [members.crossJoin(F.broadcast(self._matrices_of(block))) for block in blocks(asked, "query")]

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                for r in p.itertuples(index=False):
                    x, y = (np.frombuffer(b, float).reshape(-1, width) for b in (r.queries, r.members))
                    i, j, score = _met(x, np.asarray(r.query_norms), np.split(r.query_lists, np.cumsum(r.query_sizes)[:-1]), y, np.asarray(r.norms), np.asarray(r.lists), k, cosine)
                    yield pd.DataFrame({"query": np.asarray(r.query)[i], "id": np.asarray(r.id)[j], "pos": np.asarray(r.pos)[j], "score": score})

        found = None
        for met in pairs:
            rows = met.mapInPandas(best, f"query {kind}, id {kinds['id']}, pos {kinds['pos']}, score double")
            found = rows if found is None else found.unionByName(rows)
        return self._best(found, k)

    @staticmethod
    def _matrices_of(asked: DataFrame) -> DataFrame:
        """Queries as matrices of QUERIES_AT_ONCE rows at most, those of a task that want the same list first beside each other."""
        kind = asked.schema["query"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                p = p[[len(x) > 0 for x in p.lists]]
                p = p.iloc[np.argsort([x[0] for x in p.lists], kind="stable")]
                for at in range(0, len(p), QUERIES_AT_ONCE):
                    q = p.iloc[at : at + QUERIES_AT_ONCE]
                    yield pd.DataFrame({"query": [q["query"].tolist()], "queries": [b"".join(q.emb)], "query_norms": [q.norm.to_numpy()], "query_lists": [np.concatenate(q.lists.to_numpy())], "query_sizes": [q.lists.map(len).to_numpy("int32")]})

        return asked.mapInPandas(run, f"query array<{kind}>, queries binary, query_norms array<double>, query_lists array<int>, query_sizes array<int>")

    def _members(self, parts: DataFrame, k: int) -> DataFrame:
        """Members of list parts as matrices of about MEMBERS_AT_ONCE rows, in order of list, pos and id. Of equal vectors of
        a matrix only the first k can be among the k best; the others go."""
        kinds = {f.name: f.dataType.simpleString() for f in self.lists.schema["members"].dataType.elementType.fields}

        def matrix(rows: list[pd.DataFrame]) -> pd.DataFrame:
            p = pd.concat(rows).sort_values(["list", "pos", "id"], kind="stable", na_position="first")
            p = p[p.groupby(["list", "emb"], sort=False).cumcount() < k]
            return pd.DataFrame({"lists": [p.list.to_numpy("int32")], "id": [p.id.tolist()], "pos": [p.pos.tolist()], "members": [b"".join(p.emb)], "norms": [p.norm.to_numpy()]})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows, n = [], 0
            for p in batches:
                for r in p.itertuples(index=False):
                    rows.append(pd.DataFrame([tuple(m[c] for c in ("pos", "id", "emb", "norm")) for m in r.members], columns=["pos", "id", "emb", "norm"], dtype=object).astype({"norm": float}).assign(list=r.list))
                    n += len(rows[-1])
                    if n >= MEMBERS_AT_ONCE:
                        yield matrix(rows)
                        rows, n = [], 0
            if rows:
                yield matrix(rows)

        return parts.select("list", "members").mapInPandas(run, f"lists array<int>, id array<{kinds['id']}>, pos array<{kinds['pos']}>, members binary, norms array<double>")

    def _blocks(self) -> list[DataFrame]:
        """The list parts in blocks of about BLOCK vectors."""
        n = max(1, int(-(-self.sizes.sum() // BLOCK)))
        rows = self.lists
        return [rows.where(F.pmod(F.xxhash64("list", "part"), F.lit(n)) == i) for i in range(n)] if n > 1 else [rows]


def _met(x: np.ndarray, x_norms: np.ndarray, wanted: list[np.ndarray], y: np.ndarray, y_norms: np.ndarray, lists: np.ndarray, k: int, cosine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, place in y, score) of the k best rows of y, of the lists that each row of x wants, with all that tie with
    the last. `lists` ascends."""
    who = np.repeat(np.arange(len(x)), [len(w) for w in wanted])
    what = np.concatenate(wanted) if len(wanted) else np.empty(0, int)
    order = np.argsort(what, kind="stable")
    who, what = who[order], what[order]
    reached = np.full(len(x), -np.inf)
    longest = y_norms.max(initial=0.0)
    slack = LOST * (np.ones(len(x)) if cosine else np.maximum(x_norms * longest, TINY))
    found = []
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if len(lists) else np.empty(0, int)
    for start, end in zip(starts, [*starts[1:], len(lists)], strict=True):
        q = who[np.searchsorted(what, lists[start]) : np.searchsorted(what, lists[start], "right")]
        for at in range(0, len(q), 256):
            rows = q[at : at + 256]
            zero = rows[x_norms[rows] == 0]  # all scores are zero
            for i in zero:
                found.append((np.full(min(k, end - start), i), start + np.arange(min(k, end - start))))
            rows = rows[x_norms[rows] != 0]
            s = x[rows] @ y[start:end].T
            if cosine:
                s /= x_norms[rows][:, None] * y_norms[start:end] + TINY
            if end - start >= k:
                reached[rows] = np.maximum(reached[rows], np.partition(s, -k, axis=1)[:, -k])
            i, j = np.nonzero(s >= (reached[rows] - slack[rows])[:, None])
            found.append((rows[i], start + j))
    i, j = (np.concatenate([f[c] for f in found]).astype(int) if found else np.empty(0, int) for c in (0, 1))
    score = np.zeros(len(i))
    for at in range(0, len(i), 65_536):
        part = slice(at, at + 65_536)
        score[part] = _in_order(x[i[part]], y[j[part]])
        if cosine:
            score[part] /= x_norms[i[part]] * y_norms[j[part]] + TINY
    # All of a place that ties with its k-th best stay: rows of several lists are not in one order.
    order = np.lexsort((-score, i))
    i, j, score = i[order], j[order], score[order]
    begin = np.searchsorted(i, i)
    last = np.minimum(begin + k - 1, np.searchsorted(i, i, "right") - 1)
    kept = score >= score[last]
    return i[kept], j[kept], score[kept]
