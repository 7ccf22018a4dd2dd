"""Pairs of vectors, by blocks of rows that meet as matrices: a task holds two blocks, and pairs leave it in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import TINY
from ..sources.folders import written

#: Rows of a block, about, and pairs that are looked at and sent at once, about.
BLOCK, PAIRS_AT_ONCE = 2_048, 262_144
#: What a product of matrices can differ from a sum in order, by far, for vectors of length one.
LOST = 1e-9


class Numbers:
    """Numbers of which some may be unknown."""

    def __init__(self, values: pa.Array):
        self.known = values.is_valid().to_numpy(zero_copy_only=False)
        self.values = values.fill_null(0).to_numpy(zero_copy_only=False)

    def apart(self, i: np.ndarray, other: Numbers, j: np.ndarray) -> np.ndarray:
        """Differences, NaN where a number is unknown."""
        return np.where(self.known[i] & other.known[j], self.values[i] - other.values[j], np.nan)


class Block:
    """Rows of a block. Vectors of one length are a matrix; those without a norm (null, or with nulls) are in none."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        norms, vectors = rows["norm"].combine_chunks(), rows["emb"].combine_chunks()
        self.known = norms.is_valid().to_numpy(zero_copy_only=False)
        self.norms = norms.fill_null(0.0).to_numpy()
        self.lengths = np.where(self.known, vectors.value_lengths().fill_null(-1).to_numpy(), -1)
        self.place, self.parts = np.zeros(len(rows), int), {}
        for width in np.unique(self.lengths[self.known]).tolist():
            at = np.flatnonzero(self.lengths == width)
            self.place[at] = np.arange(len(at))
            self.parts[width] = at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), width)

    def __len__(self) -> int:
        return len(self.rows)

    def column(self, name: str) -> np.ndarray:
        return self.rows[name].combine_chunks().to_numpy(zero_copy_only=False)

    def numbers(self, name: str) -> Numbers:
        return Numbers(self.rows[name].combine_chunks())

    def cosines(self, start: int, end: int, other: Block) -> np.ndarray:
        """X04 of some rows and all of another block; vectors of different lengths have a product of 0."""
        dots = np.zeros((end - start, len(other)))
        for width, (at, x) in self.parts.items():
            if width in other.parts:
                theirs, y = other.parts[width]
                low, high = np.searchsorted(at, (start, end))
                if high - low == end - start and len(theirs) == len(other):
                    dots = x[low:high] @ y.T
                else:
                    dots[np.ix_(at[low:high] - start, theirs)] = x[low:high] @ y.T
        return dots / (self.norms[start:end, None] * other.norms + TINY)

    def cosines_in_order(self, i: np.ndarray, other: Block, j: np.ndarray) -> np.ndarray:
        """X04 of single pairs, summed in the order of the components, as in vectors.cosine()."""
        dots = np.zeros(len(i))
        for width, (_, x) in self.parts.items():
            if width in other.parts:
                met = np.flatnonzero((self.lengths[i] == width) & (other.lengths[j] == width))
                a, b, total = self.place[i[met]], other.place[j[met]], np.zeros(len(met))
                y = other.parts[width][1]
                for d in range(width):
                    total += x[a, d] * y[b, d]
                dots[met] = total
        return dots / (self.norms[i] * other.norms[j] + TINY)


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def met_in_blocks(rows: DataFrame, by: Sequence[str], block: int, pairs: Callable[[Block, Block, bool], Iterator[Found]]) -> DataFrame:
    """(first of `by`, a, b, cosine) of what `pairs` finds of rows (by, key, emb, norm, ...) that agree in `by`, a < b.

    Rows of one value of `by` are dealt into blocks of about `block` rows by a hash of the key, and every two blocks meet
    once, as does each with itself: pairs(left, right, same) gives (place in left, place in right, cosine, is known), with
    each pair of places once; a pair of equal keys or, in one block, the wrong way round is dropped here. Rows with a null
    in `by` or the key meet none.
    """
    by = list(by)
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in [*by, "key"]))
    large = written(rows.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).where("_blocks > 1"), "large")
    # At most one of `block` rows.
    dealt = rows.join(large, by, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int"))
    # Block i meets blocks i and above: each row is sent once for each block that it meets.
    sent = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    sent = sent.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_other", "_blocks")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = by[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        table = table.take(pc.sort_indices(table, [("key", "ascending")]))
        own, one, i, j = table["_own"].to_numpy(), table[head][0], table["_i"][0].as_py(), table["_j"][0].as_py()
        left, right = (Block(table.filter(pa.array(own == k))) for k in (i, j))
        if not len(left) or not len(right):
            return
        kind, mine, theirs = table.schema.field("key").type, left.column("key"), right.column("key")
        with np.errstate(all="ignore"):
            for x, y, cosine, known in pairs(left, right, i == j):
                a, b = mine[x], theirs[y]
                kept = a < b if i == j else a != b
                if not kept.all():
                    a, b, cosine, known = a[kept], b[kept], cosine[kept], known[kept]
                a, b = (a, b) if i == j else (np.where(a < b, a, b), np.where(a < b, b, a))
                yield pa.record_batch([pa.repeat(one, len(a)), pa.array(a, kind), pa.array(b, kind), pa.array(cosine, pa.float64(), mask=~known)], [head, "a", "b", "cosine"])

    # Blocks hold few bytes and many pairs, so they are dealt to all tasks, however little there is to send.
    keys = [*by, "_i", "_j"]
    sent = sent.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return sent.groupBy(*keys).applyInArrow(run, f"{head} {kinds[head]}, a {kinds['key']}, b {kinds['key']}, cosine double")


def steps_of(left: Block, right: Block) -> Iterator[tuple[int, int]]:
    """Ranges of rows of `left` that make about PAIRS_AT_ONCE pairs with all of `right`."""
    step = max(1, PAIRS_AT_ONCE // len(right))
    return ((at, min(at + step, len(left))) for at in range(0, len(left), step))


def all_pairs(left: Block, right: Block, same: bool) -> Iterator[Found]:
    """All pairs; rows of a block are in order of their keys, so those of a block with itself stand above the diagonal."""
    for start, end in steps_of(left, right):
        cosine = left.cosines(start, end, right)
        i, j = np.nonzero(np.arange(start, end)[:, None] < np.arange(len(right))) if same else (np.repeat(np.arange(end - start), len(right)), np.tile(np.arange(len(right)), end - start))
        cosine = cosine[i, j] if same else cosine.ravel()
        yield i + start, j, cosine, left.known[i + start] & right.known[j]
