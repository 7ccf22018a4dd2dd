"""Exact dedup by recipes of content-defined chunks.

A text is cut where a hash of the bytes just before says so, so equal texts are cut alike. Each distinct chunk leaves a
task once and is compared by its bytes, which proves that identifiers stand for one chunk each; where one stands for
two, identifiers are made longer. A text is then the list of its identifiers, and texts are equal if their lists are.
Lists are a hundredth of the texts: long texts are neither sorted, nor joined, nor moved whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .bytewords import string_bytes
from .shared import Tables, free_names, text_or_empty, tuned

#: Bytes of a chunk: at least, on average beyond that, and at most.
LEAST, MEAN, MOST = 256, 1024, 8192
#: Hashes of an identifier at first, and bits of each.
HASHES, BITS = 2, 64
#: Bytes hashed at once, and bytes that the hash at a place looks back on.
PIECE, WINDOW = 1 << 20, 32
_BYTE = np.random.default_rng(20240311).integers(0, 1 << 32, 256, dtype=np.uint32)


def _cuts(data: np.ndarray, mean: int) -> np.ndarray:
    """Places where the hash of the WINDOW bytes before is a multiple of `mean`."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(data), PIECE):
        begin = max(0, at - WINDOW + 1)
        h = _BYTE[data[begin : at + PIECE]]
        reach = 1
        while reach < WINDOW:  # a window is two windows of half its size
            wider = h.copy()
            wider[reach:] += h[:-reach] * np.uint32(pow(0x9E3779B1, reach, 1 << 32))
            h, reach = wider, 2 * reach
        out.append(np.flatnonzero((h[at - begin :] >> np.uint32(7)) % np.uint32(mean) == 0) + at + 1)
    return np.concatenate(out)


def chunk_ends(offsets: np.ndarray, data: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[list[int]]:
    """Of each text, where its chunks end, counted in bytes from its beginning; an empty text has no chunk.

    Only the text's own bytes matter: windows that reach back beyond its beginning are left out.
    """
    cuts, out = _cuts(data, mean), []
    first, last = np.searchsorted(cuts, offsets[:-1] + WINDOW), np.searchsorted(cuts, offsets[1:])
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), last.tolist(), strict=True):
        ends, at = [], a
        for cut in [*cuts[i:j].tolist(), b] if b > a else ():
            while cut - at > most:
                at += most
                ends.append(at - a)
            if cut - at >= least or cut == b:
                at = cut
                ends.append(at - a)
        out.append(ends)
    return out


@F.arrow_udf(ArrayType(IntegerType()))
def _ends(texts: pa.Array) -> pa.Array:
    return pa.array(chunk_ends(*string_bytes(texts)), pa.list_(pa.int32()))


def _chunks(raw: Column, ends: Column) -> Column:
    """The chunks of the bytes `raw`, in order."""

    def chunk(end: Column, k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
        return F.substring(raw, begin + 1, end - begin)

    return F.transform(ends, chunk)


def _hashes(chunk: Column, hashes: int, bits: int) -> Column:
    """An identifier: independent hashes of a chunk (each has another beginning)."""
    return F.array(*[F.shiftrightunsigned(F.xxhash64(F.lit(k), chunk), 64 - bits) for k in range(hashes)])


def _ambiguous(docs: DataFrame, hashes: int, bits: int) -> bool:
    """Whether two different chunks share an identifier; each distinct chunk is moved once from each task."""
    raw = docs.select(text_or_empty().cast("binary").alias("raw"), _ends(text_or_empty()).alias("ends"))
    chunk = raw.select(F.explode(_chunks(F.col("raw"), F.col("ends"))).alias("chunk")).distinct()
    return not chunk.groupBy(_hashes(F.col("chunk"), hashes, bits).alias("id")).count().where("count > 1").isEmpty()


def exact_copies(docs: DataFrame, tables: Tables, hashes: int = HASHES, bits: int = BITS) -> DataFrame:
    """`docs` (doc_id, text, ...) without text, plus keep_id, group_size, kept and n_chunks.

    Texts are equal if their bytes are. Of equal texts the row with the largest doc_id is kept (a null id is less than
    any other); of rows that also have that doc_id in common one is kept. keep_id is the kept row's doc_id and
    group_size the number of rows with the text. Null counts as empty text; empty texts are equal. Every row is
    returned, and whole texts are compared. Columns of `docs` named as the added ones are replaced. An empty table
    gives an empty table. No group meets in one task: groups are counted by partial aggregation, and the join that
    tells their rows is split where it is skewed.
    """
    tuned(docs.sparkSession)
    while _ambiguous(docs, hashes, bits):
        hashes += 1
    added = ("keep_id", "group_size", "kept", "n_chunks")
    carried = [c for c in docs.columns if c.lower() not in ("text", *added)]
    raw, ends, recipe, row, mark, kept_row = free_names([*docs.columns, *added], "raw", "ends", "recipe", "row", "mark", "kept_row")
    cut = docs.select(*[F.col(f"`{c}`") for c in carried], text_or_empty().cast("binary").alias(raw), _ends(text_or_empty()).alias(ends))
    ids = F.flatten(F.transform(_chunks(F.col(raw), F.col(ends)), lambda c: _hashes(c, hashes, bits)))
    rows = cut.select(*[f"`{c}`" for c in carried], F.size(ends).alias("n_chunks"), ids.alias(recipe), F.monotonically_increasing_id().alias(row))
    # The numbers of rows hold from here on, as they are read from this table.
    rows = tables.put(rows.withColumn(mark, F.xxhash64(recipe)), "recipes")
    by = [mark, recipe]
    each = rows.groupBy(*by, "doc_id").agg(F.count("*").alias("n"), F.max(row).alias(row))
    groups = each.groupBy(*by).agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.coalesce(F.max_by(row, "doc_id"), F.max(row)).alias(kept_row))
    several = groups.where("group_size > 1")
    found = rows.join(several, by, "left")
    alone = F.col("group_size").isNull()
    return found.select(
        *[F.col(f"`{c}`") for c in carried], F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col(row) == F.col(kept_row))).alias("kept"), "n_chunks",
    )


def exact_copies_sql(docs: str = "documents") -> str:
    """Columns doc_id, keep_id, group_size, kept and text_sha256 in DuckDB SQL."""
    same = "PARTITION BY coalesce(text, '')"
    return f"""SELECT doc_id, max(doc_id) OVER ({same}) AS keep_id, count(*) OVER ({same}) AS group_size,
    row_number() OVER ({same} ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM {docs}"""
