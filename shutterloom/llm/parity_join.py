"""N-gram Jaccard join by parity sketches.

A document's distinct word shingles are XOR-hashed into a sketch: every shingle toggles its own bit, so the Hamming
distance of two sketches never exceeds the symmetric difference of the two sets. For a size band [low, high) the
threshold bounds that difference by d, so of d + 1 + s blocks of the sketch at least 1 + s are equal in a linking
pair: blocks are the join keys (pigeonhole). A block is 2^32 bits wide and held as the XOR of its shingles' 64-bit
hashes, which is a linear digest of its parity bits. Blocks with one shingle or none would be shared by chance; a
document leaves them out unless it has more than s of them, which loses no pair: if all 1 + s equal blocks of a pair
are such, both documents have more than s.

Documents that share a key are first compared with the key's smallest document, by compact sketches and, where these
cannot exclude a link, exactly. Only documents of a key that are then still in different components are compared with
each other, in blocks, in the same two steps. So large groups of copies cost one comparison per member and no link between components
is lost. Exact copies inside an input partition are folded before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mixed, shingle_sets, word_chunks
from .components import components
from .shared import Tables, text_or_empty, thrifty, tuned

_U = np.uint64
#: Bits of a compact sketch at least and at most; between, it has the power of two from twice the set's size on.
SKETCH_BITS, MOST_BITS = 512, 1 << 17
#: Ratio of the bounds of neighbouring size bands.
BAND_RATIO = 1.3
#: Documents of one key that are compared in one task at once.
BLOCK = 1024
#: Up to so many pairs, their ids are sent to where texts are read; beyond, texts are dealt by id to meet them.
SENT_PAIRS = 250_000
#: Members of one hub that are verified in one task, about.
MEMBERS = 2000
#: Distinct sets that a task remembers to fold copies by.
REMEMBERED = 200_000


@lru_cache(1 << 16)
def bands(n: int, num: int, den: int) -> tuple[tuple[int, int, int], ...]:
    """(band, blocks, spare blocks) of every band in which a set of n shingles takes part.

    Band g is for pairs whose smaller set has low(g) <= size < low(g + 1).
    """
    out, g, low = [], 0, 1
    while low <= n:
        following = max(low + 1, int(low * BAND_RATIO))
        most = (following - 1) * den // num
        if n <= most:
            d = (den - num) * (following - 1 + most) // (den + num)
            spare = int(0.12 * d)
            out.append((g, d + 1 + spare, spare))
        g, low = g + 1, following
    return tuple(out)


def block_keys(own: np.ndarray, num: int, den: int) -> np.ndarray:
    """Join keys of a sorted set of shingles."""
    keys, second = [], mixed(own ^ _U(0x5DEECE66D1234567))
    for g, blocks, spare in bands(len(own), num, den):
        block = ((own >> _U(32)) * _U(blocks)) >> _U(32)
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        parity = np.bitwise_xor.reduceat(second, first)
        count = np.diff(np.append(first, len(own)))
        rich = count > 1
        if blocks - int(rich.sum()) > spare:
            at = np.arange(blocks, dtype=np.uint64)
            value = np.zeros(blocks, np.uint64)
            value[block[first].astype(np.int64)] = parity
        else:
            at, value = block[first][rich], parity[rich]
        keys.append(mixed(mixed(value + _U(1)) + (_U(g) << _U(40)) + at))
    return np.concatenate(keys) if keys else own[:0]


def sketch(own: np.ndarray) -> bytes:
    """The compact parity sketch, one bit toggled by every shingle."""
    size = min(max(SKETCH_BITS, 1 << (2 * len(own) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((mixed(own + _U(77)) & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Sketches, one per row, as sketches of `width` words: the halves of a sketch are XORed, as its places coincide then."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def stacked(sketches: list[bytes]) -> np.ndarray:
    """Sketches of several sizes in one array, all folded to the smallest."""
    width = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), width), np.uint64)
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(sketches):
        by_size.setdefault(len(x), []).append(i)
    for size, rows in by_size.items():
        out[rows] = folded(np.frombuffer(b"".join([sketches[i] for i in rows]), np.uint64).reshape(-1, size // 8), width)
    return out


_PREPARED = "doc_id long, rep long, n_shingles long, sketch binary, keys array<long>"


def _prepare(q: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            reps, sizes, sketches, keys = [], [], [], []
            for words in word_chunks(batch.column(1)):
                for i, own in shingle_sets(words, q):
                    sizes.append(len(own))
                    rep, new = ids[i], False
                    if rep is not None and len(own):
                        if len(first) >= REMEMBERED:
                            first.clear()
                        digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                        rep = first.setdefault(digest, rep)
                        new = rep == ids[i]
                    reps.append(rep)
                    sketches.append(sketch(own) if new else None)
                    keys.append(block_keys(own, num, den).view(np.int64) if new else None)
            ends = np.cumsum([0] + [0 if k is None else len(k) for k in keys])
            flat = np.concatenate([k for k in keys if k is not None] or [np.zeros(0, np.int64)])
            columns = [
                batch.column(0).cast(pa.int64()),
                pa.array(reps, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(sketches, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rep", "n_shingles", "sketch", "keys"])

    return run


def _verify(q: int, num: int, den: int):
    """Rows (a, doc, text) sorted by a with the hub's own rows first: (a, b) for every b that links with a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hubs = None, []
        for batch in batches:
            tops, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found_a, found_b = [], []
            for words in word_chunks(batch.column(2)):
                for i, own in shingle_sets(words, q):
                    a, b = tops[i], docs[i]
                    if a != hub:
                        hub, hubs = a, []
                    if a == b:
                        hubs.append(own)
                        continue
                    for other in hubs:
                        small, large = len(own), len(other)
                        if min(small, large) * den < max(small, large) * num:
                            continue
                        both = np.concatenate((own, other))
                        both.sort()
                        shared = int((both[1:] == both[:-1]).sum())
                        if shared * den >= (small + large - shared) * num:
                            found_a.append(a)
                            found_b.append(b)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return run


def _plausible(num: int, den: int):
    """Rows (a, b, n_a, n_b, sketch_a, sketch_b): the pairs (a, b) that sizes and sketches do not exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (np.asarray(batch.column(k)) for k in (2, 3))
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            sizes = np.array([min(len(v), len(w)) for v, w in zip(x, y, strict=True)], np.int64)
            apart = np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                both = stacked([x[i] for i in rows] + [y[i] for i in rows])
                apart[rows] = np.bitwise_count(both[: len(rows)] ^ both[len(rows) :]).sum(1)
            good = (np.minimum(n_a, n_b) * den >= np.maximum(n_a, n_b) * num) & (apart * (den + num) <= (den - num) * (n_a + n_b))
            yield batch.select([0, 1]).filter(pa.array(good))

    return run


def _residual(num: int, den: int):
    """Rows (key, part, side, doc, component, n, sketch) sorted by key and part: pairs that may link."""
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])

    def pairs(rows: list[tuple], sent: set) -> Iterator[tuple[int, int]]:
        side, doc, comp, n = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        bits = stacked([r[4] for r in rows])
        left = np.flatnonzero(side <= 0)
        right = np.flatnonzero(side >= 0) if (side > 0).any() else left
        for i in left:
            j = right[(comp[right] != comp[i]) & (doc[right] != doc[i])]
            if right is left:
                j = j[doc[j] > doc[i]]
            j = j[(np.minimum(n[j], n[i]) * den >= np.maximum(n[j], n[i]) * num)]
            if len(j):
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1)
                for k in j[apart * (den + num) <= (den - num) * (n[j] + n[i])]:
                    pair = (min(doc[i], doc[k]), max(doc[i], doc[k]))
                    if pair not in sent:
                        if len(sent) > REMEMBERED:
                            sent.clear()
                        sent.add(pair)
                        yield pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, sent = None, [], set()

        def close() -> Iterator[pa.RecordBatch]:
            got = list(pairs(rows, sent)) if len(rows) > 1 else []
            for k in range(0, len(got), 10_000):
                a, b = zip(*got[k : k + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, part, *row in zip(*columns, strict=True):
                if (key, part) != at:
                    yield from close()
                    at, rows = (key, part), []
                rows.append(row)
        yield from close()
        yield empty

    return run


def parity_join(docs: DataFrame, tables: Tables, q: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (columns doc_id and text; others are not read).

    Two documents link when den * |intersection| >= num * |union| of their sets of q-word shingles. component_id is
    the smallest doc_id reachable by links. A null or wordless text has an empty set and links with nothing. A row
    without doc_id gets its set size and a null component. Rows that repeat a doc_id count as one node of the link
    graph: it has the links of each of its texts. Very long texts are read whole; their compact sketches stop growing,
    so that more of their pairs are verified. doc_id must be of an integer type. An empty table gives an empty table.
    """
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be of an integer type")
    spark = tuned(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ready = tables.put(texts.mapInArrow(thrifty(_prepare(q, num, den)), _PREPARED), "prepared")

    keys = ready.where("keys is not null").select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc"))
    # A key that very many documents share is one row per task here, and the join may split its rows.
    hubs = keys.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("top")).where("hub <> top").select("key", "hub")
    hubs = tables.put(hubs, "hubs")
    shared = tables.put(keys.join(hubs, "key").select("key", "doc", "hub"), "shared-keys")

    # The keys are most of what was written, and have served.
    written, ready = ready, tables.put(ready.drop("keys"), "sets")
    for done in (written, hubs):
        tables.drop(done)

    sizes = ready.where("sketch is not null").select(F.col("doc_id").alias("doc"), "n_shingles", "sketch")
    to_hub = shared.where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    for side in ("a", "b"):
        to_hub = to_hub.join(sizes.select(F.col("doc").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    to_hub = to_hub.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(thrifty(_plausible(num, den)), "a long, b long").distinct()
    links = tables.put(verified(texts, to_hub, tables, q, num, den), "hub-links")
    comps = components(links, tables)

    # The hub was compared with all, so a key is done unless other members are in different components.
    rest = shared.where("doc <> hub").join(comps.withColumnRenamed("id", "doc"), "doc", "left")
    rest = rest.select("key", "doc", F.coalesce("component", "doc").alias("comp"))
    open_keys = rest.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"))
    open_keys = open_keys.where("x <> y").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    rest = rest.join(tables.put(open_keys, "open-keys"), "key")
    own = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rest = rest.select("*", own.alias("own")).select("*", other).select(
        "key", (F.least("own", "other") * F.lit(1 << 20) + F.greatest("own", "other")).alias("part"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1).alias("side"), "doc", "comp",
    )
    rest = rest.join(sizes, "doc").select("key", "part", "side", "doc", "comp", "n_shingles", "sketch")
    rest = rest.repartition("key", "part").sortWithinPartitions("key", "part")
    more = rest.mapInArrow(thrifty(_residual(num, den)), "a long, b long").distinct()
    more = tables.put(verified(texts, tables.put(more, "residual"), tables, q, num, den), "more-links")

    folded = ready.where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    # Rows that share a doc_id are one node, so a folded row of that id may also stand for the id's other texts.
    every = links.unionByName(more).unionByName(folded)
    comps = components(every, tables)
    out = ready.select("doc_id", "n_shingles").join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def verified(texts: DataFrame, pairs: DataFrame, tables: Tables, q: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets. Members of a large hub are spread over several tasks."""
    pairs = tables.put(pairs, "pairs")
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("doc_id"))
    hubs = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc_id"))
    wanted = members.unionByName(hubs)
    if pairs.count() <= SENT_PAIRS:
        wanted = F.broadcast(wanted)  # at most twice as many rows of three numbers
    rows = texts.join(wanted, "doc_id").repartition("a", "part")
    rows = rows.select("a", "part", "doc_id", "text", (F.col("a") != F.col("doc_id")).alias("member"))
    rows = rows.sortWithinPartitions("a", "part", "member").select("a", "doc_id", "text")
    return rows.mapInArrow(thrifty(_verify(q, num, den)), "a long, b long").distinct()
