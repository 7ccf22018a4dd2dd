"""Repeated passages by sparse suffix arrays.

Of all suffixes of the corpus (a suffix starts at a word) only those at minimiser positions are kept: in every run of
`window` places the one whose next `prefix` words hash lowest. Two occurrences of a passage of `least` = window +
prefix - 1 or more words keep suffixes at the same places of it. Kept suffixes whose beginning no other has go first.

Each of the others gets the words to its left and right that a passage anchored at it can reach. Suffixes are sorted
by their beginnings and compared with their neighbours; a match is extended left and right, so that each passage of
`least` words around the suffix is known to be repeated or not. Hashes only bring candidates beside each other: a
passage counts as repeated when all its words are equal, word for word. Passages that overlap grow into one span.

A beginning that very many suffixes share is dealt by whole passages instead, so its rows are spread over tasks, and a
task sends equal surroundings twice at most: further copies are known to be repeated where they are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import _BLANK, _LOWER, _PLACE, _U, Words, grams, mixed, word_chunks
from .shared import Tables, free_names, one_row_each, sent_if_small, text_mark, text_or_empty, thrifty, tuned

#: Words of the start of a suffix by which suffixes are sorted.
PREFIX = 25
#: Suffixes with one beginning that are compared in one task; beyond, their passages are dealt one by one.
MANY = 10_000
#: Bytes of surroundings that are compared at once, and that a task remembers to know copies by.
COMPARED, REMEMBERED = 4 << 20, 16 << 20


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours, by doubling."""
    width, out = 1, x
    while width * 2 <= w:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    if width < w:
        out = np.minimum(out[: len(out) - (w - width)], out[w - width :])
    return out


def minimisers(own: np.ndarray, w: int) -> np.ndarray:
    """Places of a document's grams `own` that are least in a run of w neighbours; of equal ones, all."""
    if len(own) < w:
        return np.zeros(0, np.int64)
    least = _window_minima(own, w)
    # A place is kept if it equals the minimum of some run that covers it, which is the largest of those minima.
    padded = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
    top = ~_window_minima(~padded, w)
    return np.flatnonzero(own == top)


def long_grams(hashes: np.ndarray, q: int) -> np.ndarray:
    """As grams(), for large q: by doubling, so that the cost grows with log q."""
    if q <= 4:
        return grams(hashes, q)
    half = q // 2
    part = long_grams(hashes, half)
    n = len(hashes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    rest = part[q - half : q - half + n]
    return mixed(part[:n] * _PLACE[0] + rest * _PLACE[1] + (part[half : half + n] * _PLACE[2] if q - half > half else _U(0)) + _U(q))


_KEPT = "key long, doc long, mark long, place int"


def _kept_suffixes(k: int, window: int):
    """The kept suffixes of each text, with the hash of their first k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, marks = (np.asarray(batch.column(c)) for c in (0, 1))
            for words in word_chunks(batch.column(2)):
                every = long_grams(words.hashes, k)
                keys, rows, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in range(len(words)):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    if b - a >= k + window - 1:
                        own = every[a : b - k + 1]
                        at = minimisers(own, window)
                        keys.append(own[at])
                        places.append(at)
                        rows.append(np.full(len(at), words.first + i))
                rows = np.concatenate(rows)
                columns = [np.concatenate(keys).view(np.int64), docs[rows], marks[rows], np.concatenate(places).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc", "mark", "place"])

    return run


def _spelled(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words of a chunk, lower-cased, each with one blank behind it: where they start (and the end), and the bytes."""
    sizes = words.ends - words.starts
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.full(int(starts[-1]), 0x20, np.uint8)
    out[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = _LOWER[words.data[~_BLANK[words.data]]]
    return starts, out


_AROUND = "deal long, doc long, mark long, place int, passages int, words binary"


class _Sent:
    """Surroundings that a task has sent, by their words, up to a bound of bytes."""

    def __init__(self):
        self.seen: dict[tuple[bytes, int], list] = {}
        self.size = 0

    def verdict(self, words: bytes, passages: int, at: tuple) -> str:
        """send: the first two of their kind; repeat: the same place again; known: sent twice from places before `at`."""
        found = self.seen.get((words, passages))
        if found is None:
            if self.size > REMEMBERED:
                self.seen.clear()
                self.size = 0
            self.seen[words, passages] = [at]
            self.size += len(words) + 200
            return "send"
        if at in found:
            return "repeat"
        if len(found) < 2:
            found.append(at)
            return "send"
        if at > min(found):
            return "known"
        found[:] = [at, min(found)]
        return "send"


def _surroundings(k: int, window: int):
    """For each suffix at hand the passages anchored at it: the place of the first, their number, and all their words.

    `places` holds 2 * place + 1 where the beginning is shared by very many, else 2 * place.
    """
    least = k + window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent()
        for batch in batches:
            docs, marks = (batch.column(c).to_pylist() for c in (0, 1))
            for words in word_chunks(batch.column(2)):
                starts, data = _spelled(words)
                short, full = long_grams(words.hashes, k), long_grams(words.hashes, least)
                out: list[tuple] = []

                def add(row: int, a: int, x: int, n: int, deal: np.uint64, data=data, starts=starts, out=out) -> None:
                    held = data[starts[a + x] : starts[a + x + n - 1 + least]].tobytes()
                    at = (docs[row], marks[row], x)
                    verdict = sent.verdict(held, n, at)
                    if verdict == "send":
                        out.append((int(deal.view(np.int64)), *at, n, held))
                    elif verdict == "known":
                        # Nothing more has to be learned of it, so it goes anywhere.
                        out.append((hash(at), *at, n, None))

                for i in range(len(words)):
                    a, b, row = int(words.bounds[i]), int(words.bounds[i + 1]), words.first + i
                    if b - a < least:
                        continue
                    at = np.unique(np.frombuffer(batch.column(3)[row].as_buffer(), np.int32))
                    own = short[a : b - k + 1]
                    anchor = sliding_window_view(own, window).argmin(1) + np.arange(len(own) - window + 1)
                    low, high = np.searchsorted(anchor, at >> 1, "left").tolist(), np.searchsorted(anchor, at >> 1, "right").tolist()
                    for place, x, y in zip(at.tolist(), low, high, strict=True):
                        if place & 1:
                            for z in range(x, y):
                                add(row, a, z, 1, full[a + z])
                        elif x < y:
                            add(row, a, x, y - x, own[place >> 1])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["deal", "doc", "mark", "place", "passages", "words"])

    return run


def passage_hashes(ids: np.ndarray, least: int) -> np.ndarray:
    """Brings equal passages beside each other; need not be unique."""
    return long_grams(mixed(ids.astype(np.uint64) + _U(1)), least)


def _classes(ids: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the passages that start at `at` in an order in which equal ones are neighbours and ties stay in
    place, and whether each differs from the one before it, compared word by word."""
    hashes = passage_hashes(ids, least)[at]
    order = np.argsort(hashes, kind="stable")
    h, place = hashes[order], at[order]
    near = np.flatnonzero(h[1:] == h[:-1])
    equal = np.ones(len(near), bool)
    for j in range(least):
        equal &= ids[place[near] + j] == ids[place[near + 1] + j]
    new = np.ones(len(order), bool)
    new[near + 1] = ~equal
    # Runs of one hash that hold different words are sorted by the words themselves.
    run = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
    for r in np.unique(run[near[~equal] + 1]).tolist():
        a, b = np.searchsorted(run, (r, r + 1)).tolist()
        groups: dict[bytes, list[int]] = {}
        for p in range(a, b):
            groups.setdefault(ids[place[p] : place[p] + least].tobytes(), []).append(p)
        order[a:b] = order[[p for g in groups.values() for p in g]]
        new[a:b] = [p == g[0] for g in groups.values() for p in g]
    return order, new


def _compared_rows(rows: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """(doc, mark, place, later, first) of surroundings, all of their beginnings: bit j of `later` is set if the passage
    at place + j repeats one that comes before it, bit j of `first` if it is repeated and comes first."""
    docs, marks, places, counts = (np.asarray(rows.column(c)).astype(np.int64) for c in (1, 2, 3, 4))
    known = np.asarray(rows.column(5).is_null())
    later = np.where(known, (np.int64(1) << counts) - 1, 0)
    first = np.zeros(len(rows), np.int64)
    at = np.flatnonzero(~known)
    if len(at):
        column = rows.column(5).take(pa.array(at))
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int32)[: len(at) + 1]
        data = np.frombuffer(data, np.uint8)[: offsets[-1]]
        ends = (np.flatnonzero(data == 0x20) + 1).astype(np.int32)
        spelled = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate((np.zeros(1, np.int32), ends))), pa.py_buffer(data)])
        ids = np.asarray(spelled.dictionary_encode().indices).astype(np.int32)
        begin = np.searchsorted(ends, offsets[:-1], "right")
        n = counts[at]
        row = np.repeat(np.arange(len(at)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        order, new = _classes(ids, begin[row] + step, least)
        row, step = row[order], step[order]
        own = (docs[at[row]], marks[at[row]], places[at[row]] + step)
        moved = np.ones(len(row), bool)
        moved[1:] = (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1]) | (own[2][1:] != own[2][:-1])
        nth = np.cumsum(moved)
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(row)))
        nth -= np.repeat(nth[starts], size)
        several = np.repeat(np.maximum.reduceat(nth, starts) > 0, size)
        bit = np.int64(1) << step
        np.bitwise_or.at(later, at[row], np.where(nth > 0, bit, 0))
        np.bitwise_or.at(first, at[row], np.where(several & (nth == 0), bit, 0))
    some = np.flatnonzero((later | first) != 0)
    columns = [docs[some], marks[some], places[some].astype(np.int32), later[some], first[some]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "mark", "place", "later", "first"])


_FOUND = "doc long, mark long, place int, later long, first long"


def _compared(least: int):
    """Rows sorted by deal, doc, mark and place; whole beginnings are compared, several at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= COMPARED:
                rows = pa.concat_batches(held)
                deals = np.asarray(rows.column(0))
                cut = int(np.searchsorted(deals, deals[-1], "left"))
                if cut:
                    yield _compared_rows(rows.slice(0, cut), least)
                held, size = [rows.slice(cut)], rows.slice(cut).nbytes
        if held:
            yield _compared_rows(pa.concat_batches(held), least)

    return run


def _packed_places(places: DataFrame) -> DataFrame:
    """(doc, mark, places): those of a text, as packed 32-bit integers; bounded by its length."""
    rows = places.groupBy("doc", "mark").agg(F.collect_list("place").alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.asarray(x.values, np.int32).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc", "mark", "places"])

    return rows.mapInArrow(thrifty(run), "doc long, mark long, places binary")


def _starts_of(found: DataFrame) -> DataFrame:
    """(doc_id, mark, later, first): ascending places of a text at which repeated passages start."""
    rows = found.groupBy("doc", "mark").agg(F.collect_list(F.struct("place", "later", "first")).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], []]
            for x in batch.column(2):
                place, *masks = (np.asarray(x.values.field(c)).astype(np.int64) for c in range(3))
                # One place is seen once, but a text that is there twice may be told of a place twice.
                for kind, mask in enumerate(masks):
                    row, bit = np.nonzero((mask[:, None] >> np.arange(63)) & 1)
                    out[kind].append(np.unique(place[row] + bit).astype(np.int32))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, part)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *part]))) for part in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "mark", "later", "first"])

    return rows.mapInArrow(thrifty(run), "doc_id long, mark long, later array<int>, first array<int>")


def _ordered(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, mark, text, places), in the order of doc and mark within a partition: what a task has sent before decides what
    it sends, so a task that runs again has to meet its rows in the same order."""
    return texts.join(places, ["doc", "mark"]).select("doc", "mark", "text", "places").sortWithinPartitions("doc", "mark")


def repeats(docs: DataFrame, tables: Tables, least: int = 50, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, mark, later, first, copies, words) of each text with a passage of `least` or more words that occurs elsewhere.

    first and later are ascending word places at which such passages start: `later` where an equal passage comes before
    it (in a smaller doc_id; in the same doc_id in a text of smaller mark; or earlier in the same text), `first` where
    none does. mark hashes the text, so rows that share a doc_id but not the text are texts of their own. Rows that
    share both are one text with `copies` rows, which then is here, with its number of `words`, if it has `least` words;
    else copies is 1 and words null. Rows with null doc_id, and null, empty or shorter texts, have no passage. Words
    are as long as they are; very long texts are read in pieces of whole documents. Other columns are not read, so
    their names cannot clash. An empty table gives an empty table.
    """
    if not 4 < prefix < least < prefix + 63:
        raise ValueError("prefix must be above 4, below least and at most 62 below it")
    tuned(docs.sparkSession)
    window = least - prefix + 1
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), text_mark().alias("mark"), text_or_empty().alias("text"))
    kept = tables.put(texts.mapInArrow(thrifty(_kept_suffixes(prefix, window)), _KEPT), "suffixes")
    shared = tables.put(kept.groupBy("key").count().where("count > 1").select("key", (F.col("count") > MANY).cast("int").alias("many")), "beginnings")
    places = kept.join(shared, "key").select("doc", "mark", (F.col("place") * 2 + F.col("many")).alias("place"))
    places = tables.put(_packed_places(places), "places")
    for done in (kept, shared):
        tables.drop(done)

    around = _ordered(texts, places).mapInArrow(thrifty(_surroundings(prefix, window)), _AROUND)
    order = ["deal", "doc", "mark", "place"]
    found = around.repartition("deal").sortWithinPartitions(*order).mapInArrow(thrifty(_compared(least)), _FOUND)
    starts = tables.put(_starts_of(found), "passages")
    tables.drop(places)

    copies = texts.groupBy("doc", "mark").agg(F.count("*").alias("copies")).where("copies > 1")
    copies = tables.put(copies.select(F.col("doc").alias("doc_id"), "mark", "copies"), "copies")
    if copies.isEmpty():
        return starts.select("*", F.lit(1).cast("long").alias("copies"), F.lit(None).cast("int").alias("words"))
    words = F.size(F.array_remove(F.split("text", "[ \\t-\\r]+"), ""))
    long = texts.join(sent_if_small(copies.select(F.col("doc_id").alias("doc"), "mark")), ["doc", "mark"], "left_semi").select("doc", "mark", words.alias("words"))
    long = long.where(F.col("words") >= least).groupBy(F.col("doc").alias("doc_id"), "mark").agg(F.max("words").alias("words"))
    out = starts.join(copies.join(long, ["doc_id", "mark"]), ["doc_id", "mark"], "full")
    none = F.array().cast("array<int>")
    return tables.put(out.select("doc_id", "mark", F.coalesce("later", none).alias("later"), F.coalesce("first", none).alias("first"), F.coalesce("copies", F.lit(1)).alias("copies"), "words"), "repeats")


def _runs(starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Unions of [start, start + least) as (from word, to word)."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > least) + 1
    return [(int(p[0]), int(p[-1]) + least) for p in np.split(starts, cut)]


_SPANS = "doc_id long, start_word int, end_word int, kept boolean, rows long"


def repeated_spans(found: DataFrame, least: int = 50) -> DataFrame:
    """One row per maximal span of repeated passages (from word, to word) in `rows` rows: kept where it is the first
    occurrence, else to be cut. Of rows with equal doc_id and text one has the spans found, and the others are one span
    from the first word to the last that is to be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            docs = batch.column(0).to_pylist()
            for k, kept in ((1, False), (2, True)):
                for doc, starts in zip(docs, batch.column(k), strict=True):
                    out += [(doc, x, y, kept, 1) for x, y in _runs(np.asarray(starts.values, np.int64), least)]
            out += [(doc, 0, words, False, copies - 1) for doc, copies, words in zip(docs, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True) if copies > 1 and words]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start_word", "end_word", "kept", "rows"])

    return found.select("doc_id", "later", "first", "copies", "words").mapInArrow(thrifty(run), _SPANS)


def without_repeats(docs: DataFrame, found: DataFrame, least: int = 50) -> DataFrame:
    """`docs` with every later occurrence of a repeated passage cut out of `text`; n_chars, if there, is set anew.

    A row whose text had words and has none left is dropped; all others stay, null and empty texts as they are. Of rows
    with equal doc_id and text, of `least` words or more, one stays (of other columns that differ, the least row). A cut
    leaves the blanks on both sides of it. Columns of `docs` may have any names.
    """
    names, sizes = docs.columns, "n_chars" in docs.columns
    at = names.index("text")
    own_id, own_mark, cut = free_names(names, "id", "mark", "cut")
    rows = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_mark: text_mark()})
    marked = found.select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark), F.col("later").alias(cut))
    several = found.where("copies > 1").select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark))
    if not several.isEmpty():
        rows = one_row_each(rows, several, [own_id, own_mark], names)
    rows = rows.join(marked.where(F.size(cut) > 0), [own_id, own_mark], "left").select(*[F.col(f"`{c}`") for c in names], cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            later, column = batch.column(batch.num_columns - 1), batch.column(at)
            texts: list[str | None] = [None] * batch.num_rows
            keep = np.ones(batch.num_rows, bool)
            for words in word_chunks(column):
                for i in range(len(words)):
                    row = words.first + i
                    if not column[row].is_valid:
                        continue
                    a, b = words.bounds[i], words.bounds[i + 1]
                    data, base = words.data, words.offsets[i]
                    end = words.offsets[i + 1]
                    if not later[row].is_valid:
                        texts[row] = data[base:end].tobytes().decode()
                        continue
                    parts, done, left = [], base, b - a
                    for x, y in _runs(np.asarray(later[row].values, np.int64), least):
                        if y <= b - a:
                            parts.append(data[done : words.starts[a + x]].tobytes())
                            done = words.ends[a + y - 1]
                            left -= y - x
                    parts.append(data[done:end].tobytes())
                    texts[row] = b"".join(parts).decode()
                    keep[row] = left > 0
            columns = [pa.array(texts, t.type) if n == "text" else c for n, c, t in zip(names, batch.columns[:-1], batch.schema, strict=False)]
            if sizes:
                k = names.index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in texts], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return rows.mapInArrow(thrifty(run), docs.schema)
