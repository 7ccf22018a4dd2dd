"""Runs of repeated words (a list, a table or a line said over and over) by Crochemore's partition refinement.

The positions of a text start out in classes of equal words. Step by step the classes of equal factors of l + 1 words
are made of those of l words: a position moves by the class of the position after it, and only the positions before
small classes are looked at, where of the parts of a class all but the largest are small. So a position is looked at a
logarithmic number of times, however long the factors that repeat. Each class is a linked list in order of position;
where two neighbours of a class of factors of l words are l apart, a square with a primitive root begins, and squares
of one root length at consecutive positions are one run.

A task refines the texts of some megabytes together, so a step is a few array operations for all of them. Nothing is
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty, thrifty, tuned

#: Bytes of text refined together; a longer text is refined alone.
PART = 8 << 20
#: A run has at least so many words, and is at least so many times its period.
WORDS, TIMES = 6, 4
#: A step that moves at most so many positions is made one position at a time, which is faster for few.
FEW = 12


class Refinement:
    """Classes of positions of the texts in `bounds`, each followed by a word of its own.

    ids: the words of all texts; text t is at bounds[t] to bounds[t + 1] - 1, its end mark included. most: the longest
    period wanted in each text.
    """

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, most: np.ndarray):
        n = len(ids)
        self.n, self.most = n, most
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.open = most > 0
        key = self.text * (int(ids.max(initial=0)) + 1) + ids
        self.members = np.argsort(key, kind="stable")
        key = key[self.members]
        new = np.ones(n, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        first = np.flatnonzero(new)
        self.place = np.empty(n, np.int64)
        self.place[self.members] = np.arange(n)
        self.kind = np.empty(n, np.int64)
        self.kind[self.members] = np.cumsum(new) - 1
        #: Of each class, where its members begin and how many they are; there are never more than n classes.
        self.start, self.size = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.classes = len(first)
        self.start[: len(first)], self.size[: len(first)] = first, np.diff(np.append(first, n))
        # The last element of the next three stands for "none", which is also index -1.
        self.after, self.before, self.marked = np.full(n + 1, -1), np.full(n + 1, -1), np.zeros(n + 1, bool)
        a, b = self.members[:-1][~new[1:]], self.members[1:][~new[1:]]
        self.after[a], self.before[b] = b, a
        #: The factor length since which `after` holds.
        self.since = np.ones(n, np.int64)
        self.found: list[np.ndarray] = []
        self.single: list[tuple[int, int]] = []

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Root length and first position of every square whose root is primitive and at most `most` long."""
        small, length = np.arange(self.n), 1
        last = int(self.most.max(initial=0))
        while len(small) and length < last:
            length += 1
            if length & (length - 1) == 0:
                self._close(length)
            before = small - 1
            before = before[before >= 0]
            before = before[(self.size[self.kind[before]] > 1) & self.open[self.text[before]] & (self.most[self.text[before]] >= length)]
            if len(before) > FEW:
                small = self._split(np.sort(before), length)
            elif len(before):
                small = np.array(self._split_few(sorted(before.tolist()), length), np.int64)
            else:
                small = before
        held = np.flatnonzero(self.after[:-1] >= 0)
        self._note(held, self.after[held] - held, last + 1)
        if self.single:
            self.found.append(np.array(self.single, np.int64).T)
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        root, at = np.concatenate(self.found, axis=1)
        wanted = root <= self.most[self.text[at]]
        return root[wanted], at[wanted]

    def _close(self, length: int) -> None:
        """Leave texts alone that have no neighbours within their longest period, or whose periods are done."""
        held = np.flatnonzero(self.after[:-1] >= 0)
        near = held[self.after[held] - held <= self.most[self.text[held]]]
        still = np.zeros(len(self.open), bool)
        still[self.text[near]] = True
        self.open &= still & (self.most >= length)

    def _note(self, at: np.ndarray, gap: np.ndarray, length: int) -> None:
        """Neighbours `gap` apart since self.since[at] and until factors of `length` words: squares if gap lies between."""
        square = (gap >= self.since[at]) & (gap < length)
        if square.any():
            self.found.append(np.stack((gap[square], at[square])))

    def _split(self, moved: np.ndarray, length: int) -> np.ndarray:
        """Part the classes of `moved` (ascending) by the classes of the next positions; the members of small parts."""
        kind, by = self.kind[moved], self.kind[moved + 1]
        order = np.lexsort((by, kind))
        moved, kind, by = moved[order], kind[order], by[order]
        new_kind = np.ones(len(moved), bool)
        np.not_equal(kind[1:], kind[:-1], out=new_kind[1:])
        new_part = new_kind.copy()
        new_part[1:] |= by[1:] != by[:-1]
        # A class whose members all move to one part stays as it is.
        first = np.flatnonzero(new_kind)
        taken, parts = np.diff(np.append(first, len(moved))), np.add.reduceat(new_part, first)
        stays = (taken == self.size[kind[first]]) & (parts == 1)
        if stays.any():
            keep = np.repeat(~stays, taken)
            moved, kind, new_kind, new_part = moved[keep], kind[keep], new_kind[keep], new_part[keep]
            first, taken, parts = np.flatnonzero(new_kind), taken[~stays], parts[~stays]
        if not len(moved):
            return moved
        classes = kind[first]
        rest = self.size[classes] - taken
        part_first = np.flatnonzero(new_part)
        part_size = np.diff(np.append(part_first, len(moved)))
        part_of = np.repeat(np.arange(len(first)), parts)
        largest = np.maximum.reduceat(part_size, np.cumsum(parts) - parts)
        top = np.flatnonzero(part_size == largest[part_of])
        is_top = np.zeros(len(part_size), bool)
        is_top[top[np.unique(part_of[top], return_index=True)[1]]] = True

        # Neighbours: those left over close ranks over chains of moved ones, those moved link within their part.
        self.marked[moved] = True
        chain = moved[np.lexsort((moved, kind))]
        left, right = self.before[chain[~self.marked[self.before[chain]]]], self.after[chain[~self.marked[self.after[chain]]]]
        follows = np.append(moved[1:], -1)
        follows[np.append(part_first[1:], len(moved)) - 1] = -1
        some = left >= 0
        at, now = np.concatenate((moved, left[some])), np.concatenate((follows, right[some]))
        was = self.after[at]
        changed = was != now
        at, now, was = at[changed], now[changed], was[changed]
        known = was >= 0
        self._note(at[known], was[known] - at[known], length)
        self.after[at], self.since[at] = now, length
        leads = np.concatenate(([-1], moved[:-1]))
        leads[part_first] = -1
        self.before[moved] = leads
        some = right >= 0
        self.before[right[some]] = left[some]

        # Members: those moved go to the end of their class, part by part.
        tail = self.start[classes] + rest
        slots = np.arange(len(moved)) + np.repeat(tail - first, taken)
        held = self.members[slots]
        held = held[~self.marked[held]]
        vacant = self.place[moved]
        vacant = vacant[vacant < np.repeat(tail, taken)]
        self.members[vacant], self.place[held] = held, vacant
        self.members[slots], self.place[moved] = moved, slots
        self.marked[moved] = False

        # Names: what is left over keeps the name of the class, or else its largest part.
        keeps = is_top & (rest[part_of] == 0)
        names = classes[part_of]
        fresh = np.flatnonzero(~keeps)
        names[fresh] = self.classes + np.arange(len(fresh))
        self.classes += len(fresh)
        self.size[classes] = rest
        self.start[names], self.size[names] = slots[part_first], part_size
        self.kind[moved] = np.repeat(names, part_size)

        # All parts but the largest are small.
        part_wins = largest > rest
        small = moved[np.repeat(~(is_top & part_wins[part_of]), part_size)]
        over = np.flatnonzero(part_wins & (rest > 0))
        if len(over):
            n = rest[over]
            small = np.concatenate((small, self.members[np.arange(n.sum()) + np.repeat(self.start[classes[over]] - np.cumsum(n) + n, n)]))
        return small

    def _split_few(self, moved: list[int], length: int) -> list[int]:
        """As _split, one position at a time."""
        kinds, after, before, size, start, members, place = self.kind, self.after, self.before, self.size, self.start, self.members, self.place
        parts: dict[int, dict[int, list[int]]] = {}
        for q in moved:
            parts.setdefault(int(kinds[q]), {}).setdefault(int(kinds[q + 1]), []).append(q)
        small: list[int] = []
        for kind, own in parts.items():
            rest = int(size[kind]) - sum(map(len, own.values()))
            if not rest and len(own) == 1:
                continue
            links: dict[int, int] = {}
            for part in own.values():
                for q in part:
                    a, b = int(before[q]), int(after[q])
                    links.setdefault(q, b)
                    if a >= 0:
                        links.setdefault(a, q)
                        after[a] = b
                    if b >= 0:
                        before[b] = a
            for part in own.values():
                for k, q in enumerate(part):
                    before[q] = part[k - 1] if k else -1
                    after[q] = part[k + 1] if k + 1 < len(part) else -1
            for q, was in links.items():
                if was >= 0 and was != after[q] and self.since[q] <= was - q < length:
                    self.single.append((was - q, q))
                if was != after[q]:
                    self.since[q] = length
            slot = int(start[kind]) + int(size[kind])
            top = max(own.values(), key=len)
            for part in own.values():
                for q in part:
                    slot -= 1
                    other, there = int(members[slot]), int(place[q])
                    members[there], place[other] = other, there
                    members[slot], place[q] = q, slot
                if rest or part is not top:
                    name = self.classes
                    self.classes += 1
                    kinds[part] = name
                else:
                    name = kind
                start[name], size[name] = slot, len(part)
                if part is not top or rest >= len(top):
                    small += part
            if rest:
                size[kind] = rest
                if rest < len(top):
                    small += members[int(start[kind]) : int(start[kind]) + rest].tolist()
        return small


class _Numbers(dict):
    """Words numbered from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def runs_of(words: list[list[bytes]], least: int = WORDS, times: int = TIMES) -> list[np.ndarray]:
    """Of each text, its runs as rows (start, length, period) by start, then period."""
    out = [np.zeros((0, 3), np.int64)] * len(words)
    long = [t for t, w in enumerate(words) if len(w) >= max(least, 2)]
    if not long:
        return out
    sizes = np.array([len(words[t]) for t in long])
    ends = np.cumsum(sizes + 1)
    ids = np.zeros(ends[-1], np.int64)
    inside = np.ones(len(ids), bool)
    inside[ends - 1] = False
    ids[inside] = np.fromiter(map(_Numbers().__getitem__, chain.from_iterable(words[t] for t in long)), np.int64, int(sizes.sum()))
    bounds = np.concatenate(([0], ends))
    root, at = Refinement(ids, bounds, sizes // max(times, 2)).squares()
    order = np.lexsort((at, root))
    root, at = root[order], at[order]
    new_run = np.ones(len(at), bool)
    new_run[1:] = (root[1:] != root[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new_run)
    period, length = root[first], np.diff(np.append(first, len(at))) - 1 + 2 * root[first]
    begin = at[first]
    wanted = length >= np.maximum(least, times * period)
    period, length, begin = period[wanted], length[wanted], begin[wanted]
    order = np.lexsort((period, begin))
    period, length, begin = period[order], length[order], begin[order]
    text = np.searchsorted(bounds, begin, "right") - 1
    cuts = np.searchsorted(text, np.arange(len(long) + 1))
    rows = np.stack((begin - bounds[text], length, period), axis=1)
    for k, t in enumerate(long):
        out[t] = rows[cuts[k] : cuts[k + 1]]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, each run cut to its first period."""
    if not len(runs):
        return b" ".join(words)
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(dropped[:-1]) == 0).tolist()))


RUNS = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def in_parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def periodic_runs(docs: DataFrame, column: str = "text", least: int = WORDS, times: int = TIMES) -> DataFrame:
    """`docs` without `column`, plus `runs` (start, length, period in words, by start, then period) and `collapsed`.

    A word is a stretch of characters other than blank and \\x09-\\x0D, compared as it is. A run is a stretch with
    smallest period `period` that no neighbouring word extends, of at least `least` words and `times` (2 or more)
    periods. `collapsed` is the text's words joined by one space, without those that a run contains after its first
    period. Null counts as empty text, which has no runs and collapses to the empty text. Every row counts for itself,
    repeated ones and rows with null ids too. Columns of `docs` named runs or collapsed are replaced. A very long text
    is refined in one task, in time proportional to n log n words, and takes some 100 bytes a word. An empty table
    gives an empty table.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    from pyspark.sql.types import StructType

    spark = tuned(docs.sparkSession)
    added = spark.createDataFrame([], RUNS).schema
    carried = [c for c in docs.columns if c.lower() not in (column.lower(), *added.fieldNames())]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)], text_or_empty(f"`{column}`").alias("text"))
    whole = StructType([*rows.schema.fields[:-1], *added.fields])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, PART):
            words = [t.encode().split() for t in batch.column(batch.num_columns - 1).to_pylist()]
            runs = runs_of(words, least, times)
            ends = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            inner = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type))
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)
            texts = pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made, texts], whole.fieldNames())

    return rows.mapInArrow(thrifty(run), whole).toDF(*carried, *added.fieldNames())
