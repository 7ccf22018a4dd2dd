"""Byte-level BPE by corpus-level merge replay.

The corpus that merges are replayed over is a task's: the distinct words (matches of the splitting pattern) of its
texts, of some megabytes of text at a time. New words are laid out in one array of token ids; an inverted index leads
from each adjacent pair that the vocabulary can merge to its positions, over all words. Merges are replayed in rank
order from a heap of pairs; each application touches only the two neighbours of its position. Texts are then encoded by
looking their words up. Nothing is shuffled: words in common between tasks are replayed in each, because dealing every
word of every text to where its class is encoded, and back, would shuffle several times the texts' size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty, thrifty, tuned

#: Distinct words after which a task starts a new memory; it keeps the previous one and takes over words met again.
REMEMBERED = 150_000
#: Characters of text whose new words are replayed together.
PART = 4_000_000
#: Ids are below 2^WIDTH; GAP ends a word, GONE is the right half of a merged pair.
WIDTH, GAP, GONE = 24, -1, -2
#: The Unicode property White_Space, which \s stands for in the patterns of rank files.
WHITE_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with lines of base64 token and rank; read on the driver, sent with the task."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def compiled(pattern: str) -> regex.Pattern:
    """The splitting pattern with \\s and \\S as the rank files mean them."""
    inside = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}")
    return regex.compile(inside.replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]"))


class MergeReplay:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, compiled(pattern)
        self.names: list[bytes] = [b""] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            self.names[rank] = token
        #: One object per id, so that remembered words share them.
        self.ids, self.numbers = list(range(len(self.names))), [str(i) for i in range(len(self.names))]
        self.memory: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.merges: dict[int, int] = {}

    def forget(self) -> None:
        """Give up all words and pairs; the vocabulary stays."""
        for part in (self.memory, self.older, self.merges):
            part.clear()

    def merged(self, pair: int) -> int:
        """The token that joins two tokens (left << WIDTH | right), or -1; looked up once per pair."""
        found = self.merges.get(pair)
        if found is None:
            found = self.ranks.get(self.names[pair >> WIDTH] + self.names[pair & ((1 << WIDTH) - 1)], -1)
            if len(self.merges) > 300_000:
                self.merges.clear()
            self.merges[pair] = found
        return found

    def learn(self, words: set[str]) -> None:
        """Replay the merges over all new words together."""
        raws, spelled = [], []
        for word in words:
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is None:
                raws.append(raw)
                spelled.append(word)
            else:
                self.memory[word] = (whole,)
        if not spelled:
            return
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        ends = np.cumsum(sizes + 1) - 1
        ids = np.full(int(ends[-1]) + 1, GAP, np.int64)
        inside = np.ones(len(ids), bool)
        inside[ends] = False
        ids[inside] = self.bytes[np.frombuffer(b"".join(raws), np.uint8)]
        owners = np.repeat(np.arange(len(raws)), sizes + 1)
        again = self._replay(ids, owners)
        alive = ids >= 0
        flat = ids[alive].tolist()
        bounds = np.concatenate(([0], np.cumsum(np.bincount(owners[alive], minlength=len(raws))))).tolist()
        share = self.ids.__getitem__
        for w, word in enumerate(spelled):
            self.memory[word] = tuple(map(share, flat[bounds[w] : bounds[w + 1]]))
        for w in again:
            self.memory[spelled[w]] = self._one_by_one(raws[w])

    def _replay(self, ids: np.ndarray, owners: np.ndarray) -> set[int]:
        """Merge `ids` in place; the owners whose order of merges came into doubt, see below."""
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, tuple[set[int], list[np.ndarray]]] = {}
        heap: list[int] = []
        known = self.merges.get
        doubt: set[int] = set()

        def enter(left: np.ndarray, right: np.ndarray, now: int = -1) -> list[np.ndarray]:
            """Index the pairs at the positions `left`, with partners `right`; the positions that rank `now` or lower."""
            pairs = (ids[left] << WIDTH) | ids[right]
            order = np.argsort(pairs, kind="stable")
            pairs = pairs[order]
            first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
            lower, sorted_left = [], left[order]
            first, found = first.tolist(), pairs[first].tolist()
            for key, a, b in zip(found, first, [*first[1:], len(pairs)], strict=True):
                rank = known(key)
                rank = self.merged(key) if rank is None else rank
                if rank >= 0:
                    places = sorted_left[a:b]
                    if rank not in index:
                        index[rank] = set(), []
                        heapq.heappush(heap, rank)
                    index[rank][0].add(key)
                    index[rank][1].append(places)
                    if rank <= now:
                        lower.append(places)
            return lower

        start = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if len(start):
            enter(start, start + 1)
        while heap:
            rank = heapq.heappop(heap)
            keys, lists = index.pop(rank)
            places = np.sort(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            if len(lists) > 1:
                places = places[np.concatenate(([True], places[1:] != places[:-1]))]
            places = places[ids[places] >= 0]
            partner = after[places]
            pairs = (ids[places] << WIDTH) | np.maximum(ids[partner], 0)
            good = ids[partner] >= 0
            good &= np.isin(pairs, list(keys)) if len(keys) > 1 else pairs == next(iter(keys))
            places, partner = places[good], partner[good]
            if not len(places):
                continue
            # In a run of overlapping pairs every second one merges, from the left.
            chained = np.flatnonzero(partner[:-1] == places[1:]) + 1
            if len(chained):
                at = np.arange(len(places))
                at[chained] = 0
                at = np.arange(len(places)) - np.maximum.accumulate(at)
                places, partner = places[at % 2 == 0], partner[at % 2 == 0]
            beyond = after[partner]
            # Between two merges side by side the first one's token meets the second's left half for a moment.
            side = np.flatnonzero(beyond[:-1] == places[1:])
            if len(side):
                moment = (rank << WIDTH) | ids[beyond[side]]
                early = [k for k in np.unique(moment).tolist() if 0 <= self.merged(k) <= rank]
                doubt.update(owners[places[side[np.isin(moment, early)]]].tolist())
            ids[places], ids[partner], after[places], before[beyond] = rank, GONE, beyond, places
            left, right = before[places], beyond
            has_left, has_right = left >= 0, ids[right] >= 0
            has_left[has_left] = ids[left[has_left]] >= 0
            whole = np.sort(np.concatenate((left[has_left], places[has_right])))
            whole = whole[np.concatenate(([True], whole[1:] != whole[:-1]))] if len(whole) else whole
            if len(whole) and (lower := enter(whole, after[whole], rank)):
                # A pair of lower or equal rank has come up. Where a word merged at several places in this step,
                # the lower pair might have come before the later places: such words are done one by one.
                own = owners[places]
                doubt.update(np.intersect1d(own[1:][own[1:] == own[:-1]], owners[np.concatenate(lower)]).tolist())
        return doubt

    def _one_by_one(self, raw: bytes) -> tuple[int, ...]:
        """One merge at a time, of the lowest rank and then the leftmost; the time grows with n log n."""
        ids = self.bytes[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := self.merged((a << WIDTH) | b)) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] == GONE or j >= n or self.merged((ids[i] << WIDTH) | ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = rank, GONE, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (m := self.merged((ids[left] << WIDTH) | ids[after[left]])) >= 0:
                    heapq.heappush(heap, (m, left))
        return tuple(x for x in ids if x != GONE)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, PART characters at a time."""
        for part in in_parts(texts):
            split = [self.pattern.findall(t) for t in part]
            distinct = set().union(*split)
            if len(self.memory) > REMEMBERED:
                self.older, self.memory = self.memory, {}
            new = distinct.difference(self.memory)
            known = new.intersection(self.older)
            self.memory.update((w, self.older[w]) for w in known)
            new -= known
            if new:
                self.learn(new)
            find = self.memory.__getitem__
            for words in split:
                yield list(chain.from_iterable(map(find, words)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.names.__getitem__, ids))


def in_parts(texts: list[str], chars: int = PART) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def in_larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about PART bytes, so that many words are replayed together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PART:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


_kept: dict[str, MergeReplay] = {}


def replay_of(ranks: dict[bytes, int], pattern: str, key: str) -> MergeReplay:
    """The worker's replay for this vocabulary, whose tables its tasks share."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = MergeReplay(ranks, pattern)
    return _kept[key]


def with_tokens(df: DataFrame, ranks: dict[bytes, int], pattern: str, finish: Callable[[list[int], MergeReplay], tuple], schema: str, column: str = "text") -> DataFrame:
    """`df` without `column`, plus the columns of `schema` (DDL) that `finish` makes of each row's ids.

    Null counts as empty text, which has no ids. Every row is encoded, repeated ones too, and texts count whole: a very
    long text or word takes time in proportion to n log n. Columns of `df` named as in `schema` are replaced. An empty
    table gives an empty table.
    """
    spark = tuned(df.sparkSession)
    sent = spark.sparkContext.broadcast(ranks)
    key = hashlib.sha256(pattern.encode() + b"".join(sorted(ranks))).hexdigest()
    added = spark.createDataFrame([], schema).schema
    carried = [c for c in df.columns if c != column and c not in added.fieldNames()]
    rows = df.select(*[F.col(f"`{c}`") for c in carried], text_or_empty(column).alias(column))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = StructType([*[f for f in rows.schema.fields[:-1]], *added.fields])
    kinds = [to_arrow_schema(added).field(i).type for i in range(len(added.fields))]
    names = whole.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = replay_of(sent.value, pattern, key)
        for batch in in_larger(batches):
            got = [finish(ids, replay) for ids in replay.encode(batch.column(batch.num_columns - 1).to_pylist())]
            made = [pa.array(column, kind) for column, kind in zip(zip(*got, strict=True) if got else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names)
        replay.forget()

    return rows.mapInArrow(thrifty(run), whole)


def digests(ids: list[int], replay: MergeReplay) -> tuple[int, str, str]:
    """(n_tokens, ids_sha256, decoded_sha256)."""
    return len(ids), hashlib.sha256(" ".join(map(replay.numbers.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(replay.decode(ids)).hexdigest()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def tokens_and_bytes(ids: list[int], replay: MergeReplay) -> tuple[list[int], bytes]:
    """(token_ids, decoded)."""
    return ids, replay.decode(ids)


TOKENS = "token_ids array<int>, decoded binary"
