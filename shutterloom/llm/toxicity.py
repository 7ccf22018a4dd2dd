"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: word beginnings that are much more frequent in toxic texts of the training rows. Features of a
text are the densities of lexicon words (as written, and after undoing digit-for-letter spellings), how near they
stand to second-person words, the rates of capitals, punctuation and obfuscated words, and sizes. Three quarters of the
training rows fit the lexicon and the trees, crosswise in two halves: features of one half use the lexicon of the other,
so no row's words vouch for it. The last quarter is scored by the finished model and calibrates it. The model is a few
kilobytes, so scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import _BASE, _BYTE, _LOWER, _U, _power_tables, mixed, string_bytes
from .shared import text_or_empty, thrifty, tuned

#: Bound on the labelled rows that are fitted on (those with the smallest hash of their id).
TRAINING_ROWS = 12_000
#: A word's beginnings of so many bytes may enter the lexicon.
BEGINNINGS = (3, 4, 5, 6, 7, 8, 10, 12)
#: Words between a lexicon word and a second-person word that count as near.
NEAR = 5
#: Score from which a text counts as toxic.
THRESHOLD = 0.3
# Second-person words of the corpus languages, and letters that digits and signs stand for.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti contigo usted ustedes vosotros"
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("@"), ord("$")]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_STANDS_IN = np.zeros(256, bool)
_PLAIN = _LOWER.copy()
for _a, _b in STAND_INS.items():
    _STANDS_IN[ord(_a)] = True
    _PLAIN[ord(_a)] = ord(_b)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class _Text:
    """Words of one chunk of texts, with hashes of their beginnings."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.offsets, self.data = offsets, data
        full = ~_SEPARATOR[data]
        head, tail = full.copy(), full.copy()
        head[1:] &= ~full[:-1]
        tail[:-1] &= ~full[1:]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        head[inner] |= full[inner]
        before = inner[inner > 0] - 1
        tail[before] |= full[before]
        self.starts, self.ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.sizes = self.ends - self.starts
        self.docs = np.searchsorted(offsets, self.starts, "right") - 1
        self.n = len(offsets) - 1

    def totals(self, letters: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[letters[self.data]] * _power_tables(len(self.data) + 1)[0][: len(self.data)], out=total[1:])
        return total

    def beginnings(self, total: np.ndarray, size: int | None, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(words that are so long, hashes of their first `size` bytes); None: of the whole words. among: only of these words."""
        at = np.arange(len(self.starts)) if among is None else among
        at = at if size is None else at[self.sizes[at] >= size]
        start = self.starts[at]
        length = self.sizes[at] if size is None else np.full(len(at), size)
        raw = (total[start + length] - total[start]) * _power_tables(len(self.data) + 1)[1][start]
        return at, mixed(raw + length.astype(np.uint64) * _BASE)

    def per_text(self, of_bytes: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(of_bytes, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def per_words(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.docs, weights, self.n)


def _chunks(column: pa.Array, size: int = 1 << 18) -> Iterator[_Text]:
    offsets, data = string_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1, first + 1))
        yield _Text(offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]])
        first = last


def _word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    t = _Text(np.array([0, len(data)]), data)
    return int(t.beginnings(t.totals(_LOWER), None)[1][0])


_YOU = np.sort(np.array([_word_hash(w) for w in SECOND_PERSON.split()], np.uint64))


def _in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Membership; a table of low bits spares most values the search."""
    out = np.zeros(len(values), bool)
    if len(sorted_set):
        low = np.zeros(1 << 16, bool)
        low[sorted_set & _U(0xFFFF)] = True
        some = np.flatnonzero(low[values & _U(0xFFFF)])
        at = np.minimum(np.searchsorted(sorted_set, values[some]), len(sorted_set) - 1)
        out[some] = sorted_set[at] == values[some]
    return out


def _lexicon_words(t: _Text, total: np.ndarray, lexicon: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    """Words with a beginning in the lexicon, of all or of the given ones."""
    hit = np.zeros(len(t.starts), bool)
    for size in (*BEGINNINGS, None):
        at, hashes = t.beginnings(total, size, among)
        hit[at] |= _in(hashes, lexicon)
    return hit


FEATURES = (
    "log_words lexicon_density log_lexicon strong_density log_strong restored_density near_you you_density capitals capital_words exclamations "
    "questions punctuation digits obfuscated repeats word_length beyond_ascii"
).split()


def features(column: pa.Array, lexicons: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of FEATURES per text; an empty text has zeros. lexicons: all beginnings, and the strong ones."""
    lexicon, strong_lexicon = lexicons
    out = [np.zeros((0, len(FEATURES)))]
    for t in _chunks(column):
        data = t.data
        words = np.maximum(np.bincount(t.docs, minlength=t.n), 1)
        size = np.maximum(np.diff(t.offsets), 1)
        written, plain = t.totals(_LOWER), t.totals(_PLAIN)
        hit = _lexicon_words(t, written, lexicon)
        stand_ins = np.concatenate(([0], np.cumsum(_STANDS_IN[data])))
        letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
        has_sign = stand_ins[t.ends] > stand_ins[t.starts]
        has_letter = letters[t.ends] > letters[t.starts]
        restored = _lexicon_words(t, plain, lexicon, np.flatnonzero(~hit & has_sign & has_letter))
        any_hit, strong = hit | restored, _lexicon_words(t, written, strong_lexicon, np.flatnonzero(hit))
        you = _in(t.beginnings(written, None)[1], _YOU)
        near = np.zeros(len(hit), bool)
        for d in range(1, NEAR + 1):
            if d < len(hit):
                same = t.docs[d:] == t.docs[:-d]
                near[d:] |= any_hit[d:] & you[:-d] & same
                near[:-d] |= any_hit[:-d] & you[d:] & same
        capital, small = _CAPITAL[data], _SMALL[data]
        smalls = np.concatenate(([0], np.cumsum(small)))
        capitals = np.concatenate(([0], np.cumsum(capital)))
        shout = (t.sizes > 1) & (capitals[t.ends] - capitals[t.starts] > 1) & (smalls[t.ends] == smalls[t.starts])
        tripled = np.zeros(len(data), bool)
        if len(data) > 2:
            tripled[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
            border = np.concatenate((t.offsets[1:-1], t.offsets[1:-1] + 1))
            tripled[border[border < len(data)]] = False
        letter_count = np.maximum(t.per_text(_LETTER[data]), 1)
        columns = [
            np.log1p(np.bincount(t.docs, minlength=t.n)), t.per_words(any_hit) / words, np.log1p(t.per_words(any_hit)), t.per_words(strong) / words, np.log1p(t.per_words(strong)), t.per_words(restored) / words,
            t.per_words(near) / words, t.per_words(you) / words, t.per_text(capital) / letter_count, t.per_words(shout) / words,
            t.per_text(data == 33) / size, t.per_text(data == 63) / size, t.per_text(_PUNCTUATION[data]) / size, t.per_text((data >= 48) & (data < 58)) / size,
            t.per_words(has_sign & has_letter) / words, t.per_text(tripled) / size, t.per_words(t.sizes) / words, t.per_text(data >= 128) / size,
        ]
        out.append(np.stack(columns, 1))
    return np.concatenate(out)


class Trees:
    """Boosted trees of logistic loss over binned features, all nodes of a level at once."""

    BINS, DEPTH, ROUNDS, RATE, RIDGE, LEAST = 32, 3, 80, 0.15, 1.0, 3.0

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.BINS + 1)[1:-1])) if len(c) else c for c in x.T]
        b, n, k = self.binned(x), len(y), x.shape[1]
        rate = np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        raw = np.full(n, self.base)
        for _ in range(self.ROUNDS if 0 < y.sum() < n else 0):
            p = 1 / (1 + np.exp(-raw))
            g, h, node, splits = p - y, p * (1 - p), np.zeros(n, np.int64), []
            for level in range(self.DEPTH):
                cells = (node[:, None] * k + np.arange(k)) * self.BINS + b
                shape = (1 << level, k, self.BINS)
                size = 1 * k * self.BINS << level
                gs = np.bincount(cells.ravel(), np.repeat(g, k), size).reshape(shape).cumsum(2)
                hs = np.bincount(cells.ravel(), np.repeat(h, k), size).reshape(shape).cumsum(2)
                ga, ha = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.RIDGE) + (ga - gs) ** 2 / (ha - hs + self.RIDGE) - ga**2 / (ha + self.RIDGE)
                weak = 4 * np.minimum(hs, ha - hs) < self.LEAST * 0.05
                gain = np.where(weak, -1.0, gain).reshape(1 << level, -1)
                best = gain.argmax(1)
                feature, cut = best // self.BINS, np.where(gain.max(1) > 1e-9, best % self.BINS, self.BINS)
                splits.append((feature, cut))
                node = node * 2 + (b[np.arange(n), feature[node]] > cut[node])
            gl, hl = (np.bincount(node, v, 1 << self.DEPTH) for v in (g, h))
            leaf = -self.RATE * gl / (hl + self.RIDGE)
            self.trees.append((splits, leaf))
            raw += leaf[node]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = node * 2 + (b[rows, feature[node]] > cut[node])
            out += leaf[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (first and last x of each block, its mean of y twice), to be interpolated between blocks.

    Equal x are one value; the means increase from block to block.
    """
    order = np.argsort(x, kind="stable")
    at, first, n = np.unique(x[order], return_index=True, return_counts=True)
    blocks: list[list[float]] = []
    for a, total, size in zip(at.tolist(), (np.add.reduceat(y[order], first) if len(at) else at).tolist(), n.tolist(), strict=True):
        blocks.append([total, size, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total_above, size_above, _, end = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total_above, blocks[-1][1] + size_above, blocks[-1][2], end]
    return np.array([v for _, _, a, b in blocks for v in (a, b)]), np.repeat([s / n for s, n, _, _ in blocks], 2)


class ToxicityModel:
    """A fitted scorer."""

    def __init__(self, lexicons: tuple[np.ndarray, np.ndarray], trees: Trees, knots: tuple[np.ndarray, np.ndarray]):
        self.lexicons, self.trees, self.knots = lexicons, trees, knots

    def scores(self, column: pa.Array) -> np.ndarray:
        raw = self.trees.raw(features(column, self.lexicons))
        flat = 1 / (1 + np.exp(-raw))
        level = np.interp(raw, *self.knots) if len(self.knots[0]) else flat
        # A trace of the uncalibrated score keeps the order inside the calibration's flat parts.
        return np.clip(0.999 * level + 0.001 * flat, 0.0, 1.0)


def _beginning_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        group = np.asarray(batch.column(1)).astype(np.int64) * 2 + np.asarray(batch.column(2))
        found, row = [], 0
        for t in _chunks(batch.column(0)):
            total = t.totals(_LOWER)
            both = [t.beginnings(total, size) for size in (*BEGINNINGS, None)]
            hashes = np.concatenate([h for _, h in both])
            docs = np.concatenate([t.docs[at] for at, _ in both])
            order = np.lexsort((hashes, docs))
            hashes, docs = hashes[order], docs[order]
            new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])))[: len(hashes)]
            found.append((hashes[new], group[row + docs[new]]))
            row += t.n
        hashes, groups = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keys, at = np.unique(hashes, return_inverse=True)
        counts = np.bincount(at * 4 + groups, minlength=4 * len(keys)).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[pa.array(c.astype(np.int64)) for c in counts.T]], ["h", "c0", "t0", "c1", "t1"])


def _telling(clean, toxic, clean_rows: int, toxic_rows: int, odds: float):
    """Whether a beginning is in two toxic texts, and in enough, and its smoothed odds for toxic are so large."""
    return (toxic >= max(2, 0.004 * toxic_rows)) & ((toxic + 0.1) / (toxic_rows + 1) / ((clean + 0.5) / (clean_rows + 1)) >= odds)


def _lexicon(counts: np.ndarray, clean: np.ndarray, toxic: np.ndarray, clean_rows: int, toxic_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings in at least two toxic texts whose smoothed odds for toxic are eight to one; the strong ones, of 80 to one."""
    good, strong = (_telling(clean, toxic, clean_rows, toxic_rows, odds) for odds in (8, 80))
    return np.sort(counts[good].view(np.uint64)), np.sort(counts[strong].view(np.uint64))


#: Parts of the training rows: two halves that are fitted on crosswise, and the rows that calibrate.
CALIBRATES = 2


def fit(labelled: DataFrame, rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Fit on columns (doc_id, text, toxic), at most `rows` rows, as training_rows() chooses them; more are refused.

    Rows whose toxic is neither 0 nor 1 are not used; null text counts as empty. Where labels are all equal or absent,
    every score is about their mean.
    """
    tuned(labelled.sparkSession)
    key = F.xxhash64("doc_id")
    part = F.when(F.pmod(F.shiftright(key, 8), F.lit(4)) == 0, CALIBRATES).otherwise(F.pmod(key, F.lit(2))).cast("int")
    texts = labelled.where(F.col("toxic").isin(0, 1)).select(text_or_empty().alias("text"), part.alias("part"), F.col("toxic").cast("int").alias("toxic"), "doc_id")
    sizes = np.zeros((3, 2), np.int64)
    for k, t, n in texts.groupBy("part", "toxic").count().collect():
        sizes[k, t] = n
    if sizes.sum() > rows:
        raise ValueError(f"{sizes.sum()} labelled rows are more than {rows}: choose them by training_rows()")
    counts = texts.where(F.col("part") != CALIBRATES).mapInArrow(thrifty(_beginning_counts), "h long, c0 long, t0 long, c1 long, t1 long").groupBy("h").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])
    # What enters the lexicon of a half or of both; their number is bounded by the training rows.
    whole_rows = sizes[:2].sum(0).tolist()
    half = [_telling(F.col(f"c{k}"), F.col(f"t{k}"), *sizes[k].tolist(), 8) for k in (0, 1)]
    counts = counts.where(half[0] | half[1] | _telling(F.col("c0") + F.col("c1"), F.col("t0") + F.col("t1"), *whole_rows, 8))
    c = np.array([tuple(r) for r in counts.collect()], np.int64).reshape(-1, 5)
    per_half = [_lexicon(c[:, 0], c[:, 1 + 2 * k], c[:, 2 + 2 * k], *sizes[k]) for k in (0, 1)]
    whole = _lexicon(c[:, 0], c[:, 1] + c[:, 3], c[:, 2] + c[:, 4], *sizes[:2].sum(0))
    used = (per_half[1], per_half[0], whole)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.asarray(batch.column(1))
            x = np.zeros((len(part), len(FEATURES)))
            for k, lexicons in enumerate(used):
                at = np.flatnonzero(part == k)
                x[at] = features(batch.column(0).take(pa.array(at)), lexicons)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), rows], ["part", "toxic", "doc_id", "x"])

    kind = dict(texts.dtypes)["doc_id"]
    got = texts.mapInArrow(thrifty(crossed), f"part int, toxic int, doc_id {kind}, x array<double>").collect()
    got.sort(key=lambda r: (str(r.doc_id), r.toxic, r.x))
    x = np.array([r.x for r in got]).reshape(-1, len(FEATURES))
    y, part = np.array([r.toxic for r in got], float), np.array([r.part for r in got], int)
    trees = Trees(x[part != CALIBRATES], y[part != CALIBRATES])
    held = part == CALIBRATES
    knots = isotonic(trees.raw(x[held]), y[held]) if len(set(y[held].tolist())) == 2 else (np.zeros(0), np.zeros(0))
    return ToxicityModel(whole, trees, knots)


def training_rows(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most `rows` labelled documents, those with the smallest hash of their id.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the larger counts, of several texts
    the first in their order. `learn_from` is a condition on the columns of `labels`.
    """
    spark = docs.sparkSession
    chosen = labels.where(learn_from & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    ids = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    few = spark.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def scored(docs: DataFrame, model: ToxicityModel, column: str = "score", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `column` (0 to 1) of every row, null text scored as empty; a column of that name is replaced.

    Texts are scored whole, however long. Equal texts have equal scores. An empty table gives an empty table.
    """
    spark = tuned(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    base = docs.drop(column)
    at = base.columns.index("text")
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*base.schema.fields, StructField(column, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(sent.value.scores(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], schema.fieldNames())

    return base.mapInArrow(thrifty(run), schema)
