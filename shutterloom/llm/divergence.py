"""How the sources of a language differ in their use of words: the distance of every pair, and each source's own terms.

Terms are counted where texts are read and summed by Spark. Kept terms are dealt to blocks; a block is a dense numpy
int64 matrix of groups by terms, in which all pairs of groups are compared by broadcasting. Blocks give partial pair
matrices, which Spark sums, and the best terms of each group in the block, which Spark merges. The groups of a language
go in rows of GROUPS: beyond that, each two rows and block are a tile of their own, so no tile grows with the number
of sources or of terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, sent_if_small, text_or_empty, thrifty, tuned

#: A kept term is in so many documents of the language; what is added to each count; the parts that a whole is given in.
DOCUMENTS, ADDED, WHOLE = 30, 5, 10**9
#: Terms reported of each group.
BEST = 50
#: Groups and terms of a tile, at most and about.
GROUPS, TERMS = 128, 256
#: Groups whose distances to all others are taken at once.
AT_ONCE = 16
#: Counts that a task holds before it hands them on, and rows that it hands on at once.
HELD, ROWS = 150_000, 20_000
#: Bytes that terms are made of, A-Z in small letters; all others are blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("documents", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    """Stretches of letters A-Z and a-z and of characters beyond ASCII, with A-Z in small letters."""
    return text.encode().translate(_FOLD).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts by language, source and term; rows without a term say only that the group is there."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def handed() -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (lang, source), (occurs, within) in groups.items():
            rows.append((lang, source, None, 0, 0))
            for term, n in occurs.items():
                rows.append((lang, source, term.decode(), n, within[term]))
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            occurs, within = groups.setdefault((lang, source), (Counter(), Counter()))
            before, terms = len(occurs), terms_of(text)
            occurs.update(terms)
            within.update(set(terms))
            held += len(occurs) - before + 1
            if held >= HELD:
                yield from handed()
                held = 0
    yield from handed()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARTIAL.types, strict=True)], schema=_PARTIAL)


def shares(counts: np.ndarray, totals: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(WHOLE * (count + ADDED) / (total + ADDED * terms)), by long division, exact for up to 9e15 words."""
    left, below = counts + ADDED, totals + ADDED * terms
    out = np.zeros(np.broadcast_shapes(np.shape(left), np.shape(below)), np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // below
        left = left % below
    return out + 1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of every row of a and every row of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, len(a), AT_ONCE):
        out[k : k + AT_ONCE] = np.abs(a[k : k + AT_ONCE, None, :] - b[None, :, :]).sum(axis=2)
    return out


_TILE = "lang string, source string, part string, item string, value long"


def _tile(key: tuple, rows: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
    """One tile: partial distances of its pairs, and where a row of groups meets itself the best terms of each group."""
    lang, _, low, high = key
    tile = tiles.iloc[0]
    terms = int(tile.terms)
    codes, names = pd.factorize(rows.term, sort=True)
    unseen = int(tile.here) - len(names)
    sides = []
    for side, roster in ((low, tile.low_groups), (high, tile.high_groups)):
        sources, totals = [g["source"] for g in roster], np.array([g["total"] for g in roster], np.int64)
        own = (rows.line == side).to_numpy()
        counts = np.zeros((len(sources), len(names)), np.int64)
        counts[rows.seat.to_numpy()[own], codes[own]] = rows.occurrences.to_numpy()[own]
        if terms:
            sides.append((sources, shares(counts, totals[:, None], terms), shares(np.zeros(len(totals), np.int64), totals, terms), counts))
        else:
            sides.append((sources, counts, np.zeros(len(totals), np.int64), counts))
    (a, p, p0, counts), (b, q, q0, _) = sides
    # Terms of the block that none of these groups has are alike: each adds the distance of two zero counts.
    values = distances(p, q) + unseen * np.abs(p0[:, None] - q0[None, :])
    i, j = np.triu_indices(len(a), 1) if low == high else (x.ravel() for x in np.indices(values.shape))
    out = [pd.DataFrame({"source": np.array(a, object)[i], "part": "pair", "item": np.array(b, object)[j], "value": values[i, j]})]
    if low == high and len(names):
        whole = np.zeros(len(names), np.int64)
        whole[codes] = rows.whole.to_numpy()
        over = p - shares(whole, int(tile.total), terms)
        seat, term = np.nonzero((counts > 0) & (over > 0))
        value = over[seat, term]
        order = np.lexsort((term, -value, seat))
        seat, term, value = seat[order], term[order], value[order]
        best = np.arange(len(seat)) - np.searchsorted(seat, seat) < BEST
        out.append(pd.DataFrame({"source": np.array(a, object)[seat[best]], "part": "term", "item": np.array(names, object)[term[best]], "value": value[best]}))
    made = pd.concat(out, ignore_index=True)
    made.insert(0, "lang", lang)
    return made


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, occurrences, documents) of all documents; each group has a row without a term too."""
    tuned(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text_or_empty().alias("text"))
    parts = texts.mapInArrow(thrifty(_counted), "lang string, source string, term string, occurrences long, documents long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def audit(docs: DataFrame, tables: Tables) -> DataFrame:
    """(lang, source, part, item, value, rank) of `docs` (lang, source, text; other columns are not read).

    A language keeps the terms that at least DOCUMENTS of its rows contain. With p = 1 + floor(WHOLE * (count + ADDED) /
    (N + ADDED * V)) of each kept term, where N sums a group's counts over the V kept terms, part `pair` holds for each
    two sources of a language the sum of |p - q| over all kept terms (0 without any), in all ranks; part `term` each
    group's BEST terms by p - q, where it has the term and p exceeds the language's own q. Ranks go by value, largest
    first, then by item in UTF-8 order.

    Null language, source or text counts as empty; a group whose texts have no terms is a group with counts of zero;
    repeated rows count each. A single source of a language has no pairs. An empty table gives an empty table. The rows
    of pairs are as many as the pairs of sources; sums are exact while a group has fewer than 9e15 words. A task holds
    a batch of texts, HELD counts or one tile.
    """
    counts = tables.put(counted(docs), "counts")
    worded = counts.where("term IS NOT NULL")
    kept = worded.groupBy("lang", "term").agg(F.sum("occurrences").alias("whole"), F.sum("documents").alias("documents")).where(F.col("documents") >= DOCUMENTS).drop("documents")
    kept = tables.put(kept, "kept")
    langs = counts.groupBy("lang").agg(F.lit(0).alias("zero")).join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("whole").alias("total")), "lang", "left")
    langs = langs.select("lang", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("terms", "total")])
    langs = tables.put(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)).cast("long")), "langs")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    kept = kept.join(sent_if_small(langs.select("lang", "blocks")), "lang").select("lang", "term", "whole", block)
    uses = tables.put(worded.select("lang", "source", "term", "occurrences").join(kept, ["lang", "term"]), "uses")

    groups = counts.where("term IS NULL").select("lang", "source").join(uses.groupBy("lang", "source").agg(F.sum("occurrences").alias("total")), ["lang", "source"], "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), number.alias("number"))
    groups = tables.put(groups.select("lang", "source", "total", F.floor(F.col("number") / GROUPS).cast("int").alias("line"), (F.col("number") % GROUPS).alias("seat")), "groups")

    rosters = groups.groupBy("lang", "line").agg(F.array_sort(F.collect_list(F.struct("seat", "source", "total"))).alias("groups"))
    here = kept.groupBy("lang", "block").agg(F.count("*").alias("here"))
    blocks = langs.select("lang", "terms", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(here, ["lang", "block"], "left").fillna(0, ["here"])
    tiles = blocks.join(rosters.select("lang", F.col("line").alias("low"), F.col("groups").alias("low_groups")), "lang").join(rosters.select("lang", F.col("line").alias("high"), F.col("groups").alias("high_groups")), "lang").where("low <= high")

    lines = groups.groupBy("lang").agg(F.max("line").alias("last"))
    uses = uses.join(sent_if_small(groups.drop("total")), ["lang", "source"]).join(sent_if_small(lines), "lang")
    uses = uses.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).select("lang", "block", F.least("line", "other").alias("low"), F.greatest("line", "other").alias("high"), "line", "seat", "term", "occurrences", "whole")
    by = ["lang", "block", "low", "high"]
    found = tables.put(uses.groupBy(*by).cogroup(tiles.groupBy(*by)).applyInPandas(_tile, _TILE), "tiles")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= BEST)
    return pairs.withColumn("rank", rank).unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def audit_sql(docs: str = "documents") -> str:
    """The audit in DuckDB SQL."""
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM {docs}),
words AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {DOCUMENTS}),
occurs AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(kept.term) AS v, coalesce(sum(kept.n), 0) AS total FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
groups AS (SELECT g.lang, g.source, langs.v, langs.total AS whole, coalesce(sum(o.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g JOIN langs USING (lang)
    LEFT JOIN occurs o ON o.lang = g.lang AND o.source = g.source GROUP BY g.lang, g.source, langs.v, langs.total),
cells AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
    1 + ({WHOLE}::HUGEINT * (coalesce(o.n, 0) + {ADDED})) // (g.total + {ADDED} * g.v) AS p, 1 + ({WHOLE}::HUGEINT * (k.n + {ADDED})) // (g.whole + {ADDED} * g.v) AS q
    FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN occurs o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
        GROUP BY x.lang, x.source, y.source) d ON d.lang = a.lang AND d.source = a.source AND d.other = b.source),
rows AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows) WHERE part = 'pair' OR rank <= {BEST}
"""
