"""Document fingerprints by consistent weighted sampling, in built-in functions only.

A text is a bag of terms weighted by how often they occur: its words, and in place of words too long to be one (scripts
without blanks, say) all runs of four characters of them. For each of `samples` draws every word k has, from its hash
alone, r and c distributed Gamma(2, 1) and b uniform; with weight S it yields t = floor(ln S / r + b) and
a = c exp(-r (t - b) - r). The word of least a, with its t, is the sample, and two bags have the same sample with
a probability that equals their generalised Jaccard similarity, sum of minima by sum of maxima of the weights.
A sample is held in one long: ln a in fixed point above 32 bits of a hash of (k, t), so that drawing is a plain
minimum, which the aggregation combines per document without objects.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_mark, text_or_empty

#: Draws per fingerprint; the likeness of two fingerprints has a standard error of at most half of its inverse root.
SAMPLES = 32
#: Characters of a word at most; a longer one counts by its runs of RUN characters.
LONGEST_WORD, RUN = 20, 4


def _uniform(h: Column, shift: int, bits: int) -> Column:
    piece = F.shiftrightunsigned(h, shift) if shift else h
    return (piece.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("double") + F.lit(0.5)) * F.lit(2.0**-bits)


def _draw(term: Column, log_weight: Column, d: int) -> Column:
    """The packed sample that a term offers to draw d; null if its weight's logarithm is null."""
    h, g = F.xxhash64(term, F.lit(2 * d)), F.xxhash64(term, F.lit(2 * d + 1))
    r = -F.ln(_uniform(h, 43, 21) * _uniform(h, 22, 21))
    log_c = F.ln(-F.ln(_uniform(g, 32, 32) * _uniform(g, 0, 32)))
    b = _uniform(h, 0, 21)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t.cast("double") - b) - r
    fixed = F.shiftleft(((log_a + F.lit(128.0)) * F.lit(float(1 << 23))).cast("long"), 32)
    return fixed.bitwiseOR(F.hash(term, t).cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def terms(text: Column) -> Column:
    """The words of a text; of words beyond LONGEST_WORD characters all runs of RUN characters, by one pass over them."""
    words = F.split(F.lower(text), r"\s+")
    runs = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONGEST_WORD, F.regexp_extract_all(w, F.lit(f"(?=(.{{{RUN}}}))"), F.lit(1))).otherwise(F.array(w))))
    return F.when(text.rlike(rf"\S{{{LONGEST_WORD + 1}}}"), runs).otherwise(words)


def draws(rows: DataFrame, groups: list[str], texts: list[str], samples: int = SAMPLES) -> DataFrame:
    """`groups` and, for each text column i and draw d, s{i}_{d}: the least packed draw, null for a wordless text.

    `groups` must identify a row of `rows`; if `rows` is partitioned by one of them nothing is shuffled.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(t).alias("text")) for i, t in enumerate(texts)])).alias("x")
    words = rows.select(*groups, sides).select(*groups, F.col("x.side").alias("side"), F.explode(terms(F.col("x.text"))).alias("word"))
    own = [F.sum(((F.col("side") == i) & (F.col("word") != "")).cast("int")).alias(f"n{i}") for i in range(len(texts))]
    counts = words.groupBy(*groups, F.xxhash64("word").alias("term")).agg(*own)
    weights = counts.select(*groups, "term", *[F.ln(F.col(f"n{i}").cast("double")).alias(f"w{i}") for i in range(len(texts))])
    least = [F.min(_draw(F.col("term"), F.col(f"w{i}"), d)).alias(f"s{i}_{d}") for i in range(len(texts)) for d in range(samples)]
    return weights.groupBy(*groups).agg(*least)


def printed(side: int, samples: int = SAMPLES) -> Column:
    """The fingerprint as text: eight hexadecimal digits per draw; empty for a wordless text."""
    low = [F.lpad(F.hex(F.col(f"s{side}_{d}").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0") for d in range(samples)]
    return F.lower(F.concat_ws("", *low))


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal samples; two wordless texts are alike."""
    equal = [x.eqNullSafe(y).cast("int") for x, y in zip(a, b, strict=True)]
    total = equal[0]
    for e in equal[1:]:
        total = total + e
    return total.cast("double") / F.lit(float(len(equal)))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of each distinct (doc_id, text); null text counts as empty, with an empty fingerprint."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).distinct()
    rows = rows.withColumn("mark", F.xxhash64("text"))
    return draws(rows, ["doc_id", "mark"], ["text"], samples).select("doc_id", printed(0, samples).alias("fingerprint"))


def range_of(bounds: list[int], doc_id: Column, mark: Column) -> Column:
    """The range that a row belongs to: the number of `bounds` below its id. An id that is several bounds, because very
    many rows have it, is dealt over as many ranges by `mark`, a signed hash, in ascending order.

    The search takes steps of the root of the number of bounds, so it costs twice the root per row.
    """
    if not bounds:
        return F.lit(0).cast("long")
    step = max(1, math.isqrt(len(bounds)))
    every = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    coarse = F.split(F.lit(",".join(map(str, bounds[step - 1 :: step]))), ",").cast("array<bigint>")

    def count(holds) -> Column:
        whole = F.size(F.filter(coarse, holds)) * step if len(bounds) >= step else F.lit(0)
        return whole + F.size(F.filter(F.slice(every, whole + 1, F.lit(step)), holds))

    below, upto = count(lambda b: b < doc_id), count(lambda b: b <= doc_id)
    share = F.shiftrightunsigned(mark.bitwiseXOR(F.lit(-(1 << 63))), 33).cast("double") / float(1 << 31)
    return F.coalesce(below + F.floor(share * (upto - below)), F.lit(0)).cast("long")


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, doc_id, mark, text, guest): the rows dealt by ascending doc_id and mark, a hash of the text, into about
    `buckets` ranges.

    Each range also gets, as guest, the first row of the following range (the last range: the very first row), so that
    every row finds its successor in its own range and no task sees all rows. Range bounds are approximate quantiles.
    A null doc_id comes first. The first rows that are sent to the machines are one per range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), text_or_empty().alias("text"))
    cuts = [k / buckets for k in range(1, buckets)]
    bounds = sorted(rows.select(F.percentile_approx("doc_id", cuts, 4 * buckets)).first()[0] or []) if cuts else []
    rows = rows.withColumn("bucket", range_of(bounds, F.col("doc_id"), F.col("mark")))
    first = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "mark")).alias("x"))
    order = Window.orderBy("bucket")
    host = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy()))
    first = first.select(F.col("bucket").alias("own"), F.col("x.doc_id").alias("first_id"), F.col("x.mark").alias("first_mark"), host.alias("host"))
    one = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    both = F.when(F.col("host").isNull(), F.array(one)).otherwise(F.array(one, F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))))
    meets = (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    rows = rows.join(F.broadcast(first), meets, "left")
    return rows.select("doc_id", "mark", "text", F.explode(both).alias("x")).select("x.bucket", "doc_id", "mark", "text", "x.guest")


def edited_and_next(docs: DataFrame, buckets: int, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    The edited text has the last floor(n / 4) of n characters replaced by the first as many of the next document in
    ascending doc_id, after the last the first. Null text counts as empty. Rows that share a doc_id follow each other
    in the order of a hash of their text, a null doc_id comes first. A sole document is its own successor. Texts count
    whole, however long; equal texts have equal fingerprints. Other columns are not read, so their names cannot clash.
    An empty table gives an empty table.
    """
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "mark", "text")
    rows = in_order(docs, buckets)
    size, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - quarter), F.coalesce(F.substring("following", F.lit(1), quarter), F.lit("")))
    rows = rows.select("*", F.lead("text").over(order).alias("following"), F.row_number().over(order).alias("place"))
    rows = rows.select("bucket", "place", "doc_id", "guest", "text", size.cast("long").alias("n_chars"), edited.alias("edited"))
    own = [f"s0_{d}" for d in range(samples)]
    other = [f"s1_{d}" for d in range(samples)]
    drawn = draws(rows, ["bucket", "place"], ["text", "edited"], samples)
    following = Window.partitionBy("bucket").orderBy("place")
    alike = likeness([F.col(c) for c in own], [F.lead(c).over(following) for c in own])
    marks = drawn.select(
        "bucket", "place", printed(0, samples).alias("fingerprint"), printed(1, samples).alias("edited_fingerprint"),
        likeness([F.col(c) for c in own], [F.col(c) for c in other]).alias("near_edited"), alike.alias("near_next"),
    )
    texts = rows.where(~F.col("guest")).select("bucket", "place", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    return texts.join(marks, ["bucket", "place"]).drop("bucket", "place")
