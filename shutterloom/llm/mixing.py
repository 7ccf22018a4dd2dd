"""Mixing sources to target weights by hierarchical budgeting.

A token budget is dealt down a tree of levels (say domain, language, source) in proportion to weights. A node cannot
take more than its leaves hold in `epochs` passes; what it cannot take goes to its siblings by their weights, and only
what all of them cannot take goes to their parents' siblings. A leaf's budget is filled by whole epochs and then by the
token-prefix of one more, in the order of a hash seeded by the epoch.

The prefix is found without sorting a leaf: token sums per hash bucket give the bucket where the budget ends, and only
that bucket is summed row by row. The result is a cut-off per leaf, so texts are filtered where they are read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_names

#: Hash buckets per leaf: one of them is sorted in one task.
BUCKET_BITS = 14
#: Budgets are whole tokens; what is short of one by less than this is rounding.
WHOLE = 1e-6
#: Leaves whose budgets are sent to every machine.
SENT_LEAVES = 100_000
#: What is planned for each leaf: whole epochs, tokens of one more, and the bucket, place and id where that ends.
PLANNED = ("whole", "rest", "last", "end_place", "end_doc")
Weights = Mapping[tuple, float]


def shares(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """Deal `budget` by weight, none above its room; what one cannot take goes to the others by weight."""
    out, free = [0.0] * len(weights), [i for i, r in enumerate(room) if r > 0 and weights[i] > 0]
    left = min(budget, sum(room[i] for i in free))
    while free and left > 1e-9:
        total = sum(weights[i] for i in free)
        full = [i for i in free if out[i] + left * weights[i] / total >= room[i]]
        if not full:
            for i in free:
                out[i] += left * weights[i] / total
            break
        for i in full:
            left -= room[i] - out[i]
            out[i] = room[i]
        free = [i for i in free if i not in full]
    return out


def budgets(supply: Mapping[tuple, int], weights: Weights, budget: int, epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf. `weights` has a weight for a path or, for all children at a depth, for (..., None) paths.

    A path without a weight has weight 1 beside its siblings. The work grows with the leaves times the depth.
    """
    room: dict[tuple, float] = {}
    children: dict[tuple, set[tuple]] = {}
    for leaf, n in supply.items():
        for d in range(len(leaf) + 1):
            room[leaf[:d]] = room.get(leaf[:d], 0.0) + float(n * epochs)
            if d:
                children.setdefault(leaf[: d - 1], set()).add(leaf[:d])

    def weight(path: tuple) -> float:
        for known in (path, (None,) * (len(path) - 1) + path[-1:]):
            if known in weights:
                return float(weights[known])
        return 1.0

    out: dict[tuple, int] = {}
    open_paths: list[tuple[tuple, float]] = [((), float(budget))] if supply else []
    while open_paths:
        path, amount = open_paths.pop()
        if path not in children:
            out[path] = int(amount + WHOLE)
            continue
        below = sorted(children[path], key=lambda p: [(x is not None, str(x)) for x in p])
        open_paths += zip(below, shares(amount, [weight(c) for c in below], [room[c] for c in below]), strict=True)
    return out


def estimated_tokens(column: str = "text") -> Column:
    """One token per started four bytes of UTF-8."""
    return F.ceil(F.coalesce(F.octet_length(column), F.lit(0)) / 4).cast("long")


def mixed_to_weights(docs: DataFrame, levels: list[str], weights: Weights, budget: int | None = None, share: float = 1.0, epochs: int = 1, seed: int = 0, tokens: Column | None = None) -> DataFrame:
    """The chosen rows of `docs`, with columns epoch and n_tokens; a row comes once per epoch it is chosen in.

    `budget` tokens are dealt, by default `share` of all there are. A null in a level column is a value of its own.
    Rows without tokens (null or empty texts) are chosen if the leaf has a budget and their place in the epoch's order
    is within it; a leaf without any token gives no row. Rows that share a doc_id, repeated rows among them, stand or
    fall together; ties of the order go by doc_id, a null id first. Texts count whole, however long. Columns of `docs`
    named epoch or n_tokens are replaced; others may have any names. An empty table gives an empty table.

    The driver holds one row per leaf, as the budgets of all leaves depend on each other; they are sent to the machines
    up to SENT_LEAVES, else joined.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("epoch", "n_tokens")]
    own = {n: free for n, free in zip(PLANNED, free_names([*kept, "epoch", "n_tokens"], *PLANNED), strict=True)}
    places = free_names([*kept, "epoch", "n_tokens"], *[f"leaf{i}" for i in range(len(levels))])
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], (estimated_tokens() if tokens is None else tokens).alias("n_tokens"))
    # Inside, only these columns go on, under names of their own.
    names = [f"leaf{i}" for i in range(len(levels))]
    light = rows.select(F.col("doc_id").alias("doc"), *[F.col(f"`{c}`").alias(n) for c, n in zip(levels, names, strict=True)], "n_tokens")
    sums = light.groupBy(*names).agg(F.sum("n_tokens").alias("n")).collect()
    supply = {tuple(r[n] for n in names): int(r.n or 0) for r in sums}
    total = sum(supply.values())
    plan = budgets(supply, weights, int(total * share) if budget is None else budget, epochs)
    small = (lambda df: F.broadcast(df)) if len(plan) <= SENT_LEAVES else (lambda df: df)
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, levels, strict=True))
    leaves = {p: (plan[p] // supply[p], plan[p] % supply[p]) if supply[p] else (0, 0) for p in sorted(supply, key=str)}
    dealt_to = spark.createDataFrame([(*p, *x) for p, x in leaves.items() if x[1]], f"{kinds}, whole long, rest long")

    def order_of(whole: Column, doc: Column) -> tuple[Column, Column]:
        """(hash bucket, place) of a document in an epoch: the first 60 bits of a digest, and the highest of them."""
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), whole.cast("string"), doc.cast("string")).cast("binary"))
        h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        return F.shiftrightunsigned(h, 60 - BUCKET_BITS), h

    def meets(left: str, right: str, pairs: list[tuple[str, str]]) -> Column:
        out = F.lit(True)
        for a, b in pairs:
            out = out & F.col(f"{left}.`{a}`").eqNullSafe(F.col(f"{right}.`{b}`"))
        return out

    same = [(n, n) for n in names]
    bucket, place = order_of(F.col("whole"), F.col("doc"))
    dealt = light.alias("d").join(small(dealt_to).alias("l"), meets("d", "l", same)).select(*[F.col(f"d.{n}") for n in names], "whole", "rest", "n_tokens", "doc")
    dealt = dealt.select("*", bucket.alias("bucket"), place.alias("place"))
    per_bucket = dealt.groupBy(*names, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = per_bucket.withColumn("upto", F.sum("n").over(upto)).where("upto > rest").groupBy(*names).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("x"))
    last = last.select(*names, F.col("x.bucket").alias("last"), F.col("x.before").alias("before"))
    inside = dealt.alias("d").join(small(last).alias("l"), meets("d", "l", same) & (F.col("d.bucket") == F.col("l.last"))).select("d.*", "before")
    # Without a frame, rows that share place and doc_id are summed together.
    peers = Window.partitionBy(*names).orderBy(F.struct("place", "doc"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(peers)).where("upto <= rest")
    ends = inside.groupBy(*names).agg(F.max(F.struct("place", "doc")).alias("end"))
    # All of these have one row per leaf at most.
    lasts = {tuple(r[n] for n in names): r["last"] for r in last.collect()}
    stops = {tuple(r[n] for n in names): r["end"] for r in ends.collect()}
    cut = [(*p, *x, lasts.get(p), stops[p]["place"] if p in stops else None, stops[p]["doc"] if p in stops else None) for p, x in leaves.items()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    at = ", ".join(f"`{place}` {docs.schema[c].dataType.simpleString()}" for place, c in zip(places, levels, strict=True))
    cut = spark.createDataFrame(cut, f"{at}, {own['whole']} long, {own['rest']} long, {own['last']} long, {own['end_place']} long, {own['end_doc']} {kind}")

    joined = rows.alias("r").join(small(cut).alias("l"), meets("r", "l", list(zip(levels, places, strict=True))))
    whole, rest, end, end_place, end_doc = (F.col(own[c]) for c in PLANNED)
    bucket, place = order_of(whole, F.col("doc_id"))
    # As structs are ordered: a null id comes first.
    before_end = F.struct(place.alias("place"), F.col("doc_id").alias("doc")) <= F.struct(end_place.alias("place"), end_doc.alias("doc"))
    within = (bucket == end) & end_place.isNotNull() & before_end
    partial = (rest > 0) & F.coalesce(end.isNull() | (bucket < end) | within, F.lit(False))
    times = (whole + partial.cast("long")).cast("int")
    return joined.where(times > 0).select(*[F.col(f"r.`{c}`") for c in kept], F.explode(F.sequence(F.lit(0), times - 1)).alias("epoch"), "n_tokens")


def mixed_sql(source: str, levels: list[str], weights: Weights, share: float, epochs: int, seed: int) -> str:
    """The result of mixed_to_weights() without a budget, in DuckDB's SQL: `levels`, doc_id, epoch and n_tokens of the rows of `source`."""

    def weight(depth: int) -> str:
        cases = []
        for path, w in weights.items():
            if len(path) == depth:
                named = " AND ".join(f"{levels[i]} IS NOT DISTINCT FROM '{v}'" for i, v in enumerate(path) if v is not None)
                cases.append(f"WHEN {named} THEN {float(w)}")
        return f"CASE {' '.join(cases)} ELSE 1.0 END" if cases else "1.0"

    steps = [
        f"rows AS (SELECT doc_id, {', '.join(levels)}, CAST(ceil(octet_length(encode(coalesce(text, ''))) / 4.0) AS BIGINT) AS n_tokens FROM {source})",
        f"amounts0 AS (SELECT CAST(trunc(sum(n_tokens) * CAST({share!r} AS DOUBLE)) AS DOUBLE) AS amount FROM rows)",
    ]
    for d in range(1, len(levels) + 1):
        own, above = ", ".join(levels[:d]), levels[: d - 1]
        meets = " AND ".join(f"n.{c} IS NOT DISTINCT FROM a.{c}" for c in above) or "true"
        by = f"PARTITION BY {', '.join(above)}" if above else ""
        # The level up to which all of a node's children are filled is the largest of those that fill some prefix of them.
        steps += [
            f"nodes{d} AS (SELECT {own}, CAST(sum(n_tokens) * {epochs} AS DOUBLE) AS room, {weight(d)} AS w FROM rows GROUP BY {own})",
            f"met{d} AS (SELECT n.*, a.amount AS budget FROM nodes{d} n JOIN amounts{d - 1} a ON {meets} WHERE n.room > 0 AND n.w > 0)",
            f"sums{d} AS (SELECT *, least(budget, sum(room) OVER ({by})) AS dealt, sum(w) OVER ({by}) AS weight, sum(room) OVER ({by} ORDER BY room / w, {own} ROWS UNBOUNDED PRECEDING) - room AS before, sum(w) OVER ({by} ORDER BY room / w, {own} ROWS UNBOUNDED PRECEDING) - w AS light FROM met{d})",
            f"amounts{d} AS (SELECT {own}, least(room, w * max((dealt - before) / (weight - light)) OVER ({by})) AS amount FROM sums{d})",
        ]
    d, leaf = len(levels), ", ".join(levels)
    meets = " AND ".join(f"r.{c} IS NOT DISTINCT FROM l.{c}" for c in levels)
    steps += [
        f"supply AS (SELECT {leaf}, sum(n_tokens) AS n FROM rows GROUP BY {leaf})",
        f"leaves AS (SELECT r.*, CAST(floor(a.amount + {WHOLE}) AS BIGINT) // n AS whole, CAST(floor(a.amount + {WHOLE}) AS BIGINT) % n AS rest FROM supply r JOIN amounts{d} a ON {meets.replace('l.', 'a.')} WHERE n > 0)",
        f"placed AS (SELECT r.*, whole, rest, CAST('0x' || substr(md5(concat_ws(':', '{seed}', CAST(whole AS STRING), CAST(doc_id AS STRING))), 1, 15) AS BIGINT) AS place FROM rows r JOIN leaves l ON {meets})",
        f"summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY place, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed)",
        "times AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n_times FROM summed)",
    ]
    return f"WITH {', '.join(steps)} SELECT doc_id, {leaf}, CAST(e AS INT) AS epoch, n_tokens FROM times, range({epochs}) AS t(e) WHERE e < n_times"
