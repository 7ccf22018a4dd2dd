"""Chunk recipes, periodic runs and the source audit against plain versions, with odd rows in every column."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shutterloom.llm import chunks, divergence, periodic, queries
from shutterloom.llm.bytewords import string_bytes
from shutterloom.llm.shared import Tables

DOCS = "doc_id long, text string, lang string, source string, keep_id string, `runs` int, `a.b` int"


def words_of(text):
    return re.findall("[^ \\t-\\r]+", text or "")


def odd_docs(seed=3, n=60):
    rng, rows = random.Random(seed), []
    some = ["", None, " ", "\t\n", "a", "a " * 400, "é漢 " * 300, "x" * 40_000, "word " * 9_000, "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(5000))]
    some += [" ".join(rng.choice(("ba", "na", "Na", "é")) for _ in range(rng.randint(1, 900))) for _ in range(12)]
    for k in range(n):
        rows.append((rng.choice([k, k, k, 7, None]), rng.choice(some), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "s4", None]), "x", k, k))
    rows += [rows[-1]] * 3 + [(rows[-1][0], *rows[-1][1:5], 99, 99)]
    return rows


def told(df):
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


# --- 11 ---


def wanted_copies(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in sorted(ids, key=lambda i: (i is None, -(i or 0))):
            out.append((i, keep, len(ids), bool(left), hashlib.sha256(text.encode()).hexdigest()))
            left = 0
    return sorted(map(str, out))


@pytest.mark.parametrize("hashes_and_bits", [(2, 64), (1, 8)])
def test_copies_are_the_equal_texts(spark, hashes_and_bits):
    rows = odd_docs()
    got = chunks.exact_copies(spark.createDataFrame(rows, DOCS).repartition(5), Tables(spark), *hashes_and_bits)
    assert got.columns == ["doc_id", "lang", "source", "runs", "a.b", "keep_id", "group_size", "kept", "n_chunks"]
    mine = spark.createDataFrame([(r[0], r[1], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows], "doc_id long, text string, text_sha256 string")
    got = chunks.exact_copies(mine, Tables(spark), *hashes_and_bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == wanted_copies(rows)


def test_identifiers_grow_until_they_tell_chunks_apart(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(40)], "doc_id long, text string")
    assert chunks._ambiguous(docs, 1, 3) and not chunks._ambiguous(docs, 2, 64)
    assert chunks.exact_copies(docs, Tables(spark), 1, 3).where("group_size > 1 OR NOT kept").isEmpty()


def test_no_documents_no_copies(spark):
    assert chunks.exact_copies(spark.createDataFrame([], DOCS), Tables(spark)).collect() == []


def test_ids_may_be_strings(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "y")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in chunks.exact_copies(docs, Tables(spark)).collect()} == {("a", "b", False), ("b", "b", True), (None, None, True)}


def test_cuts_follow_content_alone():
    rng = np.random.default_rng(1)
    text = rng.integers(32, 127, 200_000, dtype=np.uint8)
    alone = chunks.chunk_ends(np.array([0, len(text)]), text)[0]
    for before in (1, 31, 777, (1 << 20) - 1000):
        data = np.concatenate((rng.integers(32, 127, before, dtype=np.uint8), text))
        assert chunks.chunk_ends(np.array([0, before, len(data)]), data)[1] == alone
    sizes = np.diff([0, *alone])
    assert sizes[:-1].min() >= chunks.LEAST and sizes.max() <= chunks.MOST and 700 < sizes.mean() < 2000
    late = chunks.chunk_ends(np.array([0, len(text) - 5000]), text[5000:])[0]
    shared = {e - 5000 for e in alone} & set(late)
    assert len(shared) > 0.9 * len(late), "an edit at the beginning leaves later chunks as they were"
    assert chunks.chunk_ends(np.array([0, 50_000]), np.zeros(50_000, np.uint8))[0][-1] == 50_000
    assert chunks.chunk_ends(np.array([0, 0, 3]), np.zeros(3, np.uint8)) == [[], [3]]


def test_chunks_join_to_the_text(spark):
    import pyarrow as pa

    texts = ["".join(random.Random(k).choice("ab é漢\n") for _ in range(k * 700)) for k in range(9)]
    for text, ends in zip(texts, chunks.chunk_ends(*string_bytes(pa.array(texts))), strict=True):
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip([0, *ends], ends, strict=False)) == raw
        assert ends == sorted(set(ends))


# --- 12 ---


def plain_runs(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= 2 * q:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= max(least, times * q)), key=lambda r: (r[0], r[2]))


def looping_words(rng):
    w = [str(rng.randint(0, rng.choice([1, 2, 3, 10]))) for _ in range(rng.randint(0, 50))]
    for _ in range(rng.randint(0, 3)):
        if w:
            a = rng.randrange(len(w))
            b = rng.randint(a + 1, min(len(w), a + 12))
            w = w[:b] + w[a:b] * rng.randint(0, 8) + w[b:]
    return [x.encode() for x in w]


@pytest.mark.parametrize("few", [0, 12, 10**6])
def test_runs_are_all_maximal_repetitions(few, monkeypatch):
    monkeypatch.setattr(periodic, "FEW", few)
    for seed in range(60):
        rng = random.Random(seed)
        texts = [looping_words(rng) for _ in range(rng.randint(1, 6))]
        for least, times in ((6, 4), (2, 2), (4, 3)):
            for w, got in zip(texts, periodic.runs_of(texts, least, times), strict=True):
                assert [tuple(r) for r in got.tolist()] == plain_runs(w, least, times)


def test_runs_of_words_of_a_fibonacci_text_and_of_one_word():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 3000:
        a, b = b, b + a
    assert [tuple(r) for r in periodic.runs_of([b], 2, 2)[0].tolist()] == plain_runs(b, 2, 2)
    assert periodic.runs_of([[b"x"] * 30_000])[0].tolist() == [[0, 30_000, 1]]


def test_periodic_runs_of_odd_rows(spark):
    rows = odd_docs()
    got = periodic.periodic_runs(spark.createDataFrame(rows, DOCS).repartition(3))
    assert got.columns == ["doc_id", "lang", "source", "keep_id", "a.b", "runs", "collapsed"]
    wanted = []
    for row in rows:
        w = words_of(row[1])
        # The one very long run is known; the plain version is for the others.
        runs = plain_runs(w) if len(w) < 2000 else [(0, len(w), 1)]
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        wanted.append((row[0], row[6], [tuple(r) for r in runs], " ".join(x for k, x in enumerate(w) if k not in dropped)))
    assert sorted(map(str, wanted)) == sorted(str((r.doc_id, r["a.b"], [tuple(x) for x in r.runs], r.collapsed)) for r in got.collect())
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(spark.createDataFrame([], DOCS), times=1)


def test_op12_equals_the_plain_version(spark, sf):
    wanted = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w, h = words_of(r.text), zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
        text = " ".join(x for k, x in enumerate(w) if k not in dropped)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        wanted.append((r.doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, text))))
    known = {x[0] for x in wanted}
    got = queries.op12_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in got.collect() if r.doc_id in known)
    assert len(wanted) > 100 and any(x[1] for x in wanted)


# --- 13 ---


def plain_audit(rows, documents, best):
    rows = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        within = Counter(t for r in own for t in set(r[2]))
        kept = sorted(t for t, n in within.items() if n >= documents)
        counts = {s: Counter(t for r in own if r[1] == s for t in r[2]) for s in {r[1] for r in own}}
        whole = sum(counts.values(), Counter())

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: share(c) for s, c in counts.items()}
        q = share(whole)
        for s in counts:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:best]
            out += [(lang, s, part, item, value, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (value, item) in enumerate(found)]
    return sorted(map(str, out))


@pytest.mark.parametrize(("groups", "terms", "documents", "best"), [(128, 256, 2, 50), (2, 3, 1, 2), (1, 1, 3, 5), (2, 4, 1000, 3)])
def test_audit_equals_the_plain_version(spark, monkeypatch, groups, terms, documents, best):
    for name, value in (("GROUPS", groups), ("TERMS", terms), ("DOCUMENTS", documents), ("BEST", best), ("HELD", 50)):
        monkeypatch.setattr(divergence, name, value)
    rows = odd_docs() + [(1, "ONLY here", "xx", "alone", "x", 1, 1), (1, None, "yy", "s", "x", 1, 1), (1, "", "yy", "t", "x", 1, 1)]
    got = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(4), Tables(spark)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_audit([(r[2], r[3], r[1]) for r in rows], documents, best)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS), Tables(spark)).collect() == []


def test_shares_are_exact_beyond_64_bits():
    for count, total, terms in ((9 * 10**14, 9 * 10**15 - 10, 1), (3, 3, 1), (0, 10**12 + 7, 10**5), (10**10 + 3, 10**11 + 1, 77)):
        assert divergence.shares(np.array([count]), total, terms)[0] == 1 + 10**9 * (count + 5) // (total + 5 * terms)


# --- SQL ---


@pytest.mark.parametrize("name", ["op11_chunk_recipes", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got, wanted = queries.queries()[name](spark, sf).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert len(got) and told(got[sorted(got.columns)]) == told(wanted[sorted(got.columns)])


# --- 6 and 9 again ---


def test_a_large_cluster_of_near_vectors_is_counted_whole(spark):
    rng = np.random.default_rng(5)
    center = rng.normal(size=32)
    rows = center + rng.normal(size=(1500, 32)) * 0.03
    from shutterloom.llm import neighbours

    got = neighbours.near_vectors(spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(rows)], "vec_id long, embedding array<double>"), Tables(spark)).collect()
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(((unit @ unit.T >= 0.9).sum(1) - 1).tolist()))
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_a_task_that_runs_again_meets_its_rows_in_the_same_order(spark):
    from shutterloom.llm import suffixes

    passage = " ".join(f"w{k}" for k in range(80))
    texts = [(d, 7, f"{d} {passage} {d}") for d in range(40)]
    places = [(d, 7, np.arange(0, 60, 2, dtype=np.int32).tobytes()) for d in range(40)]
    sent = []
    for order in (1, -1):
        rows = [spark.createDataFrame(x[::order], s).coalesce(1) for x, s in ((texts, "doc long, mark long, text string"), (places, "doc long, mark long, places binary"))]
        for joined in (F.broadcast(rows[1]), rows[1].hint("shuffle_hash")):
            around = suffixes._ordered(rows[0], joined).coalesce(1)
            assert [r.doc for r in around.collect()] == list(range(40))
            sent.append([tuple(r) for r in around.mapInArrow(suffixes._surroundings(25, 26), suffixes._AROUND).collect()])
    assert all(s == sent[0] for s in sent)


# --- 10 again ---


def test_of_thousands_of_rules_few_run_on_a_url(spark):
    from shutterloom.llm import url_rules

    rng = random.Random(4)
    syllables = ["ba", "ko", "ri", "shop", "news", "mix", "tu", "lan", "vex", "pro"]
    hosts = sorted({".".join(["".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(1, 2))] + [rng.choice(["com", "org", "example"])]) for _ in range(3500)})[:3000]
    rules = [(rng.choice(["allow", "block"]), h, rng.choice(["/", "/a/", "/list", ""])) for h in hosts]
    urls = [f"https://{rng.choice(['', 'www.', 'x.y.'])}{rng.choice(hosts)}{rng.choice(['/', '/a/b', '/lists?q', '', '/z'])}" for _ in range(400)]
    table = url_rules.host_path_rules(spark, rules, own=[])
    got = {r.url: (r.rule, r.verdict) for r in url_rules.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), table).join(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "page_id").collect()}
    for url in urls:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and (path.startswith(p))]
        best = max(fits, default=None)
        assert got[url] == ((best[1], best[2]) if best else (None, "allow"))
    sizes = [r.n for r in url_rules.filed(table).where("token like '%*'").select((F.length("token") - 1).alias("n")).distinct().collect()]
    targets = spark.createDataFrame([(u, u.split("://", 1)[1]) for u in set(urls)], "url string, target string")
    tokens = targets.select("url", F.explode(url_rules.url_tokens(F.col("target"), sorted(sizes))).alias("token"))
    met = tokens.join(url_rules.rule_index(table, tokens), "token").groupBy("url").count()
    assert met.agg(F.avg("count")).first()[0] < 12, "of 3,000 rules a handful runs on each url"
