"""Parity join, suffix arrays, fingerprints and BPE against brute force, with odd rows in every column."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from shutterloom.llm import bpe, bytewords, fingerprints, parity_join, suffixes
from shutterloom.llm.shared import Tables

DOCS = "doc_id long, text string, lang string, n_chars long, key long, rep string"


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def corpus(seed=3, n=90):
    """Random texts, exact and near copies, shared passages, short, empty, null and very long texts, repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["É", "the", "of", "　x", "A B"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    rows, passage = [], text(70)
    for i in range(n):
        kind = i % 9
        if kind == 1 and rows:
            new = rows[-1][1]
        elif kind == 2 and rows:
            parts = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            for _ in range(max(1, len(parts) // 40)):
                parts[rng.randrange(len(parts))] = "edit"
            new = " ".join(parts)
        elif kind == 3:
            new = text(rng.randint(0, 6))
        elif kind == 4:
            new = text(30) + " " + passage + "\n" + text(20)
        elif kind == 5:
            new = rng.choice([None, "", "  \t\n ", "one", "Two  WORDS"])
        elif kind == 6:
            new = ("ha " * rng.randint(3, 120)).strip()
        else:
            new = text(rng.randint(5, 260))
        rows.append((i * 3, new))
    rows.append((1000, text(9000)))
    rows.append((1001, rows[-1][1] + " tail"))
    return rows


def frame(spark, rows, partitions=3):
    full = [(i, t, "en", len(t or ""), 7, "x") for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


def brute_components(rows, q, num, den):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + q]) for k in range(len(w) - q + 1)} if len(w) >= q else ({tuple(w)} if w else set())
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("q", "num", "den", "seed"), [(4, 85, 100, 3), (5, 4, 5, 4), (2, 1, 2, 5)])
def test_parity_join_equals_brute_force(spark, q, num, den, seed):
    rows = corpus(seed)
    got = parity_join.parity_join(frame(spark, rows), Tables(spark), q, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, q, num, den)


def test_parity_join_with_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (9, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.parity_join(frame(spark, rows), Tables(spark)).collect()), key=str)
    assert got == [(2, 2, 2), (5, 2, 2), (5, 2, 2), (9, 0, 9), (None, 2, None)]
    assert parity_join.parity_join(frame(spark, []), Tables(spark)).count() == 0


def test_equal_blocks_are_guaranteed():
    rng = np.random.default_rng(1)
    for n in [*range(1, 60), 100, 333, 2000]:
        own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for d in range(0, max(1, n // 7)):
            other = np.unique(np.concatenate((own[d:], rng.integers(0, 1 << 63, d // 2, dtype=np.uint64))))
            common = len(np.intersect1d(own, other))
            if common and 100 * common >= 85 * (len(own) + len(other) - common):
                keys = [set(parity_join.block_keys(x, 85, 100).tolist()) for x in (own, other)]
                assert keys[0] & keys[1], (n, d)


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(2)
    for n in (3, 80, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64))))
        x, y = parity_join.stacked([parity_join.sketch(a), parity_join.sketch(b)])
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_words_are_those_of_the_pattern():
    texts = ["Ab  c\td\x0be", "", "ÉA　b", " x ", "\n\n", "a" * 5000]
    seen = []
    for w in bytewords.word_chunks(pa.array(texts)):
        seen += [int(w.bounds[i + 1] - w.bounds[i]) for i in range(len(w))]
    assert seen == [len(words_of(t)) for t in texts]


def brute_repeats(rows, least):
    grams = {}
    for i, t in sorted(rows):
        w = words_of(t)
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), []).append((i, k))
    later, first = set(), set()
    for places in grams.values():
        if len(places) > 1:
            places.sort()
            first.add(places[0])
            later.update(places[1:])
    return later, first


@pytest.mark.parametrize(("least", "prefix"), [(50, 25), (12, 5), (9, 8)])
def test_repeats_equal_brute_force(spark, least, prefix):
    rows = corpus(8)
    got = suffixes.repeats(frame(spark, rows), Tables(spark), least, prefix).collect()
    later = {(r.doc_id, p) for r in got for p in r.later}
    first = {(r.doc_id, p) for r in got for p in r.first}
    assert (later, first) == brute_repeats(rows, least)


def test_cut_keeps_the_first_occurrence_and_clean_rows(spark):
    passage = " ".join("p%d" % i for i in range(60))
    rows = [(1, "alpha " + passage + " omega"), (2, "Beta  " + passage + " gamma"), (3, passage), (4, None), (5, ""), (6, "clean text\tstays")]
    docs = frame(spark, rows)
    found = suffixes.repeats(docs, Tables(spark))
    out = {r.doc_id: r for r in suffixes.without_repeats(docs, found).collect()}
    assert out[1].text == rows[0][1]
    assert out[2].text == "Beta   gamma"
    assert out[2].n_chars == len(out[2].text)
    assert 3 not in out
    assert out[4].text is None and out[5].text == "" and out[6].text == rows[5][1]
    spans = {tuple(r) for r in suffixes.repeated_spans(found).collect()}
    assert spans == {(1, 1, 61, True, 1), (2, 1, 61, False, 1), (3, 0, 60, False, 1)}
    nothing = suffixes.repeats(frame(spark, []), Tables(spark))
    assert nothing.count() == 0
    assert suffixes.without_repeats(frame(spark, []), nothing).count() == 0


def test_rows_that_repeat_are_cut_but_for_one(spark):
    long, other = " ".join("r%d" % i for i in range(70)), " ".join("s%d" % i for i in range(55))
    rows = [(1, long), (1, long), (1, long), (2, "head " + long), (4, "few words"), (4, "few words"), (5, other), (5, other), (6, long + " x"), (6, long + " y")]
    docs = frame(spark, rows).withColumn("_cut0", F.monotonically_increasing_id())
    found = suffixes.repeats(docs, Tables(spark))
    got = suffixes.without_repeats(docs, found)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, long), (2, "head "), (4, "few words"), (4, "few words"), (5, other), (6, " x"), (6, " y")]
    spans = sorted(tuple(r) for r in suffixes.repeated_spans(found).collect())
    assert spans == [(1, 0, 70, False, 2), (1, 0, 70, True, 1), (2, 1, 71, False, 1), (5, 0, 55, False, 1), (6, 0, 70, False, 1), (6, 0, 70, False, 1)]


@pytest.mark.parametrize(("least", "prefix"), [(50, 25), (9, 6)])
def test_equal_hashes_do_not_cut_different_words(spark, monkeypatch, least, prefix):
    monkeypatch.setattr(suffixes, "passage_hashes", lambda ids, q: np.zeros(max(0, len(ids) - q + 1), np.uint64))
    rows = corpus(8)
    batch = list(suffixes._surroundings(prefix, least - prefix + 1)(around_batches(rows, least, prefix)))
    whole = pa.concat_batches(batch)
    order = pa.compute.sort_indices(whole, sort_keys=[(c, "ascending") for c in ("deal", "doc", "mark", "place")])
    whole = whole.take(order)
    whole = whole.set_column(0, "deal", pa.array(np.zeros(len(whole), np.int64)))
    out = suffixes._compared_rows(whole, least).to_pydict()
    later = {(d, p + j) for d, p, m in zip(out["doc"], out["place"], out["later"], strict=True) for j in range(63) if m >> j & 1}
    # Sorted by deal, not by place, so only the union of first and later is told.
    first = {(d, p + j) for d, p, m in zip(out["doc"], out["place"], out["first"], strict=True) for j in range(63) if m >> j & 1}
    a, b = brute_repeats(rows, least)
    assert later | first == a | b


def around_batches(rows, least, prefix):
    """Every kept suffix of all rows, as if each had been repeated."""
    texts = pa.array([t or "" for _, t in rows])
    places = [[] for _ in rows]
    for words in bytewords.word_chunks(texts):
        every = suffixes.long_grams(words.hashes, prefix)
        for i in range(len(words)):
            a, b = words.bounds[i], words.bounds[i + 1]
            if b - a >= least:
                places[words.first + i] = (2 * suffixes.minimisers(every[a : b - prefix + 1], least - prefix + 1)).tolist()
    packed = pa.array([np.array(p, np.int32).tobytes() for p in places], pa.binary())
    ids = pa.array([i for i, _ in rows], pa.int64())
    yield pa.RecordBatch.from_arrays([ids, ids, texts, packed], ["doc", "mark", "text", "places"])


def test_beginnings_that_very_many_share(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MANY", 2)
    monkeypatch.setattr(suffixes, "REMEMBERED", 2000)
    monkeypatch.setattr(suffixes, "COMPARED", 3000)
    rows = corpus(9)
    got = suffixes.repeats(frame(spark, rows), Tables(spark), 20, 9).collect()
    later = {(r.doc_id, p) for r in got for p in r.later}
    first = {(r.doc_id, p) for r in got for p in r.first}
    assert (later, first) == brute_repeats(rows, 20)


def test_a_very_long_text(spark):
    rng = random.Random(3)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(120_000))
    cut = text.split(" ")
    again = " ".join(cut[50_000:50_200])
    found = suffixes.repeats(frame(spark, [(1, text), (2, "a " + again + " b")]), Tables(spark))
    assert {tuple(r) for r in suffixes.repeated_spans(found).collect()} == {(1, 50_000, 50_200, True, 1), (2, 1, 201, False, 1)}


def jaccard(a, b):
    def bag(text):
        return Counter(t for w in text.lower().split() for t in ([w] if len(w) <= 20 else [w[k : k + 4] for k in range(len(w) - 3)]))

    a, b = bag(a), bag(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints_of_edited_and_next(spark):
    rows = [(i, t) for i, t in corpus(11) if i != 9]
    got = {r.doc_id: r for r in fingerprints.edited_and_next(frame(spark, rows), 5).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows)
    off = []
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].n_chars == len(t)
        if t.split() and n.split():
            off.append(got[i].near_edited - jaccard(t, edited))
            off.append(got[i].near_next - jaccard(t, n))
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.1
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint


def test_fingerprint_likeness_is_generalised_jaccard(spark):
    a = " ".join(["x"] * 6 + ["y"] * 3 + ["z"])
    b = " ".join(["x"] * 3 + ["y"] * 3 + ["q"] * 2)
    sigs = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(frame(spark, [(1, a), (2, b), (3, a), (4, ""), (5, None)]), 1024).collect()}
    assert sigs[1] == sigs[3] and sigs[4] == sigs[5] == ""
    parts = [[s[k : k + 8] for k in range(0, len(s), 8)] for s in (sigs[1], sigs[2])]
    same = sum(x == y for x, y in zip(*parts, strict=True)) / 1024
    assert abs(same - jaccard(a, b)) < 0.05


def test_scripts_without_blanks_are_alike_by_their_characters(spark):
    rng = random.Random(4)
    text = "".join(chr(rng.randint(0x4E00, 0x4F00)) for _ in range(600))
    near = text[:300] + "一" + text[300:]
    got = {r.doc_id: r for r in fingerprints.edited_and_next(frame(spark, [(1, text), (2, near)]), 2).collect()}
    assert got[1].near_next > 0.85 and abs(got[1].near_edited - jaccard(text, text[:450] + near[:150])) < 0.25


def test_ranges_of_any_ids_and_repeated_rows(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 5, 5, 5, -(10**15), 7, 10**15]), rng.choice([None, "", "a b", "t%d" % rng.randrange(60)])) for _ in range(150)]
    rows += [(5, "same text here")] * 20 + [(8, "long " * 60_000)]
    got = fingerprints.edited_and_next(frame(spark, rows, 5), 24).collect()
    assert len(got) == len(rows)
    marks = {t or "": m for t, m in frame(spark, rows).select("text", fingerprints.text_mark().alias("m")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, marks[r[1] or ""], r[1] or ""))
    wanted = []
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, n = t or "", n or ""
        wanted.append((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(wanted, key=str)


def test_range_search(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 9, 50, 101):
        bounds = sorted(rng.randint(-40, 40) for _ in range(n))
        rows = [(rng.randint(-45, 45), rng.randint(-(2**63), 2**63 - 1)) for _ in range(200)] + [(None, 3)]
        got = spark.createDataFrame(rows, "doc_id long, mark long").select("*", fingerprints.range_of(bounds, F.col("doc_id"), F.col("mark")).alias("r")).collect()
        for r in got:
            same = bounds.count(r.doc_id)
            wanted = 0 if r.doc_id is None else sum(b < r.doc_id for b in bounds) + int(((r.mark + 2**63) >> 33) / 2**31 * same)
            assert r.r == wanted


def test_one_document_follows_itself(spark):
    (row,) = fingerprints.edited_and_next(frame(spark, [(7, "abcdefgh")]), 4).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
    assert fingerprints.edited_and_next(frame(spark, []), 4).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    import tiktoken

    return ranks, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(tokenizer):
    ranks, pattern, reference = tokenizer
    rng = random.Random(5)
    alphabet = "aaabbc d\n\t  é\x1c\x85　'sßñ10² 漢字<|>.,!!'ll​\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["a" * 3000, " " * 2000, "ab" * 5000, "", "\x1c\x1d a", "<|endoftext|>"] + ["".join(chr(rng.randint(1, 0x2FFF)) for _ in range(30)) for _ in range(400)]
    replay = bpe.MergeReplay(ranks, pattern)
    got = list(replay.encode(texts))
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert [replay.decode(i) for i in got] == [t.encode() for t in texts]


def test_bpe_where_a_lower_rank_comes_up():
    letters = {bytes([b]): b for b in range(256)}
    ranks = letters | {b"abc": 300, b"bc": 301, b"ab": 302, b"cab": 299, b"aa": 303, b"aaa": 298}
    replay = bpe.MergeReplay(ranks, r"\S+")
    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(400)}
    replay.learn(words)
    for w in words:
        ids = list(w.encode())
        if w.encode() in ranks:
            ids = [ranks[w.encode()]]
        while True:
            pairs = [(ranks.get(replay.names[x] + replay.names[y], 10**9), k) for k, (x, y) in enumerate(zip(ids, ids[1:], strict=False))]
            if not pairs or min(pairs)[0] == 10**9:
                break
            rank, k = min(pairs)
            ids[k : k + 2] = [rank]
        assert list(replay.memory[w]) == ids, w


def test_a_very_long_word_whose_order_is_in_doubt():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 303, b"aaa": 298, b"ab": 302, b"ba": 301, b"aba": 300}
    replay = bpe.MergeReplay(ranks, r"\S+")
    rng = random.Random(8)
    short = "".join(rng.choice("aab") for _ in range(700))
    ids = list(short.encode())
    while True:
        pairs = [(ranks.get(replay.names[x] + replay.names[y], 10**9), k) for k, (x, y) in enumerate(zip(ids, ids[1:], strict=False))]
        rank, k = min(pairs)
        if rank == 10**9:
            break
        ids[k : k + 2] = [rank]
    assert list(replay._one_by_one(short.encode())) == ids == next(replay.encode([short]))
    long = "".join(rng.choice("aab") for _ in range(300_000))
    start = time.perf_counter()
    got = next(replay.encode([long]))
    assert replay.decode(got) == long.encode() and time.perf_counter() - start < 60
    assert got == list(replay._one_by_one(long.encode()))


def test_bpe_columns(spark, tokenizer):
    ranks, pattern, reference = tokenizer
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Hello world", "z"), (3, "Hello world", "z")], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.with_tokens(docs, ranks, pattern, bpe.digests, bpe.DIGESTS).collect())
    empty, ids = hashlib.sha256(b"").hexdigest(), " ".join(map(str, reference.encode_ordinary("Hello world")))
    whole = (3, 2, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"Hello world").hexdigest())
    assert got == [(1, 0, empty, empty), (2, 0, empty, empty), whole, whole]
    assert bpe.with_tokens(docs.limit(0), ranks, pattern, bpe.tokens_and_bytes, bpe.TOKENS).count() == 0
