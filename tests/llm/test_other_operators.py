"""Chat windows, mixing, vectors, URL rules, toxicity, shards and the pipeline, with odd rows in every column."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_text_operators import brute_components, brute_repeats, words_of

from shutterloom.llm import chat, mixing, neighbours, queries, shards, toxicity, url_rules
from shutterloom.llm.shared import Tables, shared_folder

# --- chat ---


def turns(seed=1):
    rng, rows = random.Random(seed), []
    pieces = ["hello", "\\", "<|", "<|im_end|>", "\n", "é漢", "\\n", "<\\|", "ok "]
    for conv in range(12):
        n = rng.randint(1, 30)
        for t in range(n):
            role = "system" if t == 0 and conv % 2 else ["user", "assistant", "tool\nx"][t % 3]
            rows.append((conv, t, role, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))))
    rows += [(None, 0, "user", "who"), (None, 1, "assistant", None), (50, None, None, "x"), (50, 3, "assistant", "y" * 9000), (50, 3, "assistant", "y" * 9000)]
    return rows


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("budget", "history"), [(60, 20), (1024, 256), (1, 0)])
def test_windows_read_back_to_the_conversation(spark, budget, history):
    rows = turns()
    windows = chat.chat_windows(spark.createDataFrame(rows, TURNS).repartition(5), budget, history)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    wanted = {}
    for conv, t, role, text in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        wanted.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(wanted)
    for conv, said in wanted.items():
        learned = "".join(x for role, x in said if role == "assistant")
        assert got[conv].n_turns == len(said)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_windows_keep_the_system_turn_the_history_and_the_budget(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, "user" if t % 2 else "assistant", "word " * 8) for t in range(1, 40)]
    got = sorted(chat.chat_windows(spark.createDataFrame(rows, TURNS), 100, 30).collect(), key=lambda r: r.window)
    assert len(got) > 3
    for r in got:
        said = list(chat.read_turns(r.text))
        assert said[0] == ("system", "be brief")
        assert r.n_tokens == sum(chat.turn_tokens(*t) for t in said) <= 100
        assert len(said) == r.n_repeated + r.n_new
        if r.window:
            assert r.n_repeated >= 2
    assert sum(r.n_new for r in got) == 40
    assert sum(len(r.loss_spans) for r in got) == 19


def test_history_is_bounded_by_tokens_alone(spark):
    rows = [(1, t, "user", "") for t in range(1000)]
    got = chat.chat_windows(spark.createDataFrame(rows, TURNS), 2000, 1000, lambda role, text: 5).collect()
    assert [(r.n_repeated, r.n_new) for r in sorted(got, key=lambda r: r.window)] == [(0, 400), (200, 200), (200, 200), (200, 200)]


def test_history_is_bounded_by_its_tokens_alone(monkeypatch):
    for block in (4096, 350):
        monkeypatch.setattr(chat, "BLOCK", block)
        talk = chat._Conversation(1, 300, 100, lambda role, text: 1)
        windows = [w for k in range(5000) for w in talk.add("user", f"t{k}")] + list(talk.cut(last=True))
        assert sum(w[3] for w in windows) == 5000
        assert [w[2] for w in windows] == [0] + [100] * (len(windows) - 1)
        assert list(chat.read_turns(windows[1][5]))[0] == ("user", "t200")


def test_windows_do_not_depend_on_blocks(spark, monkeypatch):
    rows = turns(5) + [(70, t, "assistant", "z" * (t % 50)) for t in range(3000)]
    data = spark.createDataFrame(rows, TURNS)
    wanted = sorted(map(tuple, chat.chat_windows(data, 500, 90).collect()), key=str)
    monkeypatch.setattr(chat, "BLOCK", 3)
    monkeypatch.setattr(chat, "HELD", 0)
    assert sorted(map(tuple, chat.chat_windows(data, 500, 90).collect()), key=str) == wanted


@pytest.mark.parametrize("kind", ["tinyint", "decimal(9,2)", "date", "double", "boolean"])
def test_null_conversations_of_any_type(spark, kind):
    data = spark.sql(f"SELECT CAST(NULL AS {kind}) conv_id, 1L turn, 'user' role, 'a' text, 1 window")
    (row,) = chat.read_back(chat.chat_windows(data)).collect()
    assert row.conv_id is None and row.n_turns == 1


def test_a_very_long_turn_is_a_window_of_its_own(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|" * 400_000), (1, 2, "user", "bye")]
    windows = chat.chat_windows(spark.createDataFrame(rows, TURNS))
    assert sorted(r.n_new for r in windows.collect()) == [1, 1, 1]
    (row,) = chat.read_back(windows).collect()
    assert (row.n_turns, row.loss_chars) == (3, 800_000)


def test_no_turns(spark):
    assert chat.read_back(chat.chat_windows(spark.createDataFrame([], TURNS))).count() == 0


def test_escapes_are_reversible():
    for text in ("", "\\", "<|im_end|>", "a\\\\<|b", "<\\|", "\\n", "<<||"):
        assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)


# --- mixing ---


def test_shortages_go_to_siblings_first():
    supply = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    got = mixing.budgets(supply, {("a",): 1.0, ("b",): 1.0}, 600, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 290, ("b", "z"): 300}
    got = mixing.budgets({("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 1000}, {}, 600, 2)
    assert got == {("a", "x"): 20, ("a", "y"): 40, ("b", "z"): 540}
    assert mixing.budgets({}, {}, 5, 1) == {}
    assert mixing.shares(10, [0, 1], [5, 3]) == [0.0, 3]


def test_prefixes_equal_a_sorted_leaf(spark):
    rng = random.Random(2)
    rows = [(i, "t" * rng.randint(0, 90), rng.choice(["en", "de", None]), "s%d" % (i % 3), "keep", "clash") for i in range(600)] + [(5, "same id", "en", "s2", "keep", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, other string, epoch string").repartition(4)
    got = mixing.mixed_to_weights(docs, ["lang", "source"], {("en",): 3.0}, None, 0.7, 2, 9)
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "other", "epoch", "n_tokens"}
    chosen = sorted((r.doc_id, r.text, r.epoch) for r in got.collect())
    tokens = lambda t: -(-len(t) // 4)
    supply = {}
    for r in rows:
        supply[r[2], r[3]] = supply.get((r[2], r[3]), 0) + tokens(r[1])
    plan = mixing.budgets(supply, {("en",): 3.0}, int(sum(supply.values()) * 0.7), 2)
    wanted = []
    for leaf, budget in plan.items():
        own = [r for r in rows if (r[2], r[3]) == leaf]
        whole, rest = budget // supply[leaf], budget % supply[leaf]
        order = {r[0]: int(hashlib.md5(f"9:{whole}:{r[0]}".encode()).hexdigest()[:15], 16) for r in own}
        for e in range(whole):
            wanted += [(r[0], r[1], e) for r in own]
        used = 0
        for key in sorted({(order[r[0]], r[0]) for r in own}):
            group = [r for r in own if r[0] == key[1]]
            used += sum(tokens(r[1]) for r in group)
            if used > rest:
                break
            wanted += [(r[0], r[1], whole) for r in group]
    assert chosen == sorted(wanted)
    assert mixing.mixed_to_weights(docs.limit(0), ["lang", "source"], {}).count() == 0


def test_mixing_with_any_names_and_odd_rows(spark):
    names = ["whole", "rest", "last", "end_place", "end_doc", "times", "leaf0", "_leaf0", "_whole0", "n_tokens", "bucket", "doc"]
    kind = "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names)
    odd = [(1, "a" * 40, "s"), (1, "a" * 40, "s"), (2, None, None), (3, "", "s"), (None, "b" * 40, None), (4, "c" * 400_000, "t"), (5, "d" * 8, "s")]
    docs = spark.createDataFrame([(*r, *([7] * len(names))) for r in odd], kind)
    got = mixing.mixed_to_weights(docs, ["source"], {}, None, 1.0, 1, 3)
    assert got.columns == [c for c in docs.columns if c != "n_tokens"] + ["epoch", "n_tokens"]
    assert sorted(((r.doc_id, r.text, r.source) for r in got.collect()), key=str) == sorted(odd, key=str)
    assert all(r[n] == 7 for r in got.collect() for n in names if n != "n_tokens")
    # Equal rows stand or fall together; every row comes twice in two epochs.
    for share in (0.00005, 0.0002, 0.5):
        ids = [r.doc_id for r in mixing.mixed_to_weights(docs, ["source"], {}, None, share, 1, 3).collect()]
        assert ids.count(1) in (0, 2)
    assert mixing.mixed_to_weights(docs, ["source"], {}, 10**9, 1.0, 2, 3).count() == 2 * len(odd)


# --- vectors ---


def clustered(seed=4, n=400, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    for i in range(0, n, 4):
        base[i + 1] = base[i] + rng.normal(size=dim) * rng.uniform(0.05, 0.5)
        base[i + 2] = base[i] * 3.0
    return [(i * 2, [float(np.float32(v)) for v in x]) for i, x in enumerate(base)]


def test_links_equal_brute_force(spark):
    rows = clustered()
    rows += [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [None] * 24), (9005, []), (9006, rows[0][1]), (9006, rows[0][1]), (9007, [1e-30] * 24), (9008, [2.0, 1.0]), (9009, [2.0, 1.0]), (None, rows[0][1])]
    data = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rep string").repartition(4)
    got = {r.vec_id: r for r in neighbours.near_vectors(data, Tables(spark), 0.9).collect() if r.vec_id is not None}
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    good = {i: v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max() for i, v in good.items()}
    ids, parent, links = sorted(good), {i: i for i in got}, {i: 0 for i in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    missed = 0
    for a in ids:
        for b in ids:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    for i in got:
        missed += links[i] - got[i].n_links
        assert got[i].n_links <= links[i]
        assert got[i].kept == (got[i].component_id == i)
    assert missed <= 0.01 * sum(links.values())
    assert got[9001].n_links == got[9002].n_links == got[9003].n_links == got[9004].n_links == got[9005].n_links == 0
    assert got[9006].component_id == 0 and got[9008].component_id == got[9009].component_id == 9008
    assert neighbours.near_vectors(data.limit(0), Tables(spark)).count() == 0


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    center = rng.normal(size=16)
    rows = [(i, [float(v) for v in center + rng.normal(size=16) * 0.02]) for i in range(90)]
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    got = neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Tables(spark)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(89, 0)}


# --- url rules ---


def test_rules_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = ["example.org", "a.example.org", "myexample.org", "x.com", "COM", "org", "spam-farm.net", "casino-win.example.net", "de", "", "b.c.fr"]
    urls = [None, "", "no scheme", "http://", "ftp://x.org", "http://x.org/?a://b", "https://EXAMPLE.ORG/en/12#x"]
    urls += [f"{rng.choice(['http', 'HTTPS', 'x'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/es', '/en/1', '/en/123?x=/y', '/fr/a', '/de/', '#/de/'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = url_rules.host_path_rules(spark, queries.URL_RULES)
    for r in url_rules.judged(pages, rules).collect():
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path), u
        assert r.rule == (max(fits)[1] if fits else None), u
        own = any(re.search(p, host + path) for _, p, _ in url_rules.OWN_PATTERNS)
        assert r.verdict == (max(fits)[2] if fits else "block" if own else "allow"), u
    assert url_rules.judged(pages.limit(0), rules).count() == 0


def test_a_rule_is_filed_under_its_rarest_token(spark):
    tokens = spark.createDataFrame([("com",)] * 5 + [("example",)] * 2 + [("rare",)], "token string")
    tokens = tokens.unionByName(spark.createDataFrame([("ra*",)] * 3 + [("casino*",)], "token string"))
    rules = url_rules.host_path_rules(spark, [("block", "example.com", "/rare/"), ("block", "example.com", "/ra"), ("block", "x", ""), ("allow", "", "/")], [("casino", "casino[a-z]*[.]", True)])
    got = {r.name: r.token for r in url_rules.rule_index(rules, tokens).collect()}
    assert got == {"example.com/rare/": "rare", "example.com/ra": "example", "x": "x", "/": "", "casino": "casino*"}
    own = url_rules.host_path_rules(spark, queries.URL_RULES)
    assert own.count() == len(queries.URL_RULES) + len(url_rules.OWN_PATTERNS)
    assert url_rules.rule_index(own, tokens).where("token = ''").count() == 0


def test_odd_urls_and_clashing_names(spark):
    long = "http://a.org/" + "x/" * 200_000
    rows = [(None, long), (1, "http://poker-night.net/"), (1, "http://poker-night.net/"), (2, "http://a.b/casino."), (3, None), (3, "http://pokernight.example.org/es/")]
    pages = spark.createDataFrame([(i, u, "t", "n", "r", 1) for i, u in rows], "page_id long, url string, token string, name string, rule string, rank int")
    rules = url_rules.host_path_rules(spark, [*queries.URL_RULES, ("allow", "example.org", "/es/")])
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_rules.judged(pages, rules).collect()), key=str)
    assert got == [(1, None, "block"), (1, None, "block"), (2, None, "allow"), (3, "example.org/es/", "block"), (3, None, "allow"), (None, "org/", "allow")]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = queries.queries()[name](spark, sf)
    wanted = sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall(), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == wanted


# --- toxicity ---


def labelled(spark, n=1500):
    rng = random.Random(7)
    bad, words = ["idiot", "scum", "lowlifer"], ["plain%d" % i for i in range(200)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", "s", "ish"]))
        rows.append((i, " ".join(text), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int"), rows


def test_scores_separate_held_out_rows(spark):
    df, rows = labelled(spark)
    model = toxicity.fit(df.where("doc_id % 3 <> 0"))
    held = [r for r in rows if r[0] % 3 == 0]
    scores = model.scores(pa.array([r[1] for r in held]))
    y = np.array([r[2] for r in held])
    assert ((scores >= toxicity.THRESHOLD) == y).mean() > 0.97
    assert scores[y == 1].min() >= 0 and scores.max() <= 1
    assert abs(scores.mean() - y.mean()) < 0.05


def test_scores_of_odd_texts(spark):
    df, _ = labelled(spark, 200)
    model = toxicity.fit(df)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x" * 300_000, "c"), (4, "\n\t", "d"), (None, "IDIOT you 1d10t!!", "e")], "doc_id long, text string, score string")
    got = toxicity.scored(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(odd.limit(0), model).count() == 0
    same = toxicity.fit(df.withColumn("toxic", F.lit(0)))
    assert max(same.scores(pa.array(["a", "idiot"]))) < 0.1
    nothing = toxicity.fit(df.limit(0))
    assert len(nothing.scores(pa.array(["a", None]))) == 2


def test_features_see_capitals_signs_and_second_persons():
    lexicon = np.array([toxicity._word_hash("idiot")], np.uint64)
    x = toxicity.features(pa.array(["YOU idiot", "an 1d10t!!", "plain", ""]), (lexicon, lexicon))
    at = dict(zip(toxicity.FEATURES, x.T, strict=True))
    assert at["near_you"].tolist()[:2] == [0.5, 0.0]
    assert at["restored_density"][1] == 0.5 and at["lexicon_density"][0] == 0.5
    assert at["exclamations"][1] > 0 and at["capital_words"][0] == 0.5 and not x[3].any()


def brute_isotonic(x, y):
    """The least-squares non-decreasing fit at each distinct x, by maxima of minima of means."""
    at = sorted(set(x))
    group = [[b for a, b in zip(x, y, strict=True) if a == v] for v in at]
    mean = lambda i, j: sum(map(sum, group[i : j + 1])) / sum(map(len, group[i : j + 1]))
    return at, [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]


@pytest.mark.parametrize("ties", [False, True])
def test_isotonic_equals_the_best_monotone_fit(ties):
    rng = np.random.default_rng(0)
    x = rng.normal(size=60)
    x = np.round(x, 1) if ties else x
    y = (rng.random(60) < 1 / (1 + np.exp(-x))).astype(float)
    knots, values = toxicity.isotonic(x, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all() and (np.diff(values[::2]) > 0).all()
    at, fitted = brute_isotonic(x.tolist(), y.tolist())
    assert np.allclose(np.interp(at, knots, values), fitted, rtol=0, atol=1e-12)
    assert [len(v) for v in toxicity.isotonic(x[:0], y[:0])] == [0, 0]


def brute_features(text, words, strong):
    """FEATURES of one text, byte by byte; a word is in a lexicon if a beginning of a listed size or the whole of it is."""
    data = text.encode()
    letter = lambda b: 65 <= b < 91 or 97 <= b < 123 or b >= 128
    found = re.findall(rb"[0-9A-Za-z\x80-\xff@$]+", data)
    lower = lambda w: bytes(b + 32 if 65 <= b < 91 else b for b in w)
    restored = lambda w: bytes(ord(toxicity.STAND_INS.get(chr(b), chr(b))) if b < 128 else b for b in lower(w))
    listed = lambda w, names: any(w[:k] in names for k in toxicity.BEGINNINGS if len(w) >= k) or w in names
    you = [lower(w) in {v.encode() for v in toxicity.SECOND_PERSON.split()} for w in found]
    hit = [listed(lower(w), words) for w in found]
    sign = [any(chr(b) in toxicity.STAND_INS for b in w) and any(map(letter, w)) for w in found]
    again = [s and not h and listed(restored(w), words) for w, h, s in zip(found, hit, sign, strict=True)]
    either = [a or b for a, b in zip(hit, again, strict=True)]
    hard = [h and listed(lower(w), strong) for w, h in zip(found, hit, strict=True)]
    near = [e and any(you[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1][k] for k in range(len(you[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1])) if max(0, i - toxicity.NEAR) + k != i) for i, e in enumerate(either)]
    n, size, letters = max(1, len(found)), max(1, len(data)), max(1, sum(map(letter, data)))
    shout = [len(w) > 1 and sum(65 <= b < 91 for b in w) > 1 and not any(97 <= b < 123 for b in w) for w in found]
    triple = sum(a == b == c and letter(c) for a, b, c in zip(data, data[1:], data[2:], strict=False))
    sign_rate = sum(33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in data) / size
    return [
        np.log1p(len(found)), sum(either) / n, np.log1p(sum(either)), sum(hard) / n, np.log1p(sum(hard)), sum(again) / n, sum(near) / n, sum(you) / n,
        sum(65 <= b < 91 for b in data) / letters, sum(shout) / n, data.count(b"!") / size, data.count(b"?") / size, sign_rate,
        sum(48 <= b < 58 for b in data) / size, sum(sign) / n, triple / size, sum(map(len, found)) / n, sum(b >= 128 for b in data) / size,
    ]


def test_features_equal_brute_force():
    rng = random.Random(12)
    pieces = ["idiot", "IDIOT", "1d10t", "scum", "scumbag", "you", "Your", "dich", "tú", "plain", "ok", "WOW", "aaa", "é", "$cum", "7", "!!", "?", " ", "\n", ", ", "x-y"]
    texts = [rng.choice(["", " "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", "\n", "YOU you idiot", "漢字 " * 9]
    words, strong = {b"idi", b"scum", b"ok"}, {b"scum"}
    lexicons = tuple(np.sort(np.array([toxicity._word_hash(w.decode()) for w in part], np.uint64)) for part in (words, strong))
    got = toxicity.features(pa.array(texts), lexicons)
    wanted = np.array([brute_features(t, words, strong) for t in texts])
    for k, name in enumerate(toxicity.FEATURES):
        assert np.allclose(got[:, k], wanted[:, k]), name


def test_a_tree_splits_where_the_gain_is_largest():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (300, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (rng.random(300) < 0.1)).astype(float)
    trees = toxicity.Trees(x, y)
    p = y.mean()
    best = []
    for k in range(3):
        for cut in range(5):
            left = x[:, k] <= cut
            parts = [(np.sum(p - y[m]), m.sum() * p * (1 - p)) for m in (left, ~left)]
            whole = (sum(g for g, _ in parts), sum(h for _, h in parts))
            best.append((sum(g * g / (h + trees.RIDGE) for g, h in parts) - whole[0] ** 2 / (whole[1] + trees.RIDGE), k, cut))
    feature, cut = trees.trees[0][0][0]
    assert (int(feature[0]), trees.cuts[1][cut[0]]) == max(best)[1:]
    raw = trees.raw(x)
    assert ((raw > 0) == (x[:, 1] > 2)).mean() > 0.98


def test_labels_other_than_0_and_1_and_too_many_rows(spark):
    df, _ = labelled(spark, 300)
    odd = spark.createDataFrame([(-1, "idiot", 2), (-2, "idiot", None), (-3, None, 0)], "doc_id long, text string, toxic int")
    a, b = toxicity.fit(df.unionByName(odd)), toxicity.fit(df.unionByName(odd.where("toxic = 0")))
    probe = pa.array(["idiot", "plain1 plain2", None])
    assert a.scores(probe).tolist() == b.scores(probe).tolist()
    with pytest.raises(ValueError, match="training_rows"):
        toxicity.fit(df, rows=299)
    labels = df.select("doc_id", "toxic").unionByName(df.select("doc_id", F.lit(7).alias("toxic"))).unionByName(spark.createDataFrame([(None, 1)], "doc_id long, toxic int"))
    chosen = toxicity.training_rows(df.drop("toxic").unionByName(df.drop("toxic")), labels, F.lit(True), 100).collect()
    assert len(chosen) == 100 == len({r.doc_id for r in chosen}) and {r.toxic for r in chosen} == {0, 1}


# --- shards ---


def test_compaction_keeps_every_row_and_commits_versions(spark, monkeypatch):
    monkeypatch.setattr(shards, "WHOLE_EVERY", 4)
    store = shards.Store(spark, shared_folder(spark))
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"), F.lit(None).cast("string").alias("shard_note"))
    for k in range(6):
        store.append(rows.where(F.col("doc_id") % 6 == k).coalesce(2))
    assert store.version() == 6 and [r.files for r in store.manifest()] == [2] * 6
    before = store.manifest(6)
    done = store.compact(target=1 << 20, fanout=3)
    assert done > 6
    assert {r.level for r in store.manifest()} != {0} and len(store.manifest()) < 6
    got = sorted((r.doc_id, r.text) for r in store.read().collect())
    assert got == sorted((r.doc_id, r.text) for r in rows.collect())
    assert sorted(r.doc_id for r in store.read(6).collect()) == list(range(2000))
    assert store.manifest(6) == before and [len(store.manifest(v)) for v in range(7)] == list(range(7))
    with pytest.raises(shards.Conflict):
        store.commit(3, [], [])
    with pytest.raises(ValueError, match="columns"):
        store.append(rows.select("doc_id"))
    assert store.remove_dead() > 0
    assert store.read().count() == 2000 and store.remove_dead() == 0
    assert sum(r.rows for r in store.manifest()) == 2000


def test_tiers():
    s = lambda run, size: shards.Run(run, 1, size, 1, 0)
    assert shards.due_runs([s("a", 100), s("b", 110), s("c", 90)], 10_000, 4) == set()
    assert shards.due_runs([s("a", 100), s("b", 110), s("c", 90), s("d", 95), s("big", 9000)], 10_000, 4) == {"a", "b", "c", "d"}
    assert shards.due_runs([], 10, 4) == set()


def test_a_store_of_odd_rows(spark):
    store = shards.Store(spark, shared_folder(spark))
    assert store.version() == 0 and store.manifest() == [] and store.compact() == 0 and store.remove_dead() == 0
    with pytest.raises(ValueError, match="ever"):
        store.read()
    kind = "doc_id long, text string, shard string, _arrival0 int, `odd name` string"
    store.append_arrivals(spark.createDataFrame([], kind), F.col("doc_id"))
    assert store.version() == 1 and store.read().count() == 0
    assert store.read().columns == ["doc_id", "text", "shard", "_arrival0", "odd name", "_shard0"]
    odd = [(1, None, "s", 3, None), (1, None, "s", 3, None), (None, "", None, None, "x"), (2, "long " * 100_000, "t", 9, "y")]
    rows = spark.createDataFrame(odd, kind)
    assert store.append_arrivals(rows, F.col("doc_id")) == 4
    store.append(rows.limit(0))
    store.append(rows)
    store.compact(fanout=2)
    got = store.read().drop("_shard0").collect()
    assert sorted(map(tuple, got), key=str) == sorted(odd * 2, key=str)
    assert store.remove_dead() > 0 and store.read().count() == 8


def test_an_empty_documents_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_sharding(spark, str(tmp_path))
    assert got.count() == 0 and "shard" in got.columns


# --- queries and pipeline ---


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_cover_their_tables(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    n = got.count()
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    sizes = {"op4": documents, "op5": documents, "op7": documents, "op8": documents, "op1": documents, "op6": spark.read.parquet(f"{sf}/embeddings.parquet").count(), "op10": spark.read.parquet(f"{sf}/pages.parquet").count()}
    assert n == sizes.get(name.split("_")[0], n) and n > 0


def brute_stage(spark, sf, name, before, after, tmp_path):
    """Each stage on all that the one before kept, against a plain version of it."""
    rows, got = before.collect(), after.collect()
    by_id = {r.doc_id: r for r in got}
    if name == "toxicity":
        model = toxicity.fit(toxicity.training_rows(before, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True)))
        kept = model.scores(pa.array([r.text for r in rows])) < toxicity.THRESHOLD
        assert sorted(map(str, got)) == sorted(str(r) for r, k in zip(rows, kept, strict=True) if k)
    if name == "near_duplicates":
        groups = brute_components([(r.doc_id, r.text) for r in rows], corpus_pipeline.SHINGLE, *corpus_pipeline.SIMILARITY)
        assert sorted(by_id) == sorted(i for i, (n, c) in groups.items() if c == i)
    if name == "repeated_passages":
        later, _ = brute_repeats([(r.doc_id, r.text) for r in rows], corpus_pipeline.PASSAGE)
        cut = {}
        for i, k in later:
            cut.setdefault(i, set()).update(range(k, k + corpus_pipeline.PASSAGE))
        for r in rows:
            said = words_of(r.text)
            left = [w for k, w in enumerate(said) if k not in cut.get(r.doc_id, ())]
            assert (r.doc_id in by_id) == (bool(left) or not said)
            if r.doc_id in by_id:
                assert words_of(by_id[r.doc_id].text) == left and by_id[r.doc_id].n_chars == len(by_id[r.doc_id].text)
    if name == "mixing":
        import duckdb

        before.write.parquet(str(tmp_path / "kept"))
        sql = mixing.mixed_sql(f"'{tmp_path}/kept/*.parquet'", corpus_pipeline.LEVELS, corpus_pipeline.WEIGHTS, corpus_pipeline.SHARE, corpus_pipeline.EPOCHS, corpus_pipeline.SEED)
        assert sorted(by_id) == sorted(i for (i,) in duckdb.connect().execute(f"SELECT doc_id FROM ({sql})").fetchall())


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables, before = Tables(spark), docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = tables.put(stage(spark, before, sf), name)
        if name != "encoding":
            assert after.columns == docs.columns
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        brute_stage(spark, sf, name, before, after, tmp_path)
        seen.append(after.count())
        before = after
    assert before.where("not decodes").count() == 0
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0


def test_pipeline_of_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (3, "word " * 80, "en", "s", 400), (3, "word " * 80, "en", "s", 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = Tables(spark).put(stage(spark, docs, sf), "odd")
        kept[name] = sorted((r.doc_id for r in docs.collect()), key=str)
    assert docs.where("not decodes").count() == 0
    # Of the two equal rows one stays, and it stays whole but for the repeats inside it.
    assert kept["toxicity"] == [1, 2, 3, 3, None]
    assert kept["near_duplicates"] == kept["repeated_passages"] == [1, 2, 3, None]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
