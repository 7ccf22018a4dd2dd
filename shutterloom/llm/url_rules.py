"""URL filters: pattern rules indexed by their rarest literal token, in built-in functions only.

A rule is a regular expression over host and path, with the literal text that any match contains. Every rule is filed
under one token of its literal, the one that the fewest URLs hold; the last token of a literal that may go on inside a
longer one counts as a beginning, and URLs are looked up by the beginnings of their tokens of those lengths that rules
have. A URL's tokens fetch candidate rules, and only those run their expression. The longest rule that fits decides; else a pattern of the method's own list; else the URL is allowed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to this count are sent to every machine; more are joined by shuffling.
BROADCAST_RULES = 20_000
# Name parts of hosts, between dots or hyphens, that the method blocks by itself; those of the second list may go on.
BLOCKED_PARTS = [
    "adserver", "ads-track", "adult", "adware", "backdoor", "botnet", "carding", "cheap-pills", "cheap-viagra",
    "clickbait", "cracked-software", "doorway-pages", "escort-girls", "fake-news", "free-bets", "free-followers",
    "free-iphone", "hacked", "keylogger", "link-farm", "malware", "payday-loans", "phishing", "pill-store",
    "popunder", "porn", "ransomware", "rogue-antivirus", "sex-cams", "spam-farm", "spambot", "spyware",
    "stolen-cards", "trojan", "warez", "xxx",
]
BLOCKED_BEGINNINGS = [
    "bookmaker", "casino", "jackpot", "poker", "roulette", "slotmachine", "sportsbet", "tracker", "viagra",
    "webcamgirl",
]
#: As rules: the literal, the expression, and whether letters may follow the literal.
OWN_PATTERNS = [(part, rf"^([^/]*[.-])?{part}[.-]", False) for part in BLOCKED_PARTS] + [(part, rf"^([^/]*[.-])?{part}[a-z0-9-]*[.]", True) for part in BLOCKED_BEGINNINGS]
_RULES = "rank int, name string, verdict string, literal string, open_end boolean, pattern string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}" for c in text)


def host_path_rules(spark: SparkSession, rules: Iterable[tuple[str, str, str]], own: Iterable[tuple[str, str, bool]] = OWN_PATTERNS) -> DataFrame:
    """The rule table for (verdict, host, path) rules, which fit the host and its subdomains, and for own patterns as OWN_PATTERNS."""
    rows = []
    for verdict, host, path in rules:
        pattern = f"^([^/]*\\.)?{_quoted(host)}{_quoted(path) or '(/|$)'}"
        rows.append((1, host + path, verdict, host + path, bool(path) and not path.endswith("/"), pattern))
    rows += [(0, literal, "block", literal, goes_on, pattern) for literal, pattern, goes_on in own]
    return spark.createDataFrame(rows, _RULES)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null or no ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"))


def filed(rules: DataFrame) -> DataFrame:
    """(name, rank, token) of every token that a rule may be filed under; a beginning of a longer token ends with *."""
    tokens = rules.select("name", "rank", "open_end", F.translate("literal", _UPPER, _LOWER).alias("literal"))
    end = F.regexp_extract("literal", "([a-z0-9]+)$", 1)
    whole = F.when(F.col("open_end"), F.regexp_replace("literal", "[a-z0-9]+$", "")).otherwise(F.col("literal"))
    beginning = F.when(F.col("open_end") & (end != ""), F.array(F.concat(end, F.lit("*")))).otherwise(F.array().cast("array<string>"))
    return tokens.select("name", "rank", F.explode(F.concat(_tokens(whole), beginning)).alias("token")).where("token <> ''")


def url_tokens(text: Column, lengths: list[int]) -> Column:
    """The tokens of a URL, the empty one, and their beginnings of the given lengths, marked by *."""
    whole = _tokens(text)
    sizes = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    parts = F.flatten(F.transform(sizes, lambda n: F.transform(F.filter(whole, lambda t: F.length(t) >= n), lambda t: F.concat(F.substring(t, F.lit(1), n), F.lit("*")))))
    return F.array_distinct(F.concat(whole, parts, F.array(F.lit("")))) if lengths else F.array_distinct(F.concat(whole, F.array(F.lit(""))))


def rule_index(rules: DataFrame, tokens_of_urls: DataFrame) -> DataFrame:
    """`rules` with `token`, their rarest by the counts of `tokens_of_urls`; the empty token if a literal has none at all.

    The last token of a literal with an open end may be part of a longer one in a URL, so it counts as a beginning.
    """
    tokens = filed(rules)
    wanted = tokens.select("token").distinct()
    counts = tokens_of_urls.join(F.broadcast(wanted) if rules.count() <= BROADCAST_RULES else wanted, "token")
    counts = counts.groupBy("token").agg(F.count("*").alias("n"))
    rated = tokens.join(counts, "token", "left").select("name", "rank", "token", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = rated.groupBy("name", "rank").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return rules.join(rarest, ["name", "rank"], "left").withColumn("token", F.coalesce("token", F.lit("")))


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of `pages` (page_id, url).

    rule is the name of the rule that decided, null if none fits. A null url, or one without ://, has empty host and
    path, which no rule fits, and is allowed. Equal urls are judged once, and each row has its verdict, rows with null or
    repeated page_id too. Of rules with one name and rank, each counts as it is written. Urls count whole, however long.
    Other columns are not read, so their names cannot clash. An empty table gives an empty table.
    """
    sizes = [r.n for r in filed(rules).where("token like '%*'").select((F.length("token") - 1).alias("n")).distinct().collect()]
    urls = pages.select("url").where("url is not null").distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    tokens = urls.select("url", F.concat("host", "path").alias("target"), F.explode(url_tokens(F.concat("host", F.lit("/"), "path"), sorted(sizes))).alias("token"))
    index = rule_index(rules, tokens)
    if rules.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    fits = tokens.join(index, "token").where(F.expr("target rlike pattern"))
    best = fits.groupBy("url").agg(F.max_by(F.struct("name", "verdict", "rank"), F.struct("rank", F.length("name"), "name", "verdict")).alias("best"))
    out = pages.select("page_id", "url").join(best, "url", "left")
    return out.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.when(F.col("best.rank") == 1, F.col("best.name")).alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
    )


def host_path_sql(rules: Iterable[tuple[str, str, str]], own: Iterable[tuple[str, str, bool]] = OWN_PATTERNS) -> str:
    """The result of judged() over a table `pages` for host_path_rules(), in DuckDB's SQL."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({text(v)}, {text(h)}, {text(p)})" for v, h, p in rules)
    patterns = ", ".join(f"({text(p)})" for _, p, _ in own)
    return f"""
    WITH rules(verdict, host, path) AS (VALUES {rows}), own(pattern) AS (VALUES {patterns}),
    cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
        SELECT row_number() OVER () AS row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    fits AS (
        SELECT p.row, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS best FROM parts p
        JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.row),
    blocked AS (SELECT DISTINCT p.row FROM parts p JOIN own o ON regexp_matches(p.host || p.path, o.pattern))
    SELECT p.page_id, p.host, p.path, f.best.rule AS rule, coalesce(f.best.verdict, CASE WHEN b.row IS NULL THEN 'allow' ELSE 'block' END) AS verdict
    FROM parts p LEFT JOIN fits f ON f.row = p.row LEFT JOIN blocked b ON b.row = p.row"""
