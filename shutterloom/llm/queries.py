"""One query per corpus operator, over whole tables, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chunks, divergence, fingerprints, mixing, neighbours, parity_join, periodic, shards, suffixes, toxicity, url_rules
from .shared import Tables, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def _held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


#: Arrivals that the documents come in, and bytes of a merged file.
ARRIVALS, SHARD_BYTES = 16, 32 << 20
#: Weights of the mix: half the tokens from the bulk source, languages and the other sources as given.
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {("bulk",): 1.0, ("curated",): 1.0, (None, "en"): 4.0, (None, "de"): 2.0, (None, "fr"): 2.0, (None, "es"): 2.0}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.9, 2, 7
#: A word: a stretch of characters other than blank and \\x09-\\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of documents per shuffle partition.
RANGES = 8
#: The url rules: verdict, host, path.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def with_domain(docs: DataFrame) -> DataFrame:
    return docs.withColumn("domain", F.when(F.col("source") == "src0", "bulk").otherwise("curated"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended in arrivals, compacted, and read back: each row with the shard that holds it now."""
    docs = table(spark, sf_dir, "documents")
    store = shards.Store(spark, shared_folder(spark))
    store.append_arrivals(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    store.compact(SHARD_BYTES)
    store.remove_dead()
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return store.read().select("doc_id", "lang", "source", "n_chars", digest.alias("text_sha256"), "shard")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    return mixing.mixed_to_weights(docs, MIX_LEVELS, MIX_WEIGHTS, None, MIX_SHARE, MIX_EPOCHS, MIX_SEED).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{chat.END}{chat.START}assistant ok"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.chat_windows(turns.unionByName(planted)))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Ranges are dealt to partitions by hash, so several go to each for even sizes.
    return fingerprints.edited_and_next(docs, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Tables(spark))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules.host_path_rules(spark, URL_RULES))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.training_rows(docs, labels, ~_held_out()))
    rows = toxicity.scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return parity_join.parity_join(docs, Tables(spark), q=4, num=85, den=100)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_tokens(docs, ranks, public_tokenizers.PATTERN, bpe.digests, bpe.DIGESTS)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.repeated_spans(suffixes.repeats(docs, Tables(spark)))


def op11_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    return chunks.exact_copies(docs, Tables(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents whose id's crc32 is a multiple of ten say the words from one place on over and over; null ids are left alone."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    n, g = F.size("words"), F.floor(h / 10)
    a = (g % n).cast("int")
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("period"))))
    planted = docs.withColumn("words", F.when(h % 10 == 0, words)).withColumn("a", F.when(n > 0, a)).withColumn("period", F.when(n > 0, period))
    return planted.withColumn("text", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text"))).drop("words", "a", "period")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))

    def higher_power(x: Column, y: Column) -> Column:
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(left > right, -1).when(left < right, 1).otherwise(F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(F.signum(x["period"] - y["period"]).cast("int")))

    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.get(F.array_sort("runs", higher_power), F.lit(0))
    told = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), told.alias("told"), best.alias("best"), "collapsed").select(
        "doc_id", "n_runs", *[F.col("best")[c].alias(c) for c in ("start", "length", "period")], F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.col("told").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"), Tables(spark))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_sharding, op2_mixing, op3_chat_format, op4_fingerprints, op5_toxicity, op6_near_vectors, op7_parity_join, op8_byte_bpe, op9_suffix_dedup, op10_url_rules, op11_chunk_recipes, op12_periodic_runs, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    docs = "(SELECT *, CASE WHEN source = 'src0' THEN 'bulk' ELSE 'curated' END AS domain FROM documents)"
    planted = " UNION ALL ".join(f"SELECT -1, {k}, '{role}', '{chat.END}{chat.START}assistant ok'" for k, role in enumerate(("user", "assistant")))
    return {
        "op2_mixing": mixing.mixed_sql(docs, MIX_LEVELS, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED),
        "op3_chat_format": chat.read_back_sql(f"(SELECT conv_id, turn, role, text FROM conversations UNION ALL {planted})"),
        "op10_url_rules": url_rules.host_path_sql(URL_RULES),
        "op11_chunk_recipes": chunks.exact_copies_sql(),
        "op13_source_divergence": divergence.audit_sql(),
    }
