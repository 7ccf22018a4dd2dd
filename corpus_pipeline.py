"""Documents to training tokens: toxic documents go, one document of each near-duplicate group stays, repeated passages
are cut, sources are mixed to target weights, and texts are encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.llm import bpe, mixing, parity_join, suffixes, toxicity
from shutterloom.llm.shared import Tables, one_of_each, sent_if_small, table

#: The near-duplicate stage takes shingles of five words and a similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, (4, 5)
#: Words of the shortest passage that is cut where it repeats.
PASSAGE = 50
#: The mix: languages by weight, their sources evenly, so many of all tokens, each document at most once.
LEVELS = ["lang", "source"]
WEIGHTS = {("en",): 5.0, ("de",): 2.0, ("fr",): 2.0, ("es",): 2.0}
SHARE, EPOCHS, SEED = 0.9, 1, 7


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score reaches the threshold; the scorer is fitted on the labelled documents.

    Null and empty texts have a score and mostly stay; rows that repeat have one score; without labels nothing tells texts
    apart. Columns may have any names. An empty table stays empty."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.training_rows(docs, labels, F.lit(True)))
    return toxicity.scored(docs, model, "_score").where(F.col("_score") < toxicity.THRESHOLD).drop("_score")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group the document with the smallest id, and of rows with equal id and text one; documents without id
    or words are not in groups. An empty table stays empty."""
    tables = Tables(spark)
    docs = one_of_each(docs, tables)
    groups = parity_join.parity_join(docs, tables, SHINGLE, *SIMILARITY)
    gone = tables.put(groups.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(sent_if_small(gone), "doc_id", "left_anti").select(*docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage that an earlier document, or an earlier place of the same one, has too.

    Null and empty texts and rows without id stay as they are; a text of which nothing is left goes; of rows with equal
    id and text one stays. Ids are numbers. Columns may have any names. An empty table stays empty."""
    return suffixes.without_repeats(docs, suffixes.repeats(docs, Tables(spark), PASSAGE), PASSAGE)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Choose documents so that languages and sources come near their weights.

    A null language or source is a branch like any other, of weight 1; null and empty texts have no tokens; rows that
    share an id stand or fall together. Columns may have any names. An empty table stays empty."""
    return mixing.mixed_to_weights(docs, LEVELS, WEIGHTS, None, SHARE, EPOCHS, SEED).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it.

    Null and empty texts have no ids; every row is encoded, repeated ones too. Columns named as the added ones are
    replaced. An empty table stays empty."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = docs.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    out = bpe.with_tokens(rows, ranks, public_tokenizers.PATTERN, lambda ids, replay: (len(ids), ids, bpe.digests(ids, replay)[2]), "n_tokens long, token_ids array<int>, decoded_sha256 string")
    return out.withColumn("decodes", F.col("decoded_sha256") == F.col("_digest")).drop("_digest", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: Trees, similarity joins and merges are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    tables = Tables(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
