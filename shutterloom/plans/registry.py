"""The list of queries. A query reads tables through `inputs`, in SQL that both engines accept, and applies operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def inputs(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the tables of `sf_dir`; only tables that `sql` names are opened."""
    for name in TABLES:
        if name in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def query(name: str, source: str, oracle: str | None = None) -> Callable:
    """Register f(DataFrame) -> DataFrame under `name`, fed by `source`; in `oracle`, {source} stands for the same rows."""

    def wrap(f: Callable[[DataFrame], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(inputs(spark, sf_dir, source))
        if oracle is not None:
            ORACLES[name] = oracle.replace("{source}", f"({source})")
        return f

    return wrap


def query_of(name: str, sources: dict[str, str], oracle: str | None = None) -> Callable:
    """As query(), for f(**frames) with several inputs; {name} in `oracle` stands for each."""

    def wrap(f: Callable[..., DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(**{k: inputs(spark, sf_dir, s) for k, s in sources.items()})
        if oracle is not None:
            text = oracle
            for k, s in sources.items():
                text = text.replace("{" + k + "}", f"({s})")
            ORACLES[name] = text
        return f

    return wrap
