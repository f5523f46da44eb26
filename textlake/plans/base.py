"""Registry of named queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textlake.session import spread

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query, with the SQL over the source tables that must give the same rows."""
    def add(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return add


# tables whose queries do heavy work per row
_HEAVY = {"documents": "doc_id", "orders": "o_orderkey", "customer": "c_custkey", "lineitem": "l_orderkey",
          "conversations": "conv_id", "pages": "page_id", "part": "p_partkey", "events": "event_id"}


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; ``heavy`` uses every core even when the file is one split."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, _HEAVY[name]) if heavy else df


def view(spark: SparkSession, sf_dir: str, sql: str, *names: str, heavy: bool = False) -> DataFrame:
    """Run a fixture SQL text whose tables are written ``{name}``."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n, heavy) for n in names})
