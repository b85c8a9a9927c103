"""Registration of queries, their SQL, and the SQL fragments that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def h(salt: str, key: str) -> str:
    """SQL of functions.hashing.keyed."""
    return f"CAST('0x' || substr(sha256('{salt}:' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"


def u(salt: str, key: str) -> str:
    """SQL of functions.hashing.unit."""
    return f"({h(salt, key)} / 1152921504606846976.0::DOUBLE)"


#: Lower-case tokens of a text, with runs of one repeated token left as they are.
TOKENS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+')"
