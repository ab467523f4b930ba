"""Collects queries with the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of a table reader; ``t("orders")`` reads a table of the query's folder."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__, run.__name__ = f.__doc__, name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add
