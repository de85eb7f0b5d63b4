"""All queries over the test tables, and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, distributed, ledgers, metrics, mixture, packs, streams, texts

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (texts, corpus, mixture, packs, metrics, distributed, ledgers, streams)


def queries() -> dict[str, Query]:
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
