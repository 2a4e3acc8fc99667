"""Queries by name, and SQL of the checking engine for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadlens.plans.dialect import CHECK, SPARK
from threadlens.plans.operator_queries import OPERATOR_QUERIES, OPERATOR_SQL
from threadlens.plans.queries import SQL_QUERIES
from threadlens.sources.tables import register


def _run(query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables, sql = query(SPARK)
        register(spark, sf_dir, tables)
        return spark.sql(sql)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _run(q) for n, q in SQL_QUERIES.items()} | OPERATOR_QUERIES
ORACLE_SQL: dict[str, str] = {n: q(CHECK)[1] for n, q in SQL_QUERIES.items()} | OPERATOR_SQL
