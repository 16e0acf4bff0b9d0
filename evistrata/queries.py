"""The registered queries of the evidence operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evistrata.plans import q_more, q_other, q_ranking, q_scoring, q_stats, q_tables
from evistrata.plans.registry import QUERIES, SQL, Query

MODULES = (q_ranking, q_scoring, q_stats, q_tables, q_other, q_more)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["m33_composite_ranking"](spark, sf_dir)
