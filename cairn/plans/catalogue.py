"""All queries of the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.plans import cluster_queries, drifting, fit_queries, keyed, matrix_queries

_MODULES = (keyed, drifting, cluster_queries, matrix_queries, fit_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)
