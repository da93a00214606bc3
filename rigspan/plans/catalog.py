"""All queries over the driver's tables, by operator, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import eval_queries, feature_queries, log_queries, sample_queries, stream_queries
from .registry import ORACLE_SQL, QUERIES, Tables

__all__ = ["ORACLE_SQL", "QUERIES", "eval_queries", "feature_queries", "flagship", "sample_queries", "stream_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_queries.flagship(Tables(spark, sf_dir))
