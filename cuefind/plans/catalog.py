"""Imports every query module so the registry is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuefind.plans import (backfill_queries, cache_queries, chunk_queries, ingest_queries,  # noqa: F401
                           search_queries, source_queries)
from cuefind.plans.registry import ORACLE, QUERIES

FLAGSHIP = "hybrid_best"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[FLAGSHIP](spark, sf_dir)


__all__ = ["QUERIES", "ORACLE", "flagship", "FLAGSHIP"]
