"""Every registered query with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.driver import Domain
from . import docs, extras, pages, runs, search, sinks, staging, tables
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "docs", "extras", "flagship", "pages", "runs", "sinks", "staging", "tables"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.flagship(Domain(spark, sf_dir))
