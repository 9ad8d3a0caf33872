"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.driver import DOMAIN_SQL, Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, domain: bool = False):
    """Register a function of a Domain; ``domain`` puts the domain relations before the SQL."""

    def register(build: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Domain(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = (f"WITH {DOMAIN_SQL} {sql}" if not sql.lstrip().startswith(",") else f"WITH {DOMAIN_SQL}{sql}") if domain else sql
        return build

    return register
