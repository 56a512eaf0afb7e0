"""Registration of queries with the SQL text they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspan.catalog.views import Views, oracle_with
from leadspan.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def now() -> Column:
    """The fixed time at which registered queries run."""
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register ``fn(views) -> DataFrame``; ``sql`` is its check, with the named input views put in front."""

    def wrap(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(prepare(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle_with(needs, sql)
        return fn

    return wrap
