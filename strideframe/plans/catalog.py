"""All queries over the movement operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from strideframe.functions.tables import share_package
from strideframe.plans import body, files, machines, routes, steps, streams

Query = Callable[[SparkSession, str], DataFrame]


def _shared(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        share_package(spark)
        return query(spark, sf_dir)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body.com_speed(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: _shared(q) for name, q in (body.QUERIES | steps.QUERIES | routes.QUERIES | files.QUERIES | streams.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return body.SQL | steps.SQL | routes.SQL | machines.SQL | files.SQL | streams.SQL
