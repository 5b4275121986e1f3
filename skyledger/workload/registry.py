"""The register of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import twin

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query; ``sql`` with the views it uses is its twin."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = twin(views, sql)
        return fn

    return wrap


def rnd(col: Column | str, digits: int = 6) -> Column:
    """Round for comparison and drop negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits) + F.lit(0.0)


def rnd_scaled(col: Column | str, digits: int) -> Column:
    """Round as the SQL side does: the scaled double to a whole number. ``rnd`` rounds the shortest decimal form, which differs near ties."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c * 10.0**digits) / 10.0**digits + F.lit(0.0)


def big(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")
