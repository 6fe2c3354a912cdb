"""Query name -> (Spark callable, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightmill.sources.views import Views, with_views

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, views: str = "", sql: str | None = None) -> Callable:
    """Registers a function of `Views` as a query; `sql` may use the named views as tables."""

    def register(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        CATALOG[name] = (lambda spark, folder: build(Views(spark, folder)), sql and with_views(views, sql))
        return build

    return register
