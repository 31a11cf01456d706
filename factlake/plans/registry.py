"""The register of queries: a name, a function of the views, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factlake.plans.views import View, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function of a ``View`` under its own name; ``sql`` may use ``views``."""

    def wrap(f: Callable[[View], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(View(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views)
        return f

    return wrap


def load() -> None:
    """Imports the modules that register queries."""
    from factlake.plans import answering, checks, history, retrieval, scoring, text  # noqa: F401
