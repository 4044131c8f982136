"""The queries of this library's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from varloom.cluster import ship_package
from varloom.sources.projections import view, with_views

_found: dict[str, tuple[Callable, str | None]] = {}
_MODULES = ("reads", "splits", "library", "clusters", "calls", "truth")


def query(*views: str, sql: str | None = None, also: tuple[str, ...] = (), **more: str) -> Callable:
    """Register a function of the projections ``views``; ``sql`` is its oracle over them, ``also`` and ``more``."""

    def register(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(*(view(spark, sf_dir, v) for v in views))

        _found[fn.__name__] = (run, with_views(tuple(dict.fromkeys((*views, *also))), sql, **more) if sql else None)
        return fn

    return register


def _load() -> dict[str, tuple[Callable, str | None]]:
    for module in _MODULES:
        import_module(f"varloom.plans.{module}")
    return _found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _load().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["sort_calls"](spark, sf_dir)
