"""Registered corpus queries: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from .common import ship

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)

        REGISTRY[name] = (run, sql)
        return run
    return deco


def queries() -> dict[str, Callable]:
    from . import queries as _  # noqa: F401  (registration side effect)
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
