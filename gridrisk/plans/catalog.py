"""Registered queries: one Spark plan and, where SQL can say it, its DuckDB oracle.

Each query reads the driver's tables through ``bindings`` and runs the
library's operators on the whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY: dict[str, tuple[Callable, str | None]] = {}

DIGITS = 6


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round floating columns so both engines hash the same text despite
    different summation orders."""
    dbl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in dbl else F.col(f"`{c}`")
                       for c in df.columns])


def queries() -> dict[str, Callable]:
    from . import queries_core, queries_explain, queries_model, queries_scale  # noqa: F401  (registration side effect)
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
