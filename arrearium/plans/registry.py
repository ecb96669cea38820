"""Registered queries over the given tables, with their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Build, str | None]] = {}
_MODULES = ("queries_panel", "queries_scores", "queries_tables", "queries_builders", "queries_models", "queries_wide", "queries_factory")


def query(sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query under its function's name."""

    def register(build: Build) -> Build:
        _QUERIES[build.__name__] = (build, sql)
        return build

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines' sums compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def scaled_rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded as DuckDB does it: the double times a power of ten, to the nearest whole number, halves away from
    zero. Where a value's decimal form ends in a half, as 1.134375 at five digits, its product may lie just below it."""
    scale = float(10**digits)

    def nearest(c: str) -> Column:
        x = F.abs(F.col(c)) * scale  # with 52 bits before its point it is whole; NaN counts as larger than any number
        return F.when(x >= 2.0**52, F.col(c)).otherwise(F.signum(c) * F.floor(x + 0.5) / scale + 0.0)

    return df.select(*[nearest(c).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def _load() -> dict[str, tuple[Build, str | None]]:
    for m in _MODULES:
        importlib.import_module(f"arrearium.plans.{m}")
    return _QUERIES


def queries() -> dict[str, Build]:
    return {name: build for name, (build, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _load().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flow_rates"](spark, sf_dir)
