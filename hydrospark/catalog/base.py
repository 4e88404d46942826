"""Registry of queries over the driver's tables and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hydrospark.catalog.fixtures import fx, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Fixture access bound to one session and one data folder: ``q.cells`` is ``fx_cells``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fx(self.spark, self.sf_dir, f"fx_{name}")


def query(name: str, fixtures: str = "", sql: str | None = None):
    """Register ``fn(q: Inputs)``; ``sql`` is the oracle body over the named fixtures."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_fixtures([f"fx_{f}" for f in fixtures.split()], sql) if fixtures else sql.strip()
        return fn
    return add


def r6(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Rounded double for comparison; adding zero removes a negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), digits) + F.lit(0.0)
    label = name or (c if isinstance(c, str) else None)
    return out.alias(label) if label else out
