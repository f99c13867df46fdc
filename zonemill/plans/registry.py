"""Registry of queries: name → (Spark plan, SQL over the same tables)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonemill.functions.numbers import half_up

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}
MODULES = ("scalars", "tables", "pixels", "geometry", "grids", "sources", "quality")


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: present(plan(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return plan
    return register


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Presentation rounding, once, at the very end: operators return unrounded doubles."""
    return df.select([
        half_up(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"zonemill.plans.{module}")
