"""Queries by name, each with its SQL where SQL expresses it."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from tessera.storage import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan (spark, sf_dir) -> DataFrame and the SQL it is checked against."""

    def add(plan):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return add


def load_all(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: load(spark, sf_dir, n) for n in names}


for _module in ("relational", "scalar", "vectors", "graphs", "learning", "storage_plans"):
    importlib.import_module(f"tessera.plans.{_module}")
