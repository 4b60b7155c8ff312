"""Everything registered: importing the query modules fills the registry."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from meritgrid.plans import registry

QUERY_MODULES = ["scoring", "ranking", "matching", "merging", "text", "report", "source", "extract"]


def queries() -> dict[str, registry.QueryFn]:
    for module in QUERY_MODULES:
        importlib.import_module(f"meritgrid.plans.{module}_queries")
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return registry.oracle_sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["score_top_ten"](spark, sf_dir)
