"""Queries of problem 4: quantities and prices in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.operators import units
from weftline.runtime import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What details and price of each listing state, in common units."""
    return units.stated_amounts(*(table(spark, sf_dir, t) for t in ("catalog_items", "stores", "currency_rates")))


def p4_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure and price with the unit or currency assigned to it, its confidence, and those left for review."""
    return units.assign_units(table(spark, sf_dir, "catalog_items"), table(spark, sf_dir, "stores"), rates=table(spark, sf_dir, "currency_rates"))


QUERIES = {"p4_found": p4_found, "p4_units": p4_units}
SQL: dict[str, str] = {}
