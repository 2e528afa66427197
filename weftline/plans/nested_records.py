"""Queries of problem 2: the raw catalogue lines as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.operators.nested import flatten_records, table_fields
from weftline.runtime import table

FIELDS = ("features", "categories", "details")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object that is an array's element, with its Dewey path and its parent's."""
    nodes = flatten_records(table(spark, sf_dir, "catalog_raw"), "line_no", "raw_line", FIELDS, scalars=False)
    return nodes.select(F.col("record").alias("line_no"), "node_path", "parent_path")


def p2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables themselves, told apart by ``schema_path``; each row has its scalar fields and the link to its parent.

    They hold all that the fields do: besides array elements, objects alone under a key and scalars outside of objects.
    """
    nodes = flatten_records(table(spark, sf_dir, "catalog_raw"), "line_no", "raw_line", FIELDS, whole=True)
    return nodes.withColumnRenamed("record", "line_no")


def p2_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that the lines make up, with their columns."""
    return table_fields(flatten_records(table(spark, sf_dir, "catalog_raw"), "line_no", "raw_line", FIELDS, whole=True))


QUERIES = {"p2_found": p2_found, "p2_tables": p2_tables, "p2_fields": p2_fields}
SQL: dict[str, str] = {}
