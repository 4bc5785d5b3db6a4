"""Queries of the general operators for training data: drifting schemas, nested records, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import drift, nested, units
from sheaf.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.field_changes(table(spark, folder, "matrix_files"))


def declared(spark: SparkSession, folder: str) -> dict[str, str]:
    """Type of every declared key; each is a column of the unified table, so they fit the driver as its schema does."""
    keys = table(spark, folder, "schema_spec").groupBy("key").agg(F.min("type").alias("type")).collect()
    return {r["key"]: r["type"] for r in keys}


def p1_table(spark: SparkSession, folder: str) -> DataFrame:
    return drift.unified_table(table(spark, folder, "matrix_files"), declared(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.links(table(spark, folder, "book_inventory"))


def p2_chapters(spark: SparkSession, folder: str) -> DataFrame:
    return nested.chapters(nested.label_nodes(table(spark, folder, "book_inventory")))


def p2_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return nested.summaries(nested.label_nodes(table(spark, folder, "book_inventory")))


def p2_key_terms(spark: SparkSession, folder: str) -> DataFrame:
    return nested.key_terms(nested.label_nodes(table(spark, folder, "book_inventory")))


def p2_key_themes(spark: SparkSession, folder: str) -> DataFrame:
    return nested.key_themes(nested.label_nodes(table(spark, folder, "book_inventory")))


def p2_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return nested.label_nodes(table(spark, folder, "book_inventory"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return units.restated(table(spark, folder, "matrix"), table(spark, folder, "schema_spec"))


def p3_amounts(spark: SparkSession, folder: str) -> DataFrame:
    return units.amounts(table(spark, folder, "matrix"), table(spark, folder, "schema_spec"))


QUERIES = {f.__name__: f for f in (p1_found, p1_table, p2_found, p2_chapters, p2_summaries, p2_key_terms, p2_key_themes, p2_nodes, p3_found, p3_amounts)}
SQL: dict[str, str] = {}
