"""Queries of this subpackage over the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import encodings, leaks, pieces, quality, scans, tokens
from sheaf.session import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.oversized(table(spark, folder, "ingest_results"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split(table(spark, folder, "ingest_results"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return encodings.repairs(table(spark, folder, "ingest_results")).select("result_id", "line_no", "outcome")


def p5_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encodings.restored(table(spark, folder, "ingest_results"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.noisy_lines(table(spark, folder, "ingest_results"))


def p6_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scans.paragraphs(table(spark, folder, "ingest_results"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_texts(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "test_items"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.without_passages(table(spark, folder, "documents"), table(spark, folder, "test_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_prose(table(spark, folder, "documents"))


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.statistics(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_pieces, p5_found, p5_restored, p6_found, p6_paragraphs, p7_ids, p8_found, p8_clean, p9_found, p9_statistics)}
SQL = {
    "p4_found": r"""
        SELECT result_id,
               CASE WHEN list_max(list_transform(regexp_split_to_array(markdown, '[ \t\n\r\f]'), lambda x: length(x))) > 6000 THEN 'hard' ELSE 'natural' END AS cut
        FROM ingest_results WHERE length(markdown) > 6000
    """,
}
