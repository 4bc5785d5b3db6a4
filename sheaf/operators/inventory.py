"""The status table: keyed upsert, selection and tallies by status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "ingested", "extracted", "failed", "error")


def upsert(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``, replacing the earlier ones whole (its nulls too).

    Partial maxima are taken before the shuffle, so a key with a third of all rows costs nothing more.
    Among rows equal in ``order`` the largest by their other columns stays; null keys are a key.
    """
    rest = [c for c in rows.columns if c != key]
    # Structs compare field by field; a null sorts before any value. Column positions keep clashing names apart.
    by = F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order)))
    last = rows.select(F.col(key), F.struct(by.alias("_by"), F.struct(*(F.col(c) for c in rest)).alias("_row")).alias("_last")).groupBy(key).agg(F.max("_last").alias("_last"))
    return last.select(key, *(F.col("_last._row").getField(c).alias(c) for c in rest))


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old table with the rows of the new one put in their place; of one key's new rows the largest stays."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    return upsert(both, key, [F.col("_turn")]).drop("_turn")


def clean_status(status: Column | str) -> Column:
    """A status in lower case without white space around it; null and blank are pending."""
    text = F.lower(F.trim(F.col(status) if isinstance(status, str) else status))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("pending"))


def with_status(table: DataFrame, status: str) -> DataFrame:
    return table.where(F.col("status") == status)


def status_counts(table: DataFrame) -> DataFrame:
    """(status, papers)."""
    return table.groupBy("status").agg(F.count("*").alias("papers"))


def tallies(table: DataFrame) -> DataFrame:
    """(done, failed) in one row."""
    return table.agg(F.count_if(F.col("status").isin("ingested", "extracted")).alias("done"), F.count_if(F.col("status").isin("failed", "error")).alias("failed"))


def with_errors(done: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows of both kinds in one table, absent columns null."""
    return done.unionByName(errors, allowMissingColumns=True)
