"""Adjacent boxes on a line merged into one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(spans: DataFrame, line: list[str], gap: float) -> DataFrame:
    """(line columns, island, x0, x1, y0, y1, text, spans): spans of a line no more than gap apart become one.

    spans: the line columns, x0, y0, x1, y1, text. A span joins the island if it begins within gap of the
    farthest end so far, so spans inside others don't split it.
    """
    order = Window.partitionBy(*line).orderBy("x0", "x1", "y0", "y1", "text")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("_new", F.when(reach.isNull() | (F.col("x0") > reach + gap), 1).otherwise(0))
    islands = starts.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"])
    return islands.groupBy(*line, "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.array_join(words, "").alias("text"), F.count("*").alias("spans"))
