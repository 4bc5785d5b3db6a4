"""Papers put in categories and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import settle

LAST = 99
UNCATEGORISED = "Uncategorized"


def assign(papers: DataFrame, assignments: DataFrame, categories: DataFrame) -> DataFrame:
    """papers with category, category_order and paper_order.

    assignments: paper_id, category, paper_order, ordinal (the last of a paper counts). categories: name,
    category_order (the first of a name counts). Missing values are "Uncategorized" and 99. Left joins on
    keys that are unique on the right, so no row is lost or doubled; the planner picks the strategy by size.
    """
    last = assignments.where("paper_id is not null").groupBy("paper_id").agg(F.max_by(F.struct("category", "paper_order"), "ordinal").alias("_a"))
    first = categories.where("name is not null").groupBy(F.col("name").alias("category")).agg(F.min("category_order").alias("_order"))
    named = papers.join(last, "paper_id", "left").withColumns({
        "category": F.coalesce("_a.category", F.lit(UNCATEGORISED)),
        "paper_order": F.coalesce("_a.paper_order", F.lit(LAST)),
    }).drop("_a")
    return named.join(first, "category", "left").withColumn("category_order", F.coalesce("_order", F.lit(LAST))).drop("_order")


def ordered(papers: DataFrame, tie: str) -> DataFrame:
    """By category and place in it; ``tie`` decides between equals. A range-partitioned sort."""
    return papers.orderBy("category_order", "paper_order", tie)


def _numbered(papers: DataFrame, order: list[str]) -> DataFrame:
    """papers with ordinal and _before (the category of the row before), over the whole table.

    A range-partitioned sort gives each row its place within its partition; where a partition begins, and
    the category before it, come from a row per partition, so no task holds more than its share.
    """
    place = papers.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = settle(place.withColumn("_part", F.shiftrightunsigned("_at", 33)))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.max_by(F.struct("category"), "_at").alias("_last"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as the sort has partitions.
    begins = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"), F.last("_last").over(before).alias("_held"))
    inside = Window.partitionBy("_part").orderBy("_at")
    joined = placed.join(F.broadcast(begins), "_part")
    previous = F.coalesce(F.lag(F.struct("category")).over(inside), F.col("_held"))["category"]
    return joined.withColumns({"ordinal": (F.col("_begin") + F.row_number().over(inside)).cast("int"), "_before": previous}).drop("_at", "_part", "_begin", "_held")


def headings(papers: DataFrame, tie: str, group: str | None = None) -> DataFrame:
    """papers with starts_category (its category differs from the row before) and banded (odd rows).

    Position and predecessor come from one window within each ``group`` (a report among many in one
    table); without a group from a sort over the whole table.
    """
    order = ["category_order", "paper_order", tie]
    if group is None:
        numbered = _numbered(papers, order)
    else:
        over = Window.partitionBy(group).orderBy(*order)
        numbered = papers.withColumns({"ordinal": F.row_number().over(over), "_before": F.lag("category").over(over)})
    starts = F.col("category").isNotNull() & ~F.col("category").eqNullSafe(F.col("_before"))
    return numbered.withColumns({"starts_category": starts, "banded": F.col("ordinal") % 2 == 1}).drop("_before")
