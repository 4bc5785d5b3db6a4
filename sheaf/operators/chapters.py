"""Chapters of books: found in outlines or by headings of pages, with their pages and texts.

pages: book_id, page_no (from 1), text. outlines: book_id, position, level, title, page_no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import left, null_if_empty, strip

# A heading at the start of a page, and titles that are none.
NUMBER_LINE = r"\A(\d+)\s*\n\s*([A-Z][A-Za-z\s,':]+)"
CHAPTER_LINE = r"\A(?:Chapter|CHAPTER)\s+(\d+)[:.\s]+([^\n]+)"
EXCLUDED = [r"topics?\s+for", r"^part\s+", r"selected\s+topics?", r"advanced\s+topics?", r"complementary\s+and\s+alternative"]


def heading(text: Column | str) -> Column:
    """The title of a page that begins with a chapter's heading, else null."""
    begin = strip(left(text, 300))
    by_number, by_word = (null_if_empty(F.regexp_extract(begin, p, 2)) for p in (NUMBER_LINE, CHAPTER_LINE))
    title = F.coalesce(by_number, by_word)
    return left(F.substring_index(strip(title), "\n", 1), 80)


def is_excluded(title: Column | str) -> Column:
    title = F.col(title) if isinstance(title, str) else title
    return title.rlike("(?i)" + "|".join(EXCLUDED))


def _spans(starts: DataFrame, totals: DataFrame, order: list[str]) -> DataFrame:
    """Chapters numbered from 1, each ending before the next begins, the last with the book."""
    book = Window.partitionBy("book_id").orderBy(*order)
    numbered = starts.withColumns({"number": F.row_number().over(book), "_next": F.lead("start_page").over(book)})
    return numbered.join(totals, "book_id").select("book_id", "number", "title", "start_page", F.coalesce(F.col("_next") - 1, F.col("total")).cast("int").alias("end_page"))


def page_totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book_id").agg(F.max("page_no").cast("int").alias("total"))


def from_text(pages: DataFrame) -> DataFrame:
    """book_id, number, title, start_page, end_page by the pages' headings."""
    starts = pages.select("book_id", F.col("page_no").cast("int").alias("start_page"), heading("text").alias("title")).where(F.col("title").isNotNull() & ~is_excluded("title"))
    return _spans(starts, page_totals(pages), ["start_page"])


def from_outline(outlines: DataFrame, totals: DataFrame) -> DataFrame:
    """The same by the top level of the books' outlines; entries without a page are left out."""
    starts = outlines.where("level = 0 and page_no is not null").select("book_id", "position", F.col("page_no").cast("int").alias("start_page"), strip("title").alias("title"))
    return _spans(starts, totals, ["position"])


def detect(pages: DataFrame, outlines: DataFrame | None = None) -> DataFrame:
    """Chapters of each book: its outline's, else by headings, else the whole book as one; with page_count."""
    totals = page_totals(pages)
    by_text = from_text(pages).withColumn("_way", F.lit(2))
    whole = totals.select("book_id", F.lit(1).alias("number"), F.lit("Full Book").alias("title"), F.lit(1).alias("start_page"), F.col("total").alias("end_page"), F.lit(3).alias("_way"))
    ways = by_text.unionByName(whole)
    if outlines is not None:
        ways = ways.unionByName(from_outline(outlines, totals).withColumn("_way", F.lit(1)))
    best = F.min("_way").over(Window.partitionBy("book_id"))
    chosen = ways.withColumn("_best", best).where("_way = _best").drop("_way", "_best")
    return chosen.withColumn("page_count", F.col("end_page") - F.col("start_page") + 1)


def texts(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_id, number, title, text: the chapters' pages in order with a blank line between, absent text empty.

    Each page belongs to the last chapter that begins at or before it: an equi-join on book and page with
    the chapters' pages instead of a join on ranges. A book whose chapters overlap gives a page to each.
    """
    covered = chapters.where("end_page >= start_page").select("book_id", "number", "title", F.explode(F.sequence("start_page", "end_page")).alias("page_no"))
    joined = covered.join(pages.select("book_id", F.col("page_no").cast("int").alias("page_no"), "text"), ["book_id", "page_no"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("t")))), lambda p: p["t"])
    return joined.groupBy("book_id", "number", "title").agg(F.array_join(ordered, "\n\n").alias("text"))


def with_summaries(chapters: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chapters beside summaries by position in the book, as many as the shorter list has.

    chapters: book_id, number, ...; summaries: book_id, summary_no, ...
    """
    left_side = chapters.withColumn("position", F.row_number().over(Window.partitionBy("book_id").orderBy("number")))
    right_side = summaries.withColumn("position", F.row_number().over(Window.partitionBy("book_id").orderBy("summary_no")))
    return left_side.join(right_side, ["book_id", "position"])


def previous_context(summaries: DataFrame) -> DataFrame:
    """summaries with context: what the chapters before say, up to five key terms each.

    summaries: book_id, chapter_num, main_thesis, key_terms array<string>.
    """
    before = Window.partitionBy("book_id").orderBy("chapter_num").rowsBetween(Window.unboundedPreceding, -1)
    terms = F.when(F.size("key_terms") > 0, F.concat(F.lit("\n    Key terms: "), F.array_join(F.slice("key_terms", 1, 5), ", "))).otherwise(F.lit(""))
    line = F.concat(F.lit("  Ch "), F.col("chapter_num").cast("string"), F.lit(": "), F.coalesce("main_thesis", F.lit("")), terms)
    lines = F.collect_list(line).over(before)
    text = F.when(F.size(lines) > 0, F.concat(F.lit("PREVIOUS CHAPTERS (for context):\n"), F.array_join(lines, "\n"))).otherwise(F.lit("PREVIOUS CHAPTERS: This is the first chapter."))
    return summaries.withColumn("context", text)
