"""Columns that cut a text into overlapping chunks, and selections of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import as_column


def check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk_size must be a positive integer")
    if overlap < 0 or overlap >= size:
        raise ValueError("overlap must be less than chunk_size")


def chunks(text: Column | str, size: int, overlap: int) -> Column:
    """array<struct<start, chunk>>: chunks of size characters, each after the first beginning with the last
    ``overlap`` characters of the one before. Null and empty texts have none."""
    check(size, overlap)
    text = as_column(text)
    starts = F.when(F.length(text) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(text) - overlap - 1, F.lit(size - overlap)))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("chunk")))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<struct<start:int,chunk:string>>"))


def break_point(text: Column | str, tail: float = 0.2) -> Column:
    """Characters up to behind the last sentence that ends in a text's last part; the whole length if none does."""
    text = as_column(text)
    # The last full stop and space; it counts if it lies in the tail.
    at = F.length(text) - F.instr(F.reverse(text), " .") + 1
    found = F.instr(F.reverse(text), " .") > 0
    return F.when(found & (at > F.length(text) * (1 - tail)), at).otherwise(F.length(text)).cast("int")


def sentence_chunks(text: Column | str, size: int, overlap: int) -> Column:
    """array<string>: chunks of at most size characters that end behind a sentence where one ends in their
    last fifth; each after the first begins with the last ``overlap`` characters of the one before.

    A fold over as many steps as there can be chunks, since each advances by 0.8 size - overlap at least.
    """
    check(size, overlap)
    text = as_column(text)
    least = max(1, int(size * 0.8) - overlap)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, F.lit(size))
        last = acc["at"] + size >= F.length(text)
        end = F.when(last, F.length(piece)).otherwise(F.greatest(break_point(piece), F.lit(overlap + 1)))
        # A finished fold stands behind the text.
        after = F.when(last, F.length(text) + size).otherwise(acc["at"] + end - overlap)
        return F.when(acc["at"] >= F.length(text), acc).otherwise(F.struct(after.cast("int").alias("at"), F.concat(acc["out"], F.array(F.substring(piece, F.lit(1), end))).alias("out")))

    steps = F.sequence(F.lit(0), F.floor(F.length(text) / least).cast("int") + 1)
    return F.when(F.length(text) > 0, F.aggregate(steps, state, step)["out"]).otherwise(F.array().cast("array<string>"))


def valid_pages(pages: Column | str, total: Column | int) -> Column:
    """struct<valid, invalid>: the pages within 0 .. total - 1 in order, and the others once each."""
    pages = as_column(pages)
    total = F.lit(total) if isinstance(total, int) else total
    valid = F.filter(pages, lambda p: (p >= 0) & (p < total))
    return F.struct(valid.alias("valid"), F.array_except(pages, valid).alias("invalid"))


def page_range(spec: Column | str) -> Column:
    """Pages (from 0) of a selection like "1-3,7" (from 1) in order; null if any part isn't a page or an
    ascending range, or there is none."""
    parts = F.transform(F.split(as_column(spec), ","), lambda p: F.trim(p))

    def read(p: Column) -> Column:
        first = F.regexp_extract(p, r"^(\d{1,6})(?:\s*-\s*(\d{1,6}))?$", 1).try_cast("int")
        last = F.coalesce(F.regexp_extract(p, r"^(\d{1,6})\s*-\s*(\d{1,6})$", 2).try_cast("int"), first)
        return F.when((first >= 1) & (last >= first), F.sequence(first - 1, last - 1))

    ranges = F.transform(parts, read)
    return F.when(F.forall(ranges, lambda r: r.isNotNull()), F.flatten(ranges))
