"""Columns over text: white space, truncation, readability, years and numbers in text.

All take a column or its name and keep null unless they say otherwise; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def null_if_empty(text: Column | str) -> Column:
    return F.nullif(as_column(text), F.lit(""))


def strip(text: Column | str) -> Column:
    """Without white space of any kind (Unicode) at either end."""
    return F.regexp_replace(as_column(text), r"(?U)^\s+|\s+$", "")


def left(text: Column | str, n: int) -> Column:
    """The first n characters."""
    return F.substring(as_column(text), 1, n)


def last_space(text: Column) -> Column:
    """Characters before the last space, -1 if there is none."""
    from_end = F.instr(F.reverse(text), " ")
    return F.when(from_end == 0, -1).otherwise(F.length(text) - from_end)


def is_unreadable(text: Column | str) -> Column:
    """Whether a text is shorter than 100 characters or more than a tenth of its first 1,000 are glyph
    codes, escapes, nulls or replacement characters. Null is unreadable."""
    text = as_column(text)
    sample = left(text, 1000)
    marks = F.lit(0)
    for mark in ("/G", "\\x", "\x00", "�"):
        # Occurrences don't overlap, so each one removed shortens the text by its length.
        marks = marks + (F.length(sample) - F.length(F.replace(sample, F.lit(mark), F.lit("")))) / len(mark)
    return F.coalesce((F.length(text) < 100) | (marks > F.length(sample) * 0.1), F.lit(True))


def truncate_words(text: Column | str, n: int = 50) -> Column:
    """At most n characters cut at a space in their second half, and dots; null gives an empty text."""
    text = as_column(text)
    cut = left(text, n)
    space = last_space(cut)
    short = F.when(space > n // 2, F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.coalesce(F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(short, r"(?U)\s+$", ""), F.lit("..."))), F.lit(""))


def template_truncate(text: Column | str, n: int, leeway: int = 5) -> Column:
    """As template engines truncate: texts up to n + leeway stay; others end in dots within n characters."""
    text = as_column(text)
    cut = left(text, n - 3)
    space = last_space(cut)
    return F.when(F.length(text) <= n + leeway, text).otherwise(F.concat(F.when(space >= 0, F.substring(cut, F.lit(1), space)).otherwise(cut), F.lit("...")))


def head_and_tail(text: Column | str, limit: int = 100_000, head: float = 0.7, between: str = "\n\n[...MIDDLE SECTION OMITTED DUE TO LENGTH...]\n\n") -> Column:
    """Texts over the limit become their first and last parts around a note."""
    text = as_column(text)
    first = int(limit * head)
    # Rounded down as the first part is, so that the parts add up to the limit or one less.
    last = int(limit * round(1 - head, 10))
    return F.when(F.length(text) > limit, F.concat(left(text, first), F.lit(between), F.right(text, F.lit(last)))).otherwise(text)


def clamp(text: Column | str, n: int = 200) -> Column:
    """Over n characters: the first n and dots."""
    text = as_column(text)
    return F.when(F.length(text) > n, F.concat(left(text, n), F.lit("..."))).otherwise(text)


def short_title(title: Column | str, n: int = 50) -> Column:
    """A title up to its first colon; over n characters, cut at their last space, and dots."""
    title = as_column(title)
    base = F.when(title.contains(":"), strip(F.substring_index(title, ":", 1))).otherwise(title)
    return F.when(F.length(base) > n, F.concat(F.regexp_replace(left(base, n), " [^ ]*$", ""), F.lit("..."))).otherwise(base)


def year_in(text: Column | str) -> Column:
    """The first year from 1980 to 2029 that stands by itself, as text; null if there is none."""
    return null_if_empty(F.regexp_extract(as_column(text), r"(?U)\b(19[89]\d|20[0-2]\d)\b", 1))


def first_number(text: Column | str) -> Column:
    """The first run of digits as a number; null if there is none or it is too large."""
    return null_if_empty(F.regexp_extract(as_column(text), r"\d+", 0)).try_cast("int")


def document_title(name: Column | str, markdown: Column | str) -> Column:
    """A document's name, else its first line if that is a heading."""
    line = F.substring_index(as_column(markdown), "\n", 1)
    return F.coalesce(null_if_empty(name), F.when(line.startswith("#"), strip(F.regexp_replace(line, "^#+", ""))))


def book_title(first_page: Column | str, stem: Column | str) -> Column:
    """The first line of a book's first page (100 characters), else the file's stem."""
    return F.coalesce(null_if_empty(strip(left(F.substring_index(as_column(first_page), "\n", 1), 100))), as_column(stem))


def words_per_minute(text: Column | str, pace: int = 250) -> Column:
    """Minutes to read a text, rounded up; words are runs of anything but ASCII white space."""
    return F.ceil(word_count(text) / pace).cast("int")


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(as_column(text), r"[ \t\n\r\f\x0b]+"), lambda w: w != ""))


def without_line_numbers(text: Column | str) -> Column:
    """A text without the numbers that working papers print before each line."""
    return F.regexp_replace(as_column(text), r"(?m)^[ \t]*\d{1,3}[ \t]+", "")
