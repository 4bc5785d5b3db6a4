"""Columns over reference lists and BibTeX."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import as_column, null_if_empty, strip

# Words of a title that its key skips.
SKIPPED_WORDS = ["a", "an", "the", "of", "in", "on", "for", "and", "to", "with", "by", "from", "at"]


def references_section(text: Column | str) -> Column:
    """What follows the heading of the list of references; null without one."""
    return null_if_empty(F.regexp_extract(as_column(text), r"(?is)(?:^|\n)[ \t#]*(?:references|bibliography)[ \t]*\n(.*)$", 1))


def year_of(reference: Column | str) -> Column:
    return null_if_empty(F.regexp_extract(as_column(reference), r"\(((?:19|20)\d\d)[a-z]?\)", 1)).try_cast("int")


def doi_of(reference: Column | str) -> Column:
    """The DOI without a full stop behind it."""
    return null_if_empty(F.regexp_replace(F.regexp_extract(as_column(reference), r"(?i)(?:doi:\s*|doi\.org/)(10\.\d{4,9}/[^\s,;]+)", 1), r"[.)]+$", ""))


def pages_of(reference: Column | str) -> Column:
    """The last range of pages."""
    text = F.regexp_replace(as_column(reference), r"(?i)doi.*$", "")
    return null_if_empty(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(r"(?:^|[^\d.])(\d+[-–]\d+)(?:\D|$)"), 1)), -1))


def title_of(reference: Column | str) -> Column:
    """The sentence behind the year."""
    return null_if_empty(strip(F.regexp_extract(as_column(reference), r"\((?:19|20)\d\d[a-z]?\)\.?\s*([^.?!]+[?!]?)", 1)))


def journal_of(reference: Column | str) -> Column:
    """What stands between the title's sentence and the volume."""
    return null_if_empty(strip(F.regexp_extract(as_column(reference), r"\((?:19|20)\d\d[a-z]?\)\.?\s*[^.?!]+[.?!]+\s*([^.,\d]+?),\s*\d", 1)))


def distinct_authors(names: Column) -> Column:
    """Names without repeats (in any case, the first spelling stays) and without a bare "and"."""
    clean = F.filter(F.transform(names, lambda n: strip(n)), lambda n: (n != "") & (F.lower(n) != "and"))
    return F.filter(clean, lambda n, i: F.array_position(F.transform(clean, lambda x: F.lower(x)), F.lower(n)) == i + 1)


def authors_of(reference: Column | str) -> Column:
    """Authors written "Surname, I." before the year."""
    before = F.regexp_replace(F.regexp_extract(as_column(reference), r"^(.*?)\((?:19|20)\d\d", 1), r"(?:\band\b|&)", ",")
    return distinct_authors(F.regexp_extract_all(before, F.lit(r"(\p{L}[\p{L}' -]*,\s*(?:\p{Lu}\.\s?-?)+)"), 1))


def parsed(reference: Column | str) -> Column:
    """struct<raw_text, title, authors, year, journal, pages, doi>."""
    r = as_column(reference)
    return F.struct(r.alias("raw_text"), title_of(r).alias("title"), authors_of(r).alias("authors"), year_of(r).alias("year"), journal_of(r).alias("journal"), pages_of(r).alias("pages"), doi_of(r).alias("doi"))


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def citation_key(authors: Column, year: Column | str, title: Column | str) -> Column:
    """Surname, year and first telling word of the title; "unknown" without authors."""
    first = F.try_element_at(authors, F.lit(1))
    surname = F.when(first.contains(","), F.substring_index(first, ",", 1)).otherwise(F.substring_index(strip(first), " ", -1))
    words = F.filter(F.transform(F.split(F.lower(as_column(title)), r"[^a-z0-9]+"), lambda w: _letters(w)), lambda w: (w != "") & ~w.isin(SKIPPED_WORDS))
    return F.concat(F.coalesce(null_if_empty(_letters(surname)), F.lit("unknown")), F.coalesce(as_column(year).cast("string"), F.lit("")), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")))


def bibtex_value(text: Column) -> Column:
    """A field's text on one line with % and & escaped."""
    return F.replace(F.replace(F.regexp_replace(strip(text), r"\s*[\r\n]+\s*", " "), F.lit("%"), F.lit("\\%")), F.lit("&"), F.lit("\\&"))


def bibtex(authors: Column, year: Column | str, title: Column | str, journal: Column | str, pages: Column | str, doi: Column | str) -> Column:
    """An entry: @article with a journal, else @misc; fields without a value are left out."""
    year, title, journal, pages, doi = map(as_column, (year, title, journal, pages, doi))
    names = F.when(F.size(authors) > 0, F.array_join(authors, " and "))
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"  {name} = {{"), bibtex_value(value), F.lit("}")))
    fields = F.concat_ws(",\n", field("author", names), field("title", title), field("year", year.cast("string")), field("journal", journal), field("pages", pages), field("doi", doi))
    kind = F.when(journal.isNotNull(), "@article{").otherwise("@misc{")
    return F.concat(kind, citation_key(authors, year, title), F.lit(",\n"), fields, F.lit("\n}"))


def numbered_keys(key: Column, ordinal: Column) -> Column:
    """A key made unique: the second of its kind ends in b, the third in c (ordinal from 1)."""
    return F.when(ordinal == 1, key).otherwise(F.concat(key, F.char(F.lit(96) + ordinal)))
