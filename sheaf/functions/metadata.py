"""Title, authors and year from the first lines of a document, as column expressions.

A fold over the first lines keeps what is found so far; no Python runs per row. Null gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import as_column, null_if_empty, strip, year_in

# Fixed values, in the order in which they are tried.
FIRST_NAMES = ["Joshua", "David", "Victor", "Alan", "Michael", "John", "Robert", "James", "William", "Richard", "Esther", "Amy", "Janet", "Susan", "Rebecca"]
SERIES_HEADERS = ["NBER WORKING PAPER SERIES", "Working Paper No", "NATIONAL BUREAU"]
NOT_TITLES = ["NBER WORKING PAPER SERIES", "JEL No", "Labor Studies", "ABSTRACT", "Department of", "National Bureau", "This paper", "We study", "We examine"]
APPENDED = [" NBER Working Paper", " Working Paper No", " NBER "]
AUTHOR_MARKS = [*(f" {n} " for n in FIRST_NAMES), " by ", " By "]
LINES = 15
AUTHOR_LINES = 4

_STATE = "struct<done:boolean,title:string,authors:string,year:string>"


def _first_lines(content: Column, n: int) -> Column:
    # Only the beginning is cut out and split, however long the text is.
    begin = F.substring_index(F.regexp_replace(content, r"(?U)\A\s+", ""), "\n", n)
    return F.transform(F.split(begin, "\n"), lambda x: strip(x))


def _with(value: Column, use) -> Column:
    """use(value) with the value computed once: a function's body is evaluated for each element otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _contains_any(line: Column, phrases: list[str]) -> Column:
    low = F.lower(line)
    found = F.lit(False)
    for phrase in phrases:
        found = found | low.contains(phrase.lower())
    return found


def _before(line: Column, phrase: str) -> Column:
    """What stands before a phrase, in any case."""
    return strip(F.substring(line, F.lit(1), F.instr(F.lower(line), phrase.lower()) - 1))


def leading_metadata(content: Column | str) -> Column:
    """struct<title, authors, year> by two layouts: one line of title, authors and series; or a heading
    with an author line below."""
    known = _first_lines(as_column(content), LINES + AUTHOR_LINES)
    year = lambda lines: F.try_element_at(F.filter(F.transform(F.slice(lines, 1, LINES), year_in), lambda y: y.isNotNull()), F.lit(1))
    return _with(F.struct(known.alias("lines")), lambda x: _with(F.struct(x["lines"].alias("lines"), year(x["lines"]).alias("year")), _folded))


def _folded(known: Column) -> Column:
    below, any_year = known["lines"], known["year"]

    def step(state: Column, i: Column) -> Column:
        line = F.element_at(below, i)
        joined = (F.length(line) > 80) & F.upper(line).contains("NBER") & ~line.startswith("#")
        before = _before(line, "NBER")
        cut = F
        for name in FIRST_NAMES:
            cut = cut.when(before.contains(f" {name} "), F.instr(before, f" {name} "))
        cut = cut.otherwise(F.lit(0))
        title_1 = strip(F.substring(before, F.lit(1), cut - 1))
        authors_1 = F.regexp_replace(strip(F.substring(before, cut, F.length(before))), r"(?U)\s+and\s*$", "")
        year_1 = F.coalesce(year_in(line), state["year"])
        heading = strip(F.substring(line, 4, 1_000_000_000))
        titled = line.startswith("## ") & ~_contains_any(heading, SERIES_HEADERS) & (F.length(heading) > 20)
        named = lambda x: F.exists(F.array(*map(F.lit, FIRST_NAMES)), lambda n: x.contains(n))
        author_lines = F.filter(F.slice(below, i + 1, F.lit(AUTHOR_LINES)), lambda x: (x != "") & ~x.startswith("#") & named(x) & (F.length(x) < 100))
        made = lambda done, title, authors, year: F.struct(done.alias("done"), title.alias("title"), authors.alias("authors"), year.alias("year")).cast(_STATE)
        found_1 = made(F.lit(True), title_1, authors_1, year_1)
        found_2 = made(F.lit(True), heading, F.try_element_at(author_lines, F.lit(1)), F.coalesce(any_year, state["year"]))
        kept = made(F.lit(False), state["title"], state["authors"], year_1)
        return F.when(state["done"], state).when(joined & (cut > 0), found_1).when(titled, found_2).when(joined, kept).otherwise(state)

    nothing = F.struct(F.lit(False).alias("done"), F.lit(None).alias("title"), F.lit(None).alias("authors"), F.lit(None).alias("year")).cast(_STATE)
    end = F.aggregate(F.sequence(F.lit(1), F.least(F.size(below), F.lit(LINES))), nothing, step)
    return _with(end, lambda e: F.struct(e["title"].alias("title"), e["authors"].alias("authors"), e["year"].alias("year")))


def _without_authors(text: Column) -> Column:
    """A title cut at the first indicator of authors in it, by the indicators' order."""
    out = F
    for mark in AUTHOR_MARKS:
        out = out.when(text.contains(mark), strip(F.substring_index(text, mark, 1)))
    return out.otherwise(text)


def leading_title(content: Column | str) -> Column:
    """The first line that passes for a title, cut before authors and series; null if none does."""

    def title_of(line: Column) -> Column:
        skipped = _contains_any(line, NOT_TITLES)
        long = lambda prefix, n: _with(prefix, lambda x: F.when(F.length(x) > n, x))
        appended = [F.when(F.lower(line).contains(p.lower()), long(_with(_before(line, p), _without_authors), 30)) for p in APPENDED]
        heading = strip(F.substring(line, 4, 1_000_000_000))
        is_heading = line.startswith("## ") & (F.length(heading) > 20)
        plain = (F.length(line) > 40) & ~line.startswith("#")
        split = [F.when(line.contains(m), long(strip(F.substring_index(line, m, 1)), 20)) for m in AUTHOR_MARKS]
        whole = F.when(F.length(line) < 150, line)
        return (
            F.when(line == "", F.lit(None).cast("string"))
            .when(skipped, F.coalesce(*appended))
            .when(is_heading, heading)
            .when(plain, F.coalesce(*appended, *split, whole))
        )

    lines = _first_lines(as_column(content), LINES)
    return F.try_element_at(F.filter(F.transform(lines, title_of), lambda t: t.isNotNull()), F.lit(1))


def title_with_fallbacks(content: Column | str, planned: Column | str) -> Column:
    """leading_metadata's title, else leading_title, else the planned title unless it names a series, else the
    first of 20 lines that is long enough, else "Untitled Paper"."""
    content, planned = as_column(content), as_column(planned)
    up = F.upper(planned)
    usable = null_if_empty(F.when(~(up.contains("NBER") | up.contains("WORKING PAPER") | up.contains("JEL")), planned))
    lines = F.transform(F.slice(F.split(content, "\n"), 1, 20), lambda x: strip(F.regexp_replace(x, "^[# ]+|[# ]+$", "")))
    long = F.filter(lines, lambda x: (F.length(x) > 10) & ~F.upper(x).contains("NBER") & ~F.upper(x).contains("WORKING PAPER"))
    return F.coalesce(null_if_empty(leading_metadata(content)["title"]), null_if_empty(leading_title(content)), usable, F.try_element_at(long, F.lit(1)), F.lit("Untitled Paper"))
