"""Operations on a library of documents: manifests, abstracts, annotated chunks, document facts, search, and the
bibliography that its reference lists add up to. Everything but the merge stays within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.chunks import chunks
from sheaf.functions.text import as_column, null_if_empty, word_count, words_per_minute

#: Suffix of a file -> the format that is written to it.
FORMATS = {".json": "json", ".csv": "csv", ".md": "markdown", ".txt": "text", ".tex": "latex", ".bib": "bibtex", ".ris": "ris", ".parquet": "parquet"}
HEADING = r"^#{1,6}[ \t]+\S"
CITED = r"\((19|20)\d\d[a-z]?\)\. "
MENTION = r"(?i)(?:^|[^A-Za-z0-9_])((?:figure|table)[ \t]\d{1,3})(?:[^0-9]|$)"


def output_format(path: Column | str, given: Column | str | None = None, default: str = "text") -> Column:
    """The format asked for, else that of the path's suffix, else the default."""
    low = F.lower(as_column(path))
    found = F
    for suffix, name in FORMATS.items():
        found = found.when(low.endswith(suffix), F.lit(name))
    return F.coalesce(*([] if given is None else [null_if_empty(given)]), found.otherwise(F.lit(default)))


def manifest(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with source and identifier of "source:identifier"; blank lines and comments are left out, a line without a
    source has a null one."""
    clean = F.trim(F.regexp_replace(line, "[\r\t]", " "))
    kept = lines.withColumn("_line", clean).where("_line != '' and not startswith(_line, '#')")
    split = F.regexp_extract("_line", r"^([A-Za-z]+):(.+)$", 1) != ""
    source = F.when(split, F.lower(F.regexp_extract("_line", r"^([A-Za-z]+):(.+)$", 1)))
    identifier = F.when(split, F.trim(F.regexp_extract("_line", r"^([A-Za-z]+):(.+)$", 2))).otherwise(F.col("_line"))
    return kept.withColumns({"source": source, "identifier": identifier}).drop("_line")


def abstract(text: Column | str) -> Column:
    """What stands between the heading "Abstract" and the next heading; null without one."""
    found = F.regexp_extract(as_column(text), r"(?is)(?:^|\n)[ \t#*]*abstract[ \t*:.]*\n(.*?)(?:\n[ \t]*(?:#{1,6}[ \t]|(?:\d+\.?[ \t]+)?introduction[ \t]*\n)|\z)", 1)
    return null_if_empty(F.regexp_replace(found, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def annotated_chunks(documents: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, start, end, section, mentions, chunk): chunks with the title of the last heading at or before their start (null
    before the first) and the figures and tables they mention, in lower case and once."""
    heads = F.aggregate(
        F.split(text, "\n"), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,title:string>>").alias("heads")),
        lambda a, line: F.struct(
            (a["at"] + F.length(line) + 1).alias("at"),
            F.when(line.rlike(HEADING), F.concat(a["heads"], F.array(F.struct(a["at"].alias("at"), F.trim(F.regexp_replace(line, r"^#{1,6}[ \t]+", "")).alias("title"))))).otherwise(a["heads"]).alias("heads"),
        ),
    )["heads"]
    each = documents.where(F.length(text) > 0).select(key, heads.alias("_heads"), F.explode(chunks(text, size, overlap)).alias("c"))
    last = F.element_at(F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("title"))), F.filter("_heads", lambda h: h["at"] <= F.col("c.start"))), -1)
    mentions = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("c.chunk", F.lit(MENTION), 1), lambda m: F.lower(F.regexp_replace(m, "\t", " ")))))
    return each.select(key, "c.start", (F.col("c.start") + F.length("c.chunk")).alias("end"), last["title"].alias("section"), mentions.alias("mentions"), F.col("c.chunk").alias("chunk"))


def facts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pages, words, minutes, headings, tables, figures, references) of documents with tables and figures."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return documents.select(
        key, F.size(F.split(F.coalesce(text, F.lit("")), "\f")).alias("pages"), word_count(F.coalesce(text, F.lit(""))).alias("words"), words_per_minute(F.coalesce(text, F.lit(""))).alias("minutes"),
        F.size(F.filter(lines, lambda x: x.rlike(HEADING))).alias("headings"), F.coalesce(F.array_size("tables"), F.lit(0)).alias("tables"), F.coalesce(F.array_size("figures"), F.lit(0)).alias("figures"),
        F.size(F.filter(lines, lambda x: x.rlike(CITED))).alias("references"),
    )


def search(papers: DataFrame, author: str | None = None, title: str | None = None, years: tuple[int, int] | None = None, limit: int | None = None, key: str = "paper_id") -> DataFrame:
    """papers (with authors, title, year) by what their authors and title hold, in any case, and by year, newest first; the
    first ``limit`` if one is given, which is the feature of a search."""
    found = papers
    for column, wanted in (("authors", author), ("title", title)):
        if wanted is not None:
            found = found.where(F.contains(F.lower(column), F.lit(wanted.lower())))
    if years is not None:
        found = found.where(F.col("year").between(*years))
    ordered = found.orderBy(F.desc_nulls_last("year"), key)
    return ordered if limit is None else ordered.limit(limit)


def work_key(doi: Column | str, title: Column | str, year: Column | str) -> Column:
    """What makes two references one work: the DOI, else title and year without case and signs; null without either."""
    plain = F.regexp_replace(F.lower(as_column(title)), "[^a-z0-9]+", " ")
    return F.coalesce(F.concat(F.lit("doi:"), F.lower(as_column(doi))), F.concat(F.trim(plain), F.lit("|"), F.coalesce(as_column(year).cast("string"), F.lit(""))))


def merged_bibliography(references: DataFrame, order: list[str]) -> DataFrame:
    """(work, first by ``order`` with its fields, copies): each work once. references: work and other columns.

    Reduced before the shuffle, so a work that a third of all lists cite is no hot group; references without a work are left out.
    """
    rest = [c for c in references.columns if c not in ("work", *order)]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return references.where("work is not null").groupBy("work").agg(first, F.count("*").alias("copies")).select("work", *(F.col(f"_first.{c}").alias(c) for c in (*order, *rest)), "copies")


def citations(references: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the citation graph: (source, work, times), and (work, cited_by) with the number of citing documents."""
    edges = references.where("work is not null").groupBy(source, "work").agg(F.count("*").alias("times"))
    return edges, edges.groupBy("work").agg(F.count("*").alias("cited_by"))


def ris(kind: Column, authors: Column, title: Column, year: Column, journal: Column, pages: Column, doi: Column) -> Column:
    """A reference in the RIS format; fields without a value are left out."""
    line = lambda tag, value: F.when(value.isNotNull(), F.concat(F.lit(f"{tag}  - "), value))
    names = F.when(F.size(authors) > 0, F.array_join(F.transform(authors, lambda a: F.concat(F.lit("AU  - "), a)), "\n"))
    return F.concat_ws("\n", F.concat(F.lit("TY  - "), kind), names, line("TI", title), line("PY", year.cast("string")), line("JO", journal), line("SP", F.regexp_extract(pages, r"^(\d+)", 1)), line("EP", F.regexp_extract(pages, r"(\d+)$", 1)), line("DO", doi), F.lit("ER  - "))
