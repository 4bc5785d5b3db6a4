"""Reports as LaTeX: one text per paper or chapter, built as columns, put together in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.latex import ESCAPES, escape, from_markdown, keep_math
from sheaf.functions.text import template_truncate, truncate_words


def _given(column: str) -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def _part(column: str, label: str, render) -> Column:
    """A labelled paragraph, left out if its column has no value."""
    return F.when(_given(column), F.concat(F.lit(f"\\textbf{{{label}.}} "), render(column)))


def paper_section(columns: list[str]) -> Column:
    """A paper's section; the columns that the table has are used."""
    has = lambda c: c in columns
    title = F.coalesce(F.col("short_title"), F.col("title")) if has("short_title") else F.col("title")
    head = F.concat(F.lit("\\section{"), truncate_words(escape(title), 60), F.lit("}\n\\textit{"), escape("authors"), F.lit("} ("), escape(F.col("year").cast("string")), F.lit(") \\hfill \\textsc{\\small "), escape("paper_type"), F.lit("}"))
    parts = [head]
    if has("golden_quote"):
        parts.append(F.when(_given("golden_quote"), F.concat(F.lit("\\begin{quote}\\itshape ``"), escape("golden_quote"), F.lit("''\\end{quote}"))))
    parts.append(F.concat(F.lit("\\textbf{Context.} "), escape("context")))
    for column, label, render in (("core_mechanism", "Core Mechanism", keep_math), ("prior_work", "Prior Work", escape)):
        if has(column):
            parts.append(_part(column, label, render))
    parts.append(F.concat(F.lit("\\textbf{Method.} "), keep_math("method")))
    if has("key_equations"):
        where = F.when(_given("notation"), F.concat(F.lit("\n\n\\textit{where "), keep_math("notation"), F.lit("}"))).otherwise(F.lit("")) if has("notation") else F.lit("")
        parts.append(F.when(_given("key_equations"), F.concat(F.lit("\\textbf{Key Equation.} "), F.col("key_equations"), where)))
    parts.append(F.concat(F.lit("\\textbf{Results.} "), keep_math("results")))
    if has("key_visual_explanation"):
        figure = F.when(_given("key_visual_path"), F.concat(F.lit("\n\\begin{figure}[h]\\centering\\includegraphics[width=0.5\\textwidth]{"), F.col("key_visual_path"), F.lit("}\\caption{"), escape("key_figure_description"), F.lit("}\\end{figure}"))).otherwise(F.lit(""))
        parts.append(F.when(_given("key_visual_explanation"), F.concat(F.lit("\\textbf{Key Visual} ("), escape("key_figure_ref"), F.lit("). "), escape("key_visual_explanation"), figure)))
    for column, label in (("data_description", "Data"), ("contribution", "Contribution"), ("applications", "Applications"), ("limitations", "Limitations")):
        if has(column):
            parts.append(_part(column, label, escape))
    return F.concat_ws("\n\n", *parts, F.lit("\\newpage"))


def appendix_row() -> Column:
    """A paper's row of the condensed table, with its category's heading and band where they belong
    (starts_category and banded, see categories.headings)."""
    heading = F.when(F.col("starts_category"), F.concat(F.lit("\\rowcolor{categoryblue}\n\\multicolumn{4}{|l|}{\\textbf{\\textcolor{headerblue}{"), escape("category"), F.lit("}}} \\\\\n\\hline\n"))).otherwise(F.lit(""))
    band = F.when(F.col("banded"), F.lit("\\rowcolor{rowgray}\n")).otherwise(F.lit(""))
    cells = F.concat(F.lit("\\textbf{"), escape("authors"), F.lit("} ("), escape(F.col("year").cast("string")), F.lit(") says "), escape("condensed_says"), F.lit(" &\n"), escape("condensed_theory_data"), F.lit(" &\n"), keep_math("condensed_estimation"), F.lit(" &\n"), keep_math("condensed_result"), F.lit(" \\\\\n\\hline"))
    return F.concat(heading, band, cells)


def contents_line() -> Column:
    """A chapter's line of the contents: number, title, page ordinal + 2, beginning of its thesis."""
    return F.concat(F.lit("\\noindent\\textbf{"), F.col("number").cast("string"), F.lit(". "), escape("title"), F.lit("} \\hfill \\textit{p.\\,"), (F.col("ordinal") + 2).cast("string"), F.lit("}\\\\\n{\\small "), template_truncate(escape("main_thesis"), 200), F.lit("}"))


def chapter_section() -> Column:
    """A chapter's section of a book report; key_terms is an array."""
    text = lambda c: F.when(_given(c), from_markdown(c))
    quote = F.when(_given("golden_quote"), F.concat(F.lit("\\begin{quote}\\itshape ``"), escape("golden_quote"), F.lit("''\\end{quote}")))
    terms = F.when(F.size("key_terms") > 0, F.concat(F.lit("{\\small\\textsc{Key Concepts:} "), escape(F.array_join("key_terms", ", ")), F.lit("}")))
    pages = F.concat(F.lit("\\hfill{\\small\\textit{pp.\\,"), F.col("start_page").cast("string"), F.lit("--"), F.col("end_page").cast("string"), F.lit("}}"))
    return F.concat_ws("\n\n", F.concat(F.lit("\\section{"), escape("title"), F.lit("}")), quote, from_markdown("main_thesis"), from_markdown("unique_insight"), text("how_to"), from_markdown("key_evidence"), text("counterexample"), text("practical_implications"), terms, pages, F.lit("\\newpage"))


def executive_summary(text: Column | str) -> Column:
    """The part before a review's papers."""
    return F.concat(F.lit("\\section*{Executive Summary}\n\\addcontentsline{toc}{section}{Executive Summary}\n\n"), from_markdown(text), F.lit("\n\n\\newpage"))


def book_front() -> Column:
    """The part before a book's chapters: what its synthesis gives, null if that is nothing; key_themes is an array."""
    given = lambda c, head: F.when(_given(c), F.concat(F.lit(head), escape(c)))
    themes = F.when(F.size("key_themes") > 0, F.concat(F.lit("\\textsc{Key Themes:} "), F.array_join(F.transform("key_themes", escape), " \\,$\\cdot$\\, ")))
    parts = F.concat_ws("\n\n", given("one_paragraph_summary", ""), themes, given("book_thesis", "\\textbf{Thesis.} "), given("intellectual_journey", "\\textbf{Journey.} "))
    return F.when(parts != "", F.concat(parts, F.lit("\n\n\\newpage")))


def assembled(sections: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, body): the sections of each report in order; a report is a document for people, so it fits one row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return sections.groupBy(group).agg(F.array_join(parts, "\n\n").alias("body"))


def latex_text(text: str) -> str:
    """A short text of the driver escaped as the column ``escape`` does."""
    for what, by in ESCAPES:
        text = text.replace(what, by)
    return text


def _head(packages: str, front: str) -> str:
    return f"\\documentclass{{article}}\n\\usepackage{{{packages}}}\n\\begin{{document}}\n{front}\n\n"


#: The end of every LaTeX file.
TAIL = "\n\n\\end{document}\n"


def review_head(title: str) -> str:
    """What stands before a review's body; the header holds the beginning of the title, cut before it is escaped."""
    return _head("graphicx,longtable,xcolor,colortbl,fancyhdr", f"\\markboth{{{latex_text(title[:50])}}}{{}}\n\\tableofcontents\n\\newpage")


def document(body: str, title: str) -> str:
    """A whole LaTeX file around a body."""
    return review_head(title) + body + TAIL


def appendix_head(papers: int) -> str:
    """What stands before the rows of the condensed table."""
    colors = "".join(f"\\definecolor{{{name}}}{{RGB}}{{{rgb}}}\n" for name, rgb in (("categoryblue", "220,230,242"), ("headerblue", "31,73,125"), ("rowgray", "245,245,245")))
    names = " & ".join(f"\\textbf{{{h}}}" for h in ("Paper", "Theory/Data", "Estimation", "Results"))
    columns = "".join(f"p{{{width}\\textwidth}}|" for width in (0.28, 0.2, 0.24, 0.2))
    return _head("longtable,xcolor,colortbl,amsmath", f"{colors}\\section*{{Appendix: {papers} papers}}") + f"\\begin{{longtable}}{{|{columns}}}\n\\hline\n{names} \\\\\n\\hline\n\\endhead\n"


APPENDIX_TAIL = "\n\\end{longtable}" + TAIL


def book_document(title: Column | str, contents: Column | str, body: Column | str) -> Column:
    """A whole LaTeX file per book: title, contents, body; the header holds the beginning of the title."""
    title, contents, body = (F.col(c) if isinstance(c, str) else c for c in (title, contents, body))
    title = F.coalesce(title, F.lit(""))
    return F.concat(
        F.lit(_head("graphicx,xcolor,fancyhdr", "\\markboth{")[:-2]), escape(F.substring(title, 1, 50)), F.lit("}{}\n\\title{"), escape(title), F.lit("}\n\\maketitle\n\n"),
        F.when(contents != "", F.concat(F.lit("\\section*{Contents}\n"), contents, F.lit("\n\\newpage\n\n"))).otherwise(F.lit("")), F.coalesce(body, F.lit("")), F.lit(TAIL),
    )
