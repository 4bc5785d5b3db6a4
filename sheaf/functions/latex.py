"""Columns that escape text for LaTeX. Null gives an empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import as_column

# Replacements in the order in which they are made; later ones also hit what earlier ones put in.
ESCAPES = [
    ("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"),
    ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"),
]
AFTER_MARKDOWN = [("$", "\\$"), ("&", "\\&"), ("%", "\\%"), ("#", "\\#"), ("~", "\\textasciitilde{}")]
OUTSIDE_MATH = [("&", "\\&"), ("%", "\\%"), ("#", "\\#")]


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for what, by in pairs:
        text = F.replace(text, F.lit(what), F.lit(by))
    return text


def escape(text: Column | str) -> Column:
    """Every character that LaTeX takes as a command."""
    return _replaced(F.coalesce(as_column(text), F.lit("")), ESCAPES)


def from_markdown(text: Column | str) -> Column:
    """Bold and italics of Markdown, then the signs that neither uses."""
    bold = F.regexp_replace(F.coalesce(as_column(text), F.lit("")), r"\*\*(.+?)\*\*", r"\\textbf{$1}")
    return _replaced(F.regexp_replace(bold, r"\*(.+?)\*", r"\\textit{$1}"), AFTER_MARKDOWN)


def keep_math(text: Column | str) -> Column:
    """Signs outside of $...$ and $$...$$; a dollar sign before a digit is money."""
    money = F.regexp_replace(F.coalesce(as_column(text), F.lit("")), r"\$(\d)", r"\\\$$1")
    parts = F.regexp_extract_all(money, F.lit(r"(\$\$[^$]+\$\$|\$[^$]+\$|[^$]+|\$)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("$") & (F.length(p) > 2), p).otherwise(_replaced(p, OUTSIDE_MATH))), "")
