"""Columns over boxes on a page and the text in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import as_column

PAGE_WIDTH = 612.0
LOW_CONFIDENCE = 0.8


def width(x0: Column, x1: Column) -> Column:
    return x1 - x0


def center(x0: Column, x1: Column) -> Column:
    return (x0 + x1) / 2


def is_display(x0: Column, x1: Column, page_width: float = PAGE_WIDTH) -> Column:
    """Centred within a tenth of the page and less than 0.8 of it wide."""
    return (F.abs(center(x0, x1) - page_width / 2) < page_width * 0.1) & (width(x0, x1) < page_width * 0.8)


def is_math_font(name: Column | str) -> Column:
    """Computer Modern's and the AMS's math fonts, Symbol, and fonts named math."""
    return F.coalesce(as_column(name).rlike(r"(?i)(?:^|\+)(?:cm(?:ex|sy|mi|bsy)\d*|ms[ab]m\d*|eu[fmsr]m?\d*)|symbol|math|stix"), F.lit(False))


def has_math_symbols(text: Column | str) -> Column:
    """At least two characters, one of them an operator, a Greek letter or a double-struck one."""
    text = as_column(text)
    return F.coalesce((F.length(text) >= 2) & text.rlike("[∀-⋿Ͱ-Ͽ℀-⅏⟀-⟯⦀-⫿]"), F.lit(False))


def is_low_confidence(latex: Column | str, confidence: Column | str) -> Column:
    return F.coalesce(as_column(latex).isNotNull() & (as_column(confidence) < LOW_CONFIDENCE), F.lit(False))


def equation_json(id_: Column, page: Column, kind: Column, bbox: Column, image: Column, latex: Column, context: Column, with_image: bool = False) -> Column:
    """An equation as JSON; absent LaTeX and context are left out, the image comes on request."""
    parts = [id_.alias("id"), page.alias("page"), kind.alias("type"), bbox.alias("bbox"), F.lit("png").alias("image_format"), latex.alias("latex"), context.alias("context")]
    if with_image:
        parts.append(F.base64(image).alias("image_base64"))
    return F.to_json(F.struct(*parts))
