"""Columns over identifiers of papers and names of files.

Null is no identifier; a null name becomes the default name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import as_column

# The shapes of identifiers.
ARXIV = r"(?i)^(?:arxiv:)?(?:\d{4}\.\d{4,5}|[a-z]+(?:-[a-z]+)*(?:\.[a-z]{2})?/\d{7})(?:v\d+)?$"
DOI = r"(?i)^(?:doi:\s*|https?://(?:dx\.)?doi\.org/)?10\.\d{4,9}/\S+$"
SSRN = r"(?i)^(?:ssrn:|ssrn-id)?\d{7,8}$"
NBER = r"(?i)^(?:nber:)?w?\d{4,5}$"
URL = r"(?i)^https?://\S+$"


def _matches(text: Column | str, pattern: str) -> Column:
    return F.coalesce(as_column(text).rlike(pattern), F.lit(False))


def is_arxiv(text: Column | str) -> Column:
    return _matches(text, ARXIV)


def is_doi(text: Column | str) -> Column:
    return _matches(text, DOI)


def is_ssrn(text: Column | str) -> Column:
    """Seven or eight digits, as for SSRN."""
    return _matches(text, SSRN)


def is_nber(text: Column | str) -> Column:
    """Four or five digits, with or without w."""
    return _matches(text, NBER)


def is_url(text: Column | str) -> Column:
    return _matches(text, URL)


def source_of(text: Column | str) -> Column:
    """The first source, in this order, whose shape an identifier has: arxiv, doi, ssrn, nber, url; else unknown."""
    text = as_column(text)
    return (
        F.when(is_arxiv(text), "arxiv").when(is_doi(text), "doi").when(is_ssrn(text), "ssrn").when(is_nber(text), "nber").when(is_url(text), "url").otherwise("unknown")
    )


def normalised(text: Column | str) -> Column:
    """An identifier without prefix: the bare arXiv id or DOI, the digits for SSRN and NBER, others as they are."""
    text = as_column(text)
    source = source_of(text)
    return (
        F.when(source == "arxiv", F.regexp_replace(text, r"(?i)^arxiv:", ""))
        .when(source == "doi", F.regexp_extract(text, r"10\.\d{4,9}/\S+", 0))
        .when(source.isin("ssrn", "nber"), F.regexp_extract(text, r"\d+", 0))
        .otherwise(text)
    )


def slug(text: Column | str) -> Column:
    """Lower case, runs of other signs as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(as_column(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_filename(name: Column | str, default: str = "download", most: int = 255) -> Column:
    """The last part of a decoded path without leading dots and with reserved signs replaced; at most
    ``most`` characters with its suffix kept."""
    decoded = F.coalesce(F.try_url_decode(F.replace(as_column(name), F.lit("+"), F.lit("%2B"))), as_column(name))
    base = F.regexp_replace(F.regexp_extract(decoded, r"([^/\\]*)$", 1), r"^\.+", "")
    clean = F.regexp_replace(base, r'[<>:"|?*]', "_")
    suffix = F.regexp_extract(clean, r"(\.[^.]{1,16})$", 1)
    long = F.concat(F.substring(clean, F.lit(1), F.lit(most) - F.length(suffix)), suffix)
    return F.coalesce(F.nullif(F.when(F.length(clean) > most, long).otherwise(clean), F.lit("")), F.lit(default))


def filename_from_url(url: Column | str) -> Column:
    """The PDF's own name, else one made of host and path."""
    url = as_column(url)
    path = F.regexp_replace(url, r"[?#].*$", "")
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    host = F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)
    made = F.concat(slug(F.concat_ws("_", host, F.regexp_extract(path, r"^[a-zA-Z]+://[^/]+/?(.*)$", 1))), F.lit(".pdf"))
    return F.when(F.lower(base).endswith(".pdf") & (F.length(base) > 4), safe_filename(base)).otherwise(made)


def chapter_filename(number: Column | str, title: Column | str, suffix: str = ".txt") -> Column:
    """NN_title: two digits, the lower-case title with underscores, its first 40 characters, reserved signs replaced."""
    name = F.substring(F.replace(F.lower(as_column(title)), F.lit(" "), F.lit("_")), 1, 40)
    return F.concat(F.lpad(as_column(number).cast("string"), 2, "0"), F.lit("_"), F.regexp_replace(name, r'[<>:"|?*/\\]', "_"), F.lit(suffix))
